"""What must not grow: what is broadcast, rows that leave a task at once, edges that are shuffled; results against plain counting."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loamwork import session
from loamwork.operators import chunking, embedding, entities, extract, graph, service, vecindex


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_never_broadcast(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"text {i % 7}") for i in range(40)], "id long, text string")

    class Calls(embedding.Fallback):
        def embed(self, texts):
            assert len(texts) <= 3
            return super().embed(texts)

    made = embedding.embed_column(rows, "text", Calls(8), batch=3)
    assert "BroadcastHashJoin" not in plan(made) and "SortMergeJoin" in plan(made)
    one = embedding.Fallback(8)
    assert {r.id: r.embedding for r in made.collect()} == {r.id: one.one(r.text or "").tolist() for r in rows.collect()}


def test_batches_to_workers_are_bounded_by_rows_and_bytes(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    session.ship(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    few = [tuple(r) for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long, bytes long").collect()]
    wide = spark.range(0, 1200, 1, 1).select(F.repeat(F.lit("x"), 40_000).alias("text"))
    found = [tuple(r) for r in wide.mapInArrow(sizes, "n long, bytes long").collect()]
    assert sum(n for n, _ in few) == 5000 and max(n for n, _ in few) <= 2000
    assert sum(n for n, _ in found) == 1200 and max(b for _, b in found) <= (16 << 20) + 100_000


def test_entities_leave_in_bounded_batches(spark, monkeypatch):
    texts = [None, "", "the", "Alpha beta_1. db.table Слово", "w%d " * 50 % tuple(range(50))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    want = sorted((k, *m) for k, t in enumerate(texts) for m in entities.find(t or "", entities.Extraction()))
    found = extract.entities_of(rows, carry=["id"])
    assert found.columns == ["id", "start", "end", "uri", "alias"] and "ArrowEvalPythonUDTF" not in plan(found)
    assert sorted(tuple(r) for r in found.collect()) == want
    listed = rows.select("id", F.explode(entities.matches(F.col("text"))).alias("m")).select("id", "m.*")
    assert sorted(tuple(r) for r in listed.collect()) == want
    assert extract.entities_of(rows).columns == ["id", "text", "start", "end", "uri", "alias"]
    assert entities.columns([], entities.MATCHED) == [pa.array([], t) for t in entities.MATCHED.types]


CHUNKS = [("c1", "d1", "w", ["u1"], ["e1", "e2", "e1"]), ("c2", "d1", "w", ["u2"], ["e2", None]), ("c1", "d1", "w", ["u3"], ["e3"]), ("c3", "d2", "v", None, []), ("c4", "d2", "v", [], None), ("c4", "d3", "w", ["u1"], ["e1"])]


def test_edges_are_different_before_they_are_made(spark):
    chunks = spark.createDataFrame(CHUNKS, "uri string, doc_uri string, workspace_id string, acl_allow array<string>, entity_uris array<string>")
    want = set()
    for uri, doc, ws, _, ents in CHUNKS:
        want |= {(doc, "CONTAINS", uri, ws)} | {(uri, "MENTIONS", e, ws) for e in ents or []} | {(e, "DOCUMENTED_IN", doc, ws) for e in ents or []}
    edges = graph.mention_edges(chunks)
    got = [tuple(r) for r in edges.collect()]
    assert len(got) == len(want) and set(got) == want
    # what is shuffled has arrays: no exchange is dealt out by whole edges of mentions
    assert "hashpartitioning(src" not in plan(edges.where("rel <> 'CONTAINS'"))
    nodes = {(r.uri, r.workspace_id): (r.type, r.acl_allow) for r in graph.mention_nodes(chunks.withColumn("title", F.lit("t"))).collect()}
    assert nodes[("e1", "w")] == ("Entity", ["u1", "u3"][:1]) and nodes[("c1", "w")] == ("Chunk", ["u1", "u3"]) and nodes[("d2", "v")] == ("Document", [])


def test_walk_over_visible_nodes_is_that_over_visible_edges(spark):
    pairs = [(f"n{i:02}", f"n{(i * j + 1) % 40:02}") for i in range(40) for j in (1, 3, 7)]
    edges = spark.createDataFrame([(a, "CALLS", b) for a, b in pairs] * 2, "src string, rel string, dst string")
    nodes = spark.createDataFrame([(f"n{i:02}",) for i in range(40) if i % 6], "uri string")
    seeds = spark.createDataFrame([("a", "n01"), ("a", "n13"), ("b", "n06"), ("c", "n38")], "qid string, uri string")
    seen = {f"n{i:02}" for i in range(40) if i % 6}
    both = {(a, b) for a, b in pairs if {a, b} <= seen} | {(b, a) for a, b in pairs if {a, b} <= seen}
    for most in (3, 9, 200):
        want = set()
        for q in "abc":
            have = dict.fromkeys(sorted(u for k, u in [tuple(r) for r in seeds.collect()] if k == q)[:most], 0)
            front = set(have)
            for hop in (1, 2):
                fresh = sorted({b for a, b in both if a in front} - set(have))[: most - len(have)]
                have |= dict.fromkeys(fresh, hop)
                front = set(fresh)
            want |= {(q, u, h) for u, h in have.items()}
        for walked in (graph.expand(edges, seeds, 2, most, nodes), graph.expand(graph.visible_edges(edges, nodes), seeds, 2, most)):
            assert {tuple(r) for r in walked.collect()} == want


def test_search_keeps_to_the_callers_workspace(spark):
    """A relation that another workspace states of entities that both know leads nowhere."""
    node = "uri string, type string, name string, workspace_id string, acl_allow array<string>"
    nodes = spark.createDataFrame([(u, "Entity", u, w, ["u1"]) for u in ("kb://entity/symbol:aaa", "kb://entity/symbol:bbb") for w in ("w1", "w2")], node)
    edges = spark.createDataFrame([("kb://entity/symbol:aaa", "CALLS", "kb://entity/symbol:bbb", "w2")], "src string, rel string, dst string, workspace_id string")
    none = lambda s: spark.createDataFrame([], s)
    chunks = none("uri string, doc_uri string, text string, span struct<start:int,end:int>, entity_uris array<string>, workspace_id string, acl_allow array<string>, tags array<string>, source string, updated_at timestamp")
    memory = none("uri string, text string, workspace_id string, subject string, citations array<struct<chunk_uri:string>>, type string, confidence double, status string, updated_at timestamp")
    base = service.KnowledgeBase(none("doc_uri string, title string"), chunks, nodes, edges, memory)
    asks = spark.createDataFrame([("q", "aaa", "hybrid", False)], "qid string, query string, mode string, include_memory boolean")
    traces = service.search(asks, base, service.Filter("w1", "u1"))[2].first()
    assert (traces.seeds, traces.reached, traces.fallback_reason) == (1, 1, None)


def test_few_rows_of_a_query_leave_a_batch_of_vectors(spark):
    """Not k of each block: whatever the blocks, k of each query leave, by exact scores; equal ones by uri."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(600, 8)), np.repeat(rng.normal(size=(1, 8)), 300, axis=0)])
    unit = vecindex.unit(x)
    asked = unit[::45]
    exact = lambda q: (unit * asked[q]).sum(1)
    want = [sorted(range(900), key=lambda i: (-exact(q)[i], i))[:5] for q in range(len(asked))]  # noqa: B023
    low = np.full(len(asked), -np.inf)
    q, item, score = vecindex.best(unit, asked, low, 5)
    assert [item[q == j].tolist() for j in range(len(asked))] == want
    assert all(score[q == j].tolist() == exact(j)[want[j]].tolist() for j in range(len(asked)))
    assert low.tolist() == [exact(j)[want[j][-1]] for j in range(len(asked))]
    assert not len(vecindex.best(unit[:0], asked, low, 5)[0]) and len(vecindex.best(unit[:3], asked, np.full(len(asked), -np.inf), 5)[0]) == 3 * len(asked)
    # what scores no better than what an earlier batch gave stays
    assert len(vecindex.best(unit[:100], asked, low, 5)[0]) < 5 * len(asked)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "uri long, vec array<double>").coalesce(1)
    index = vecindex.build(items, cells=40)
    assert index.blocks.count() > 20
    for probes in (None, 40):
        found = vecindex.search(spark.createDataFrame([(j, x[j * 45].tolist()) for j in range(len(asked))], "qid long, vec array<double>"), index, 5, probes=probes)
        assert sorted((r.qid, r["rank"], r.uri) for r in found.collect()) == [(j, n + 1, i) for j in range(len(asked)) for n, i in enumerate(want[j])]


def test_table_functions_get_bounded_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    extract.register(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
    texts = spark.range(0, 4500, 1, 1).select(F.when(F.col("id") % 9 == 0, None).otherwise(F.concat(F.lit("name_"), F.col("id").cast("string"))).alias("text"))
    found = spark.sql("SELECT r.alias FROM {texts} AS t, LATERAL kb_entities(t.text) AS r", texts=texts)
    assert sorted(r.alias for r in found.collect()) == sorted(f"name_{i}" for i in range(4500) if i % 9)


def test_like_sentences_are_found_over_whole_batches(spark, monkeypatch):
    texts = ["", "Ab 12 cd.", "Ab 12 ce.", "Привет, МИР ٣²!", None, " \x1f ", "Ab 12 cd.", "ÀÉ x", "zzzz " * 40, "Ab 12 cd."]
    monkeypatch.setattr(embedding, "COUNTED", 3)
    for n in (384, 258, 100):
        v = embedding.Fallback(n).embed(texts)
        want = np.concatenate([[0], (v[1:] * v[:-1]).sum(1)])
        assert np.allclose(embedding.neighbour_cosines(pa.array(texts, pa.string()), n), want, atol=1e-12)
    assert not len(embedding.neighbour_cosines(pa.array([], pa.string()), 384))
    docs = [None, "", "One a. One b. 77777! Ünï ä.\nEnd", "x", "Same 1. Same 2. Same 3. " * 300]
    rows = spark.createDataFrame(list(enumerate(docs)), "id int, text string").coalesce(1)
    cut = rows.select("id", chunking.text.sentences(F.col("text")).alias("s"))
    found = {r.id: ([] if r.s is None else r.s, [tuple(b) for b in r.b]) for r in cut.select("*", chunking.like_blocks(F.col("s"), 0.9, 384).alias("b")).collect()}
    for s, blocks in found.values():
        v, want, at = embedding.Fallback(384).embed(s), [], 0
        for i, sentence in enumerate(s):
            if i and (v[i] * v[i - 1]).sum() >= 0.9:
                want[-1] = (want[-1][0], at + len(sentence))
            else:
                want.append((at, at + len(sentence)))
            at += len(sentence)
        assert blocks == want
    # no array grows sentence by sentence
    assert "_v" not in plan(chunking.semantic(rows)) and len(found[2][1]) > 1 and len(found[4][1]) == 1


def test_the_driver_lets_go_after_each_round(spark, monkeypatch):
    from loamwork.llm import _graph

    done = []
    monkeypatch.setattr(session, "let_go", lambda s: done.append(s))
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (8, 9)], "a long, b long")
    assert sorted(tuple(r) for r in _graph.components(links).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (8, 8), (9, 8)]
    assert len(done) >= 2
