"""Changed files of repositories, stateful streams, the vector index, the embedding cache and table functions, against brute force."""

import subprocess
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork import session
from loamwork.operators import chunking, embedding, entities, extract, memory, service, vecindex
from loamwork.operators.filters import Filter
from loamwork.sources import files
from loamwork.streaming import live


def test_changes_of_several_repositories(spark, tmp_path):
    git = lambda root, *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    for name, changed in (("one", ["a.md", "b.md"]), ("two", ["c.txt"])):
        root = tmp_path / name
        root.mkdir()
        git(root, "init", "-q")
        (root / "kept.md").write_text("x")
        git(root, "add", "-A")
        git(root, "commit", "-qm", "first")
        for f in changed:
            (root / f).write_text("y")
        git(root, "add", "-A")
        git(root, "commit", "-qm", "second")
    roots = [str(tmp_path / x) for x in ("one", "two", "absent")]
    got = files.changes(spark, roots)
    assert {(r.root, r.source_path) for r in got.collect()} == {(roots[0], "a.md"), (roots[0], "b.md"), (roots[1], "c.txt")}
    assert got.rdd.getNumPartitions() == 3 and files.changes(spark, []).count() == 0


def test_stated_relations_need_near_entities_of_two_names():
    near = lambda text: [(a[19:], rel, b[19:]) for _, _, a, rel, b in extract.relations(text, entities.Extraction(kinds=("symbol",)))]
    assert near("Alpha calls Beta. Beta owns Gamma") == [("alpha", "CALLS", "beta"), ("beta", "OWNS", "gamma")]
    assert near("calls Alpha Beta") == [("calls", "CALLS", "alpha")]  # nothing stands left: the two nearest, the trigger's own word among them
    assert near("Alpha calls Alpha") == [("calls", "CALLS", "alpha")]
    assert near("Alpha calls Beta, " + " " * 250 + "Alpha calls Beta") == [("alpha", "CALLS", "beta")]
    assert near("Alpha " + " " * 300 + "calls" + " " * 300 + "Beta") == [] and near("") == []


def test_table_functions_in_sql(spark):
    extract.register(spark)
    rows = spark.sql("SELECT r.* FROM VALUES ('Ваза вызывает Мир'), (NULL), ('') t(text), LATERAL kb_relations(t.text) r").collect()
    assert [(r.start, r.end, r.src, r.rel, r.dst) for r in rows] == [(5, 13, "kb://entity/term:ваза", "CALLS", "kb://entity/term:мир")]
    df = spark.createDataFrame([(1, "core.orders Alpha")], "uri long, text string")
    assert {(r.uri, r.alias) for r in extract.entities_of(df.withColumnRenamed("uri", "id")).collect()} == {("kb://entity/table:core.orders", "core.orders"), ("kb://entity/symbol:core", "core"), ("kb://entity/symbol:orders", "orders"), ("kb://entity/symbol:alpha", "Alpha")}


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(30, 16))
    x = middles[rng.integers(0, 30, 3000)] + 0.25 * rng.normal(size=(3000, 16))
    x[1000:2000] = x[1000]  # a third are one vector
    return x


def nearest(x, rows, q, k, own=lambda i: True):
    s = {i: float((vecindex.unit(x[i : i + 1])[0] * vecindex.unit(q[None])[0]).sum()) for i in rows if own(i)}
    return [i for _, i in sorted((-round(v, 12), i) for i, v in s.items())][:k]


def test_vector_index(spark, vectors):
    x = vectors
    items = spark.createDataFrame([(i, x[i].tolist(), f"g{i % 2}") for i in range(len(x))], "uri long, vec array<double>, g string")
    index = vecindex.build(items, ["g"])
    asked = [7, 1500, 2500, 2999]
    queries = spark.createDataFrame([(q, x[q].tolist()) for q in asked], "qid long, vec array<double>")
    lists = lambda df: {q: [r.uri for r in sorted(df.where(F.col("qid") == q).collect(), key=lambda r: r.rank)] for q in asked}
    exact = lists(vecindex.search(queries, index, 5))
    assert exact == {q: nearest(x, range(3000), x[q], 5) for q in asked}
    assert lists(vecindex.search(queries, index, 5, F.col("g") == "g1")) == {q: nearest(x, range(3000), x[q], 5, lambda i: i % 2 == 1) for q in asked}
    many = spark.createDataFrame([(int(q), x[q].tolist()) for q in range(0, 3000, 30)], "qid long, vec array<double>")
    pairs = lambda **o: {(r.qid, r.uri) for r in vecindex.search(many, index, 5, **o).collect()}
    whole, few = pairs(), pairs(probes=5)
    assert len(whole & few) / len(whole) >= 0.9 and len(index.centroids) == 54
    after = vecindex.updated(index, items.where("uri < 100"), spark.createDataFrame([(2500, (-x[2500]).tolist(), "g9"), (9000, x[2500].tolist(), "g9")], items.schema))
    assert lists(vecindex.search(queries, after, 1))[2500] == [9000]
    assert not any(r.uri < 100 for r in vecindex.search(queries, after, 50).collect())


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1e200, 1.0]), (2, [1e200, 2.0]), (3, [1e-200, 1e-200]), (4, [0.0, 0.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [])]
    items = spark.createDataFrame(rows, "uri long, vec array<double>")
    index = vecindex.build(items)
    got = vecindex.search(items.withColumnRenamed("uri", "qid"), index, 9).collect()
    assert {(r.qid, r.uri) for r in got} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} and all(abs(r.score) <= 1 + 1e-12 for r in got)
    assert vecindex.search(items.limit(0).withColumnRenamed("uri", "qid"), index, 3).count() == 0
    assert vecindex.search(items.withColumnRenamed("uri", "qid"), vecindex.build(items.limit(0)), 3).count() == 0


def test_search_by_vectors_and_without_a_graph(spark):
    schema = "workspace_id string, source_path string, title string, source string, tags array<string>, acl_allow array<string>, updated_at timestamp, text string"
    texts = {"a": "alpha beta gamma", "b": "0123456789 0123456789", "c": "ALPHA BETA"}
    rows = spark.createDataFrame([("w", k, k, "s", [], ["u1"], datetime(2024, 1, 1), t) for k, t in texts.items()], schema)
    store = service.ingest_files(rows, service.empty_store(spark), chunking.spans)[0].written()
    base = store.knowledge_base(spark.createDataFrame([], "uri string, workspace_id string, subject string, text string, citations array<struct<chunk_uri:string>>"))
    base = service.KnowledgeBase(**{**base.__dict__, "vectors": service.Vectors.of(store.chunks, embedding.Fallback(384))})
    asks = spark.createDataFrame([("q", "0123456789", "hybrid", False)], "qid string, query string, mode string, include_memory boolean")
    found, _, traces = service.search(asks, base, Filter("w", "u1"))
    assert found.where("rank = 1").first().title == "b" and found.count() == 3 and traces.first().fallback_mode is None
    lost = service.KnowledgeBase(**{**base.__dict__, "edges": base.edges.select("src")})
    found, _, traces = service.search(asks, lost, Filter("w", "u1"))
    assert found.count() == 3 and traces.first().fallback_mode == "vector" and "dst" in traces.first().fallback_reason


def test_embedding_cache(spark):
    class Counting(embedding.Fallback):
        pass

    rows = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None)], "id long, text string")
    empty = spark.createDataFrame([], embedding.CACHE)
    out, cache, counts = embedding.embed_cached(rows, "text", Counting(8), empty, F.timestamp_seconds(F.lit(1)), "m", "1")
    cache = session.written(cache, "cache")
    assert tuple(counts.first()) == (3, 0, 3) and cache.count() == 3
    want = {r.id: embedding.Fallback(8).one(r.text or "").tolist() for r in rows.collect()}
    assert {r.id: r.embedding for r in out.collect()} == want
    out, cache, counts = embedding.embed_cached(rows.where("id = 2"), "text", Counting(8), cache, F.timestamp_seconds(F.lit(2)), "m", "1")
    cache = session.written(cache, "cache")
    assert tuple(counts.first()) == (1, 1, 0) and out.first().embedding == want[2]
    kept = embedding.evict(cache, 1).collect()
    assert len(kept) == 1 and kept[0].vec == want[2] and embedding.evict(cache, 9).count() == 3 and embedding.evict(cache, 0).count() == 0
    # another model, revision or prefix has keys of its own
    assert tuple(embedding.embed_cached(rows, "text", Counting(8), cache, F.timestamp_seconds(F.lit(3)), "m", "1", preset="multilingual-e5-large")[2].first()) == (3, 0, 3)


def test_prefixes_of_presets_reach_the_model(spark):
    class Seen(embedding.Fallback):
        def embed(self, texts):
            return np.array([[float(t.startswith("query: ")), float(t.startswith("passage: "))] for t in texts])

    df = spark.createDataFrame([("a",)], "text string")
    one = lambda passage: embedding.embed_column(df, "text", Seen(2), preset="multilingual-e5-large", passage=passage).first().embedding
    assert one(True) == [0.0, 1.0] and one(False) == [1.0, 0.0]


def test_streams_equal_batches_and_go_on_after_a_restart(spark):
    start = datetime(2024, 1, 1)
    rng = np.random.default_rng(6)
    rows = [(i, start + timedelta(minutes=int(m)), f"k{rng.integers(0, 4)}", str(rng.choice([live.ISSUE, live.CONFIRM]))) for i, m in enumerate(np.sort(rng.integers(0, 3000, 120)))]
    schema = "event_id long, ts timestamp, token string, kind string"
    whole = spark.createDataFrame(rows, schema)
    for make in (lambda s: live.answer(s, "token", 7200), lambda s: live.confirmations(s, "token", 3600)):
        source, out, checkpoint = (session.fresh_path(spark, x) for x in ("in", "out", "checkpoint"))
        for part in (rows[:50], rows[50:51], rows[51:]):
            spark.createDataFrame(part, schema).write.mode("append").parquet(source)
            live.run(make(spark.readStream.schema(schema).parquet(source)), out, checkpoint)
        got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
        assert len(got) == 120
        state, want = {}, []
        for i, ts, key, kind in rows:
            if make(whole).columns[2] == "answer_of":
                if key not in state or (ts - state[key][0]).total_seconds() > 7200:
                    state[key] = (ts, i)
                want.append((key, i, state[key][1]))
            else:
                if kind == live.ISSUE:
                    state[key] = (ts, False)
                    want.append((key, i, None))
                else:
                    good = key in state and not state[key][1] and (ts - state[key][0]).total_seconds() <= 3600
                    if good:
                        state[key] = (state[key][0], True)
                    want.append((key, i, good))
        assert got == sorted(want, key=repr)


def test_memory_links(spark):
    item = "uri string, workspace_id string, subject string, type string, text string, n_citations int, confidence double, request_key string, entity_uris array<string>"
    old = spark.createDataFrame([("m1", "w", "u1", "fact", "a: b c", 1, 0.9, "k0", ["e1"])], item)
    put = spark.createDataFrame([("m1", "w", "u1", "fact", "a: b d", 1, 0.9, "k1", ["e2", "e2"]), ("m2", "w", "u1", "fact", "bad", 0, 0.9, "k1", ["e1"])], item)
    from loamwork.operators import graph

    store, nodes, edges, report, keys = memory.upsert_linked(old, graph.memory_nodes(old), graph.memory_edges(old), put, spark.createDataFrame([], "request_key string"))
    assert {(r.src, r.dst) for r in edges.collect()} == {("m1", "e2")} and {(r.uri, r.type) for r in nodes.collect()} == {("m1", "Memory"), ("e2", "Entity")}
    assert store.first().text == "a: b d" and report.where("size(reasons) > 0").count() == 1 and keys.count() == 1


def test_models_rerank_and_their_failures_are_made_good(spark):
    from loamwork.operators import retrieve

    class Ends:
        def score(self, pairs):
            return [5.0 if t.endswith("end") else -5.0 for _, t in pairs]

    class Broken:
        def score(self, pairs):
            raise RuntimeError("no model")

    class Short:
        def score(self, pairs):
            return []

    rows = spark.createDataFrame([("q", "u1"), ("q", "u2"), ("q", "u3")], "qid string, uri string")
    queries = spark.createDataFrame([("q", "a b")], "qid string, query string")
    chunks = spark.createDataFrame([("u1", "a x"), ("u2", "b a end"), ("u3", None)], "uri string, text string")
    got = lambda m: {r.uri: r.raw for r in retrieve.model_scores(rows, queries, chunks, m).collect()}
    assert got(Ends()) == {"u1": -5.0, "u2": 5.0, "u3": -5.0}
    assert got(Broken()) == got(Short()) == {"u1": 0.5, "u2": 1.0, "u3": 0.0}
