"""The inverted index, exact quantiles, bounded walks and ingestion of entities, against brute force."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamwork.operators import chunking, entities, evaluate, graph, lexindex, service, vector
from loamwork.operators.filters import Filter


def test_best_of_lists_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 30))
        lists = [np.flatnonzero(rng.random(n) < p).astype(np.int32) for p in rng.choice([0.001, 0.01, 0.3, 0.9], int(rng.integers(1, 7)))]
        allowed = None if rng.random() < 0.5 else (rng.random(n) < 0.5).astype(np.int32)
        count = np.zeros(n, int)
        for x in lists:
            count[x] += 1
        if allowed is not None:
            count = count * allowed
        want = sorted(((-c, i) for i, c in enumerate(count) if c))[:k]
        at, got = lexindex.best([x for x in lists if len(x)], allowed, n, k)
        assert sorted(zip((-got).tolist(), at.tolist())) == want


def brute(queries, items, k, keep=lambda r: True):
    out = []
    for qid, query in queries:
        asked = set((query or "").lower().split())
        scored = sorted((-len(asked & set((r[1] or "").lower().split())) / max(len(asked), 1), r[0]) for r in items if keep(r))
        out += [(qid, u, -s) for s, u in scored if s < 0][:k] if asked else []
    return sorted(out)


@pytest.fixture(scope="module")
def words():
    rng = np.random.default_rng(2)
    common = [f"w{i}" for i in range(60)]
    return [(f"u{i:04}", None if i % 97 == 5 else " ".join(rng.choice(common, int(rng.integers(0, 12))).tolist() + ["All"]), f"g{i % 3}") for i in range(900)]


def test_index_against_all_pairs(spark, words, monkeypatch):
    monkeypatch.setattr(lexindex, "SHARD_ITEMS", 100)
    items = spark.createDataFrame(words, "uri string, text string, g string").withColumn("token", F.lit("x")).drop("token")
    queries = [("a", "w1 w2 w3 all"), ("b", "W7"), ("c", None), ("d", ""), ("e", "nothing"), ("f", "all")]
    asked = spark.createDataFrame(queries, "qid string, query string")
    index = vector.index(items, ["g"])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(vector.indexed(asked, index, 7)) == brute(queries, words, 7)
    assert rows(vector.lexical(asked, items, 7)) == brute(queries, words, 7)
    assert rows(vector.indexed(asked, index, 7, F.col("g") == "g1")) == brute(queries, words, 7, lambda r: r[2] == "g1")
    scoped = asked.withColumn("g", F.lit("g2"))
    assert rows(vector.indexed(scoped, index, 7, scope=["g"])) == brute(queries, words, 7, lambda r: r[2] == "g2")
    assert vector.indexed(asked.limit(0), index, 7).count() == 0 and vector.lexical(asked, items.limit(0), 3).count() == 0


def test_index_updates(spark, words):
    items = spark.createDataFrame(words, "uri string, text string, g string")
    index = vector.index(items, ["g"])
    fresh = [("u0001", "w1 w2 w3 new", "g9"), ("v1", "w1 w2", "g9")]
    after = lexindex.updated(index, spark.createDataFrame([("u0002",), ("u0003",)], "uri string"), spark.createDataFrame(fresh, "uri string, text string, g string"), vector._words("text", 1))
    kept = [r for r in words if r[0] not in ("u0001", "u0002", "u0003")] + fresh
    queries = [("a", "w1 w2 w3 all"), ("n", "new")]
    got = vector.indexed(spark.createDataFrame(queries, "qid string, query string"), after, 9)
    assert sorted(tuple(r) for r in got.collect()) == brute(queries, kept, 9)


def test_values_at_ranks(spark):
    rng = np.random.default_rng(3)
    wild = [float(x) for x in rng.normal(size=500) * 10.0 ** rng.integers(-30, 30, 500)]
    ends = [float("inf"), -float("inf"), float("nan"), 0.0, -0.0, 1e-320, 5.0] * 3
    by = {"a": wild, "b": [float(i % 4) for i in range(200)], "c": [1.5] * 90, "e": ends, None: [float(i) for i in range(50)]}
    df = spark.createDataFrame([(k, v) for k, vs in by.items() for v in vs] + [("d", None)], "k string, x double")
    rank = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.95))
    for most in (4, 1000):
        got = {(r.k, r.which): r.v for r in evaluate.at_ranks(df, "k", "x", [rank, F.lit(1)], most).collect()}
        for k, vs in by.items():
            s = sorted(vs, key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
            for which, want in ((0, s[math.ceil(len(s) * 0.95) - 1]), (1, s[0])):
                found = got.pop((k, which))
                assert found == want or (math.isnan(found) and math.isnan(want))
        assert not got
    assert evaluate.quantile_lower(df.limit(0), "k", "x", 0.5).count() == 0


def test_walks_are_cut_at_each_step_as_a_whole_walk_would_be(spark):
    rng = np.random.default_rng(4)
    edges = [(f"n{a}", "CALLS", f"n{b}") for a, b in rng.integers(0, 60, (120, 2))] + [("n0", "CALLS", f"n{i}") for i in range(40)]
    seeds = [("q1", "n0"), ("q2", "n7"), ("q2", "n8"), ("q3", "nowhere")]
    near = {}
    for a, _, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    df = spark.createDataFrame(edges, "src string, rel string, dst string")
    for depth, most in ((1, 5), (3, 10), (4, 1000), (2, 1)):
        want = set()
        for q in ("q1", "q2", "q3"):
            hop = {u: 0 for p, u in seeds if p == q}
            front = set(hop)
            for h in range(1, depth + 1):
                front = {v for u in front for v in near.get(u, ())} - set(hop)
                hop |= {u: h for u in front}
            want |= {(q, u, h) for h, u in sorted((h, u) for u, h in hop.items())[:most]}
        assert {tuple(r) for r in graph.expand(df, spark.createDataFrame(seeds, "qid string, uri string"), depth, most).collect()} == want


FILE = "workspace_id string, source_path string, title string, source string, tags array<string>, acl_allow array<string>, updated_at timestamp, text string"


def files(spark, **texts):
    return spark.createDataFrame([("w", path, path, "s", ["t"], ["u1"], datetime(2024, 1, 1), text) for path, text in texts.items()], FILE)


def test_ingestion_names_entities_as_they_are_written(spark):
    store, _ = service.ingest_files(files(spark, b="Gamma calls ALPHA. alpha Ваза", a="Alpha depends on core.orders; alpha ALPHA"), service.empty_store(spark), chunking.spans)
    by = {r.uri: r for r in store.nodes.where("type = 'Entity'").collect()}
    alpha = by["kb://entity/symbol:alpha"]
    assert (alpha.name, alpha.aliases, alpha.canonical_key) == ("Alpha", ["Alpha", "alpha", "ALPHA"], "symbol:alpha")
    assert by["kb://entity/table:core.orders"].aliases == ["core.orders"] and by["kb://entity/term:ваза"].aliases == ["Ваза", "ваза"]
    edges = {(r.src, r.rel, r.dst) for r in store.edges.collect()}
    assert ("kb://entity/symbol:gamma", "CALLS", "kb://entity/symbol:alpha") in edges
    assert {d for s, r, d in edges if r == "MENTIONS"} == set(by) and not any("Column" in x for e in edges for x in e)


def test_what_files_no_longer_say_goes_unless_others_say_it(spark):
    store = service.ingest_files(files(spark, a="alpha calls beta", b="alpha calls beta", c="delta owns beta"), service.empty_store(spark), chunking.spans)[0].written()
    relations = lambda s: {(r.src[19:], r.rel, r.dst[19:]) for r in s.edges.where(F.col("rel").isin(graph.RELATIONS)).collect()}
    assert relations(store) == {("alpha", "CALLS", "beta"), ("delta", "OWNS", "beta")}
    second = service.ingest_files(files(spark, a="gamma owns delta", c="nothing stated here"), store, chunking.spans)[0].written()
    assert relations(second) == {("alpha", "CALLS", "beta"), ("gamma", "OWNS", "delta")}
    third = service.ingest_files(files(spark, b="x"), second, chunking.spans)[0]
    assert relations(third) == {("gamma", "OWNS", "delta")}
    ends = {r.dst for r in third.edges.where("rel = 'MENTIONS'").collect()}
    assert "kb://entity/symbol:alpha" not in ends and "kb://entity/symbol:gamma" in ends
    assert third.nodes.where("uri = 'kb://entity/symbol:alpha'").count() == 1  # entities stay


def test_what_was_known_of_an_entity_stays(spark):
    known = spark.createDataFrame([("kb://entity/symbol:alpha", "Entity", "The alpha", "w", ["u9"], "own key", ["Omega", " "])], service.empty_store(spark).nodes.schema)
    store = service.Store(**{**service.empty_store(spark).__dict__, "nodes": known})
    node = service.ingest_files(files(spark, a="Alpha"), store, chunking.spans)[0].nodes.where("uri = 'kb://entity/symbol:alpha'").first()
    assert (node.name, node.canonical_key, node.aliases, node.acl_allow) == ("The alpha", "own key", ["Omega", "Alpha", "alpha"], ["u1", "u9"])


def test_search_on_an_ingested_store_with_expansion(spark):
    store = service.ingest_files(files(spark, a="Alpha depends on Beta", b="Omega stands alone", c="Beta only"), service.empty_store(spark), chunking.spans)[0]
    nodes = store.nodes.withColumn("aliases", F.when(F.col("uri") == "kb://entity/symbol:alpha", F.array(F.lit("omega"))).otherwise(F.col("aliases")))
    store = service.Store(**{**store.__dict__, "nodes": nodes}).written()
    memory = spark.createDataFrame([], "uri string, workspace_id string, subject string, text string, citations array<struct<chunk_uri:string>>")
    asks = spark.createDataFrame([("q", "alpha", "hybrid", False)], "qid string, query string, mode string, include_memory boolean")
    titles = lambda **o: {r.title for r in service.search(asks, store.knowledge_base(memory), Filter("w", "u1"), **o)[0].collect()}
    assert titles() == {"a"} and titles(expand=True) == {"a", "b"}
    assert service.search(asks, store.knowledge_base(memory), Filter("w", "stranger"))[0].count() == 0


def test_first_spellings_over_chunks(spark):
    rows = [("w", "b", 0, "beta Beta"), ("w", "a", 1, "BETA"), ("w", "a", 0, "x bEta")]
    got = entities.aliases(spark.createDataFrame(rows, "workspace_id string, source_path string, chunk_idx int, text string")).first()
    assert got.aliases == ["bEta", "beta", "BETA", "Beta"]
