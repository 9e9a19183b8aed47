"""Single operators on small inputs with results worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loamwork.functions import access, scores, text
from loamwork.operators import chunking, embedding, entities, evaluate, graph, ingest, match, memory, retrieve, route, service, vector
from loamwork.operators.filters import Filter
from loamwork.sources import files, tables
from loamwork.streaming import stateful


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_char_windows(spark):
    r = one(spark, text.char_spans(F.lit(1500)).alias("a"), text.char_spans(F.lit(0)).alias("b"), text.char_spans(F.lit(800)).alias("c"))
    assert [tuple(x) for x in r.a] == [(0, 800), (680, 1480), (1360, 1500)]
    assert r.b == [] and [tuple(x) for x in r.c] == [(0, 800)]
    with pytest.raises(ValueError):
        text.char_spans(F.lit(9), None, 5, 5)


def test_sentences_tile_and_pack(spark):
    t = "One. Two is longer! Three?\nFour"
    r = one(spark, text.sentences(F.lit(t)).alias("s"), chunking.sentence(F.lit(t), 20, 5).alias("c"))
    assert "".join(r.s) == t
    assert [tuple(x) for x in r.c] == [(0, 20), (20, 31)]


def test_code_blocks(spark):
    t = "import os\nimport re\n\nclass A:\n    x = 1\n\ndef f():\n    return 1\n"
    r = one(spark, chunking.code(F.lit(t), "python", 40, 5).alias("c"))
    assert [t[a:b] for a, b in map(tuple, r.c)] == ["import os\nimport re\n\n", "class A:\n    x = 1\n\n" + "", "def f():\n    return 1\n"] or [t[a:b] for a, b in map(tuple, r.c)] == ["import os\nimport re\n\n", "class A:\n    x = 1\n\n", "def f():\n    return 1\n"]


def test_semantic_split(spark):
    df = spark.createDataFrame([("aaaa aaaa. aaaa aaaa. 1111 2222 3333 4444.",)], "text string")
    spans = chunking.semantic(df, threshold=0.8, merge=False).first().spans
    assert [tuple(x) for x in spans] == [(0, 22), (22, 42)]
    assert [tuple(x) for x in chunking.semantic(df, threshold=0.8).first().spans] == [(0, 42)]


def test_redaction(spark):
    t = "api_key = ABCDEFGH1 secret: zzzzzzzz9 password=hunter22 mail a.b@c.org call +1 234-567-8901"
    assert one(spark, text.redact(F.lit(t)).alias("x")).x == "api_key = *** secret: *** password=*** mail *** call ***"


def test_lexical_scores(spark):
    r = one(
        spark,
        text.overlap(text.tokens(F.lit("a b  c A")), text.tokens(F.lit("B x c"))).alias("a"),
        text.overlap(text.tokens(F.lit("  ")), text.tokens(F.lit("B"))).alias("b"),
        text.memory_score(F.lit("Deploy-window x"), F.lit("the deploy is late")).alias("c"),
        text.memory_score(F.lit(" the DEPLOY "), F.lit("the deploy is late")).alias("d"),
    )
    assert (round(r.a, 6), r.b, r.c, r.d) == (round(2 / 3, 6), 0.0, 0.5, 1.0)


def test_entities_and_relations(spark):
    t = "AuthService depends on db.users and calls AuthService; nothing owns. Класс влияет на сервис"
    df = spark.createDataFrame([(t,)], "t string").withColumn("m", entities.matches(F.col("t")))
    found = df.first().m
    assert all(t[m.start : m.end] == m.alias for m in found)
    assert [m.uri for m in found][:2] == ["kb://entity/symbol:authservice", "kb://entity/symbol:depends"]
    assert "kb://entity/table:db.users" in [m.uri for m in found] and "kb://entity/term:сервис" in [m.uri for m in found]
    rel = df.select(entities.relations(F.col("t"), F.col("m")).alias("r")).first().r
    assert ("kb://entity/symbol:authservice", "DEPENDS_ON", "kb://entity/table:db.users") in [tuple(x) for x in rel]
    assert ("kb://entity/term:класс", "AFFECTS", "kb://entity/term:сервис") in [tuple(x) for x in rel]
    assert entities.find("the def ab abc", entities.Extraction()) == [(11, 14, "kb://entity/symbol:abc", "abc")]
    assert entities.Extraction(symbol_allow="(").allow("symbol") == ".*"


def test_fusion_numbers(spark):
    base = scores.linear(F.lit(0.9), F.lit(1.0), F.lit(0.5))
    total = scores.blend(base, F.lit(1.0), "linear")
    r = one(spark, base.alias("a"), total.alias("b"), scores.reranked(total, F.lit(1.0)).alias("c"), scores.unit_interval(F.lit(0.0)).alias("d"), scores.unit_interval(F.lit(-2.0)).alias("e"))
    assert [round(x, 4) for x in r] == [0.88, 0.928, 0.9496, 0.0, 0.1192]


def test_rrf_prefers_two_signals(spark):
    s = spark.createDataFrame([("q", "vector", "a", 0.9), ("q", "vector", "b", 0.5), ("q", "graph", "b", 1.0)], "qid string, signal string, uri string, score double")
    got = {r.uri: r.rrf for r in retrieve.rrf(s).collect()}
    assert got["b"] > got["a"] and round(got["a"], 6) == round(1 / 61, 6)


def test_filters_and_identity(spark):
    rows = [("a", "w", ["u"], ["t"], "s", dt.datetime(2024, 1, 2)), ("b", "w", [], ["t"], "s", dt.datetime(2024, 1, 2)), ("c", "w", ["role:r"], ["x"], "s", None), ("d", "v", ["u"], ["t"], "s", dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "uri string, workspace_id string, acl_allow array<string>, tags array<string>, source string, updated_at timestamp")
    ids = lambda f: sorted(r.uri for r in f.apply(df).collect())
    assert ids(Filter("w", "u", ("r",))) == ["a", "c"]
    assert ids(Filter("w", "u", ("r",), tags=("t", "y"))) == ["a"]
    assert ids(Filter("w", "u", ("r",), updated_after="2024-01-02T00:00:00Z")) == ["a"]
    assert ids(Filter("w", "u", ("r",), updated_after="nonsense")) == ["a", "c"]
    assert ids(Filter("w")) == []
    assert Filter("v", "x", tags=(" ",)).bound("w", "u", (" r ", "")) == Filter("w", "u", ("r",))
    assert one(spark, access.claims(F.lit('{"sub":"","workspace_id":"w"}')).alias("c")).c is None


def test_graph_walk(spark):
    e = spark.createDataFrame([("a", "CALLS", "b"), ("b", "OWNS", "c"), ("c", "CALLS", "d"), ("x", "MEMORY_REFERS_TO", "a")], "src string, rel string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcdx"], "uri string")
    seen = graph.visible_edges(e, nodes)
    assert seen.count() == 3
    seeds = spark.createDataFrame([("q", "a"), ("q", "z")], "qid string, uri string")
    assert sorted((r.uri, r.hop) for r in graph.expand(seen, seeds, 2).collect()) == [("a", 0), ("b", 1), ("c", 2), ("z", 0)]
    assert [r.uri for r in graph.expand(seen, seeds, 2, max_nodes=3).orderBy("hop", "uri").collect()] == ["a", "z", "b"]
    assert graph.explain(seen, spark.createDataFrame([("b",), ("z",)], "uri string")).orderBy("uri").collect()[0].reasons == ["vector", "CALLS a", "OWNS c"]


def test_memory_rules(spark):
    df = spark.createDataFrame([("fact", "a: b c", 1, 0.9), ("fact", "ab", 0, 0.5), ("odd", " ", 1, 0.75)], "type string, text string, n int, c double")
    got = [r.x for r in df.select(memory.reasons(F.col("type"), F.col("text"), F.col("n"), F.col("c")).alias("x")).collect()]
    assert got == [[], ["missing_citations", "low_confidence", "fact_too_short", "fact_schema_mismatch"], ["empty_text", "invalid_type"]]


def test_memory_search_falls_back(spark):
    m = spark.createDataFrame([("m1", "w", "u", "deployment is on Friday"), ("m2", "w", "v", "deployment")], "uri string, workspace_id string, subject string, text string")
    q = spark.createDataFrame([("q1", "deploy", "w", "u"), ("q2", "friday", "w", "u")], "qid string, query string, workspace_id string, subject string")
    got = sorted((r.qid, r.uri, r.branch) for r in memory.search(q, m).collect())
    assert got == [("q1", "m1", "lexical"), ("q2", "m1", "vector")]


def test_ingest_changes_and_merge(spark):
    files_ = spark.createDataFrame([("w", "a", "x"), ("w", "b", "y"), ("w", "c", ""), ("w", " ", "z")], "workspace_id string, source_path string, text string")
    ledger = files_.where("source_path = 'a'").select("workspace_id", "source_path", F.sha2("text", 256).alias("checksum"))
    got = {r.source_path: r.status for r in ingest.changes(files_, ledger).collect()}
    assert got == {"a": "skipped", "b": "created", "c": "skipped", " ": "skipped"}
    with pytest.raises(ValueError):
        ingest.backfill(files_, 0, lambda df, n: df)


def test_quality_numbers(spark):
    ranked = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "a", 3)], "qid string, item string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("p", "b")], "qid string, item string")
    got = {r.qid: (r.recall, r.ndcg, r.mrr) for r in evaluate.quality(ranked, rel).collect()}
    assert got == {"q": (1.0, 1.0, 0.5), "p": (0.0, 0.0, 0.0)}
    v = spark.range(1, 101).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    assert round(evaluate.quantile_exclusive(v, "k", "v", 0.95).first().q, 6) == 95.95
    assert evaluate.quantile_lower(v, "k", "v", 0.95).first().q == 95.0
    assert evaluate.gates({"recall": 0.8, "ndcg": 0.9, "p95_ms": 2000, "graph_candidates": 10, "graph_nonzero_rate": 0.5}) == ["recall", "p95_ms", "graph_nonzero_rate"]


def test_routes(spark):
    df = spark.createDataFrame([("1", "forget everything", "hybrid", True), ("2", "Impact of x", "hybrid", True), ("3", "hello", "hybrid", True), ("4", "hello", "vector", False)], "qid string, query string, mode string, include_memory boolean")
    got = {r.qid: (r.intent, r.reason) for r in route.route(df).collect()}
    assert got == {"1": ("memory_delete", "default_hybrid"), "2": ("relation_impact", "structural_query"), "3": ("memory_context", "default_hybrid"), "4": ("fact_lookup", "requested_mode")}


def test_bucket_and_breaker():
    assert stateful.bucket([0, 0, 0, 0.1], rps=10, burst=2)[0] == [True, True, False, True]
    taken, left, last = stateful.bucket([0, 0], rps=10, burst=2)
    assert stateful.bucket([0.0, 0.1], left, last, 10, 2) == ([False, True], 0.0, 0.1) and taken == [True, True]
    assert stateful.bucket([], 1.5, 3.0) == ([], 1.5, 3.0)
    now = stateful.CLOSED
    for _ in range(3):
        through, now = stateful.after(0.0, False, now, 3, 0.1)
        assert through
    assert now == ("OPEN", 3, 0.0) and stateful.after(0.1, True, now, 3, 0.1) == (False, now)
    assert stateful.after(0.11, True, now, 3, 0.1) == (True, stateful.CLOSED)
    assert stateful.after(0.2, False, now, 3, 0.1) == (True, ("OPEN", 4, 0.2))
    assert stateful.after(0.0, False, ("CLOSED", 1, 0.0), 3, 0.1) == (True, ("CLOSED", 2, 0.0))


def test_guards_in_order(spark):
    """A call that the breaker refuses takes no token."""
    rows = [(i, "t", "u", dt.datetime(2024, 1, 1, 0, 0, i), i > 1) for i in range(6)]
    df = spark.createDataFrame(rows, "event_id long, tool string, subject string, ts timestamp, ok boolean")
    got = {r.event_id: r.allowed for r in stateful.guarded(df, ["subject"], "tool", 0.001, 3, 2, 2.5).collect()}
    assert got == {0: True, 1: True, 4: True, 5: False}  # 2 and 3 are refused by the open breaker


class Remote:
    """Fails on batches that hold a certain text; its vectors have three components."""

    dimensions = 3

    def embed(self, texts):
        if "bad" in texts:
            raise OSError
        return [[9.0, 9.0, 9.0] for _ in texts]


def test_embedders_fall_back():
    texts = ["a", "b", "bad", "c", "d"]
    other = embedding.Fallback(384)
    by_batch = embedding.WithFallback(Remote(), other, 2).embed(texts)
    assert [v[0] == 9.0 for v in by_batch] == [True, True, False, False, True] and by_batch.shape == (5, 384)
    assert (by_batch[2] == other.one("bad")).all()
    assert (embedding.WithFallback(Remote(), other).embed(texts) == other.embed(texts)).all()
    assert embedding.WithFallback(Remote(), other).embed([]).shape == (0, 384)
    assert embedding.PRESETS["multilingual-e5-large"][2:] == ("query: ", "passage: ")


def test_lexical_search_against_all_pairs(spark, monkeypatch):
    """Blocks of queries, scopes, ties by uri and the cut to k."""
    import random

    random.seed(3)
    words = [f"w{i}" for i in range(12)]
    items = [(f"i{k:03d}", " ".join(random.choices(words, k=random.randint(0, 8))) or None, f"s{k % 3}") for k in range(120)]
    asks = [(f"q{k}", " ".join(random.choices([*words, "none"], k=random.randint(1, 6))), f"s{k % 4}") for k in range(30)] + [("empty", "", "s0"), ("null", None, "s0")]
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    q = spark.createDataFrame(asks, "qid string, query string, s string")
    x = spark.createDataFrame(items, "uri string, text string, s string").repartition(5)
    for scope in ([], ["s"]):
        want = {}
        for qid, query, s in asks:
            own = set((query or "").split())
            found = [(-len(own & set((t or "").split())) / len(own), u) for u, t, z in items if own & set((t or "").split()) and (not scope or z == s)] if own else []
            want[qid] = sorted(found)
        got = {}
        for r in vector.lexical(q, x, 4, scope).collect():
            got.setdefault(r.qid, []).append((-r.score, r.uri))
        assert {k: sorted(v) for k, v in got.items()} == {k: v[:4] for k, v in want.items() if v}
        assert sorted((r.qid, r.uri) for r in vector.lexical(q, x, None, scope).collect()) == sorted((k, u) for k, v in want.items() for _, u in v)


def test_strings_in_texts(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 2)
    strings = spark.createDataFrame([("ab",), ("b",), ("abc",), ("",), ("zz",)], "string string")
    texts = spark.createDataFrame([(1, "xabcx"), (2, "b ab"), (3, None), (4, "")], "k long, text string")
    assert sorted(tuple(r) for r in match.contained(strings, texts, ["k"]).collect()) == [(1, "ab"), (1, "abc"), (1, "b"), (2, "ab"), (2, "b")]
    assert match.contained(strings.limit(0), texts, ["k"]).count() == 0


def test_queries_in_texts(spark):
    asks = spark.createDataFrame([("1", "Red-car park"), ("2", "a b"), ("3", "zebra red"), ("4", " "), ("5", "x")], "qid string, query string")
    texts = spark.createDataFrame([(1, "the red-car park is here"), (2, "a b c"), (3, "REDcar"), (4, None)], "k long, text string")
    got = {(r.qid, r.k): r.score for r in match.containing(asks, texts, ["k"]).collect()}
    assert got == {("1", 1): 1.0, ("2", 2): 1.0, ("1", 3): 2 / 3, ("3", 1): 0.5, ("3", 3): 0.5}


def test_vector_store_checks_counts(spark):
    store = spark.createDataFrame([("a", "p", [1.0])], "uri string, payload string, vec array<double>")
    items = spark.createDataFrame([("b", "q"), ("c", "r")], "uri string, payload string")
    with pytest.raises(Exception, match="vectors and items differ"):
        vector.put(store, items, spark.createDataFrame([("b", [1.0])], "uri string, vec array<double>")).collect()


def test_report_is_written_with_its_gates(spark, tmp_path):
    ranked = spark.createDataFrame([("1", "a", 1), ("2", "b", 3), ("2", "c", 1)], "qid string, item string, rank int")
    relevant = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "z")], "qid string, item string")
    report = evaluate.benchmark(ranked, relevant, spark.createDataFrame([("2",)], "qid string"))
    missed = evaluate.write_report(report, str(tmp_path / "report"))
    r = spark.read.json(str(tmp_path / "report")).first()
    assert (r.queries, r.filtered_queries, round(r.recall, 4), r.filtered_recall, round(r.filtered_mrr, 4)) == (3, 1, 0.6667, 1.0, 0.3333)
    assert missed == ["recall", "ndcg"]


def test_identity_out_of_strict_mode_over_http(spark):
    row = lambda mode, http, h, p, s: one(spark, access.identity(mode, http, F.lit(h).cast("string"), F.lit(p).cast("string"), F.lit(s).cast("string"), F.lit("w"), F.array(F.lit("r"))).alias("x")).x
    good = '{"sub":"a","workspace_id":"w"}'
    assert (row("strict", False, None, good, None).source, row("strict_oauth", False, "bad", None, "s").source) == ("payload_jwt", "legacy_acl")
    assert row("strict_oauth", True, None, good, "s").error == "missing_bearer_token"
    assert (row("mixed", True, None, None, " ").subject, row("mixed", True, None, None, " ").workspace_id) == ("anonymous", "default")


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def job():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert stateful.with_retries(job, 3, 0.1, waits.append) == ("done", 2)
    assert waits == [0.1, 0.2]


def test_streaming_limiter_equals_batch(spark, tmp_path):
    from loamwork import session

    session.ship(spark)
    rows = [(i, i % 2, dt.datetime(2024, 1, 1, 0, 0, 0, i * 1000)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    src = str(tmp_path / "in")
    df.coalesce(1).write.parquet(src)
    q = stateful.limit(spark.readStream.schema(df.schema).parquet(src), ["user_id"], 1.0, 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.event_id, r.allowed) for r in stateful.limit(df, ["user_id"], 1.0, 3).collect()}
    assert {(r.event_id, r.allowed) for r in spark.sql("select * from limited").collect()} == want
    assert sum(a for _, a in want) == 6


def test_auto_ingest_cycles(spark, tmp_path):
    src, seen = tmp_path / "in", []
    src.mkdir()
    (src / "a.txt").write_text("hello\n")
    stream = spark.readStream.text(str(src))
    q = stateful.auto_ingest(stream, lambda df: seen.append(("full", df.count())), lambda df: seen.append(("part", df.count())), str(tmp_path / "cp"), interval=None)
    q.awaitTermination(120)
    assert seen == [("full", 1)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_bytes(b"hi \xff there")
    (tmp_path / "sub" / "b.py").write_text("x = 1")
    (tmp_path / "c.bin").write_text("no")
    root = str(tmp_path)
    got = {r.source: (r.title, r.tags, r.text) for r in files.documents(spark, root).collect()}
    assert got == {"a.MD": ("a.MD", ["ext:md"], "hi  there"), "sub/b.py": ("b.py", ["ext:py"], "x = 1")}
    assert files.documents(spark, root, include=[]).count() == 0
    assert [r.source for r in files.documents(spark, root, include=["sub/b.py", "/etc/passwd"]).collect()] == ["sub/b.py"]
    (tmp_path / "q.jsonl").write_text('{"qid":"1"}\n\n[1]\n')
    assert files.json_lines(spark, str(tmp_path / "q.jsonl"), "qid string").count() == 1
    assert files.changed(root) == []


def test_versioned_table(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    mk = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert t.read().count() == 0
    t.upsert(mk((1, "a"), (2, "b")))
    t.upsert(mk((2, "c"), (3, "d")))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert t.delete(mk((3, ""), (9, ""))) == 1
    t.vacuum()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c")]


def test_fallback_embedding(spark):
    v = embedding.Fallback(384).one("Ab 12")
    raw = [1, 1, 1, 1, 1, 2, 5, 2, 1]
    norm = sum(x * x for x in raw) ** 0.5
    assert abs(v[257] - 5 / norm) < 1e-12 and abs(v[256] - 2 / norm) < 1e-12 and not embedding.Fallback(8).one("").any()
    df = spark.createDataFrame([("x",), ("x",), (None,)], "text string")
    assert embedding.embed_column(df, "text", embedding.Fallback(8)).count() == 3


def test_tables_take_other_keys(spark, tmp_path):
    t = tables.Table(spark, f"file://{tmp_path}/entities", "uri string, workspace_id string, name string", ["uri"])
    t.upsert(spark.createDataFrame([("a", None, "x"), ("b", "w2", "y")], t.schema))
    with pytest.raises(ValueError):
        t.rekey(["uri", "workspace_id"])
    t.rekey(["uri", "workspace_id"], {"workspace_id": "w1"})
    t.rekey(["uri", "workspace_id"])
    t.upsert(spark.createDataFrame([("a", "w2", "z"), ("a", "w1", "new")], t.schema))
    assert sorted(tuple(r) for r in t.read().collect()) == [("a", "w1", "new"), ("a", "w2", "z"), ("b", "w2", "y")]


def small_knowledge_base(spark):
    acl = ["u1"]
    chunks = [
        ("kb://chunk/a_0", "kb://doc/a", "w1", acl, "s", ["t"], "ledger service calls billing", ["kb://entity/symbol:ledger"]),
        ("kb://chunk/b_0", "kb://doc/b", "w1", acl, "s", ["t"], "rollback of accounts", ["kb://entity/symbol:ledger"]),
        ("kb://chunk/c_0", "kb://doc/c", "w1", ["u2"], "s", ["t"], "ledger secrets", ["kb://entity/symbol:ledger"]),
        ("kb://chunk/d_0", "kb://doc/d", "w2", acl, "s", ["t"], "ledger elsewhere", []),
    ]
    own = spark.createDataFrame(chunks, "uri string, doc_uri string, workspace_id string, acl_allow array<string>, source string, tags array<string>, text string, entity_uris array<string>")
    own = own.withColumns({"title": F.substring("doc_uri", 10, 1), "updated_at": F.lit("2024-01-01").cast("timestamp"), "span": F.struct(F.lit(0).alias("start"), F.length("text").alias("end"))})
    aliases = F.when(F.col("uri") == "kb://entity/symbol:ledger", F.array(F.lit("accounts"))).otherwise(F.array().cast("array<string>"))
    memory = spark.createDataFrame([("m1", "w1", "u1", "fact", "ledger: key=secret password: hunter22", [("kb://chunk/b_0",)])], "uri string, workspace_id string, subject string, type string, text string, citations array<struct<chunk_uri:string>>")
    return service.KnowledgeBase(own.select("doc_uri", "title"), own, graph.mention_nodes(own).withColumn("aliases", aliases), graph.mention_edges(own), memory)


def test_search_for_a_caller(spark):
    kb = small_knowledge_base(spark)
    asks = spark.createDataFrame([("1", "ledger", "hybrid", True), ("2", "ledger", "vector", False)], "qid string, query string, mode string, include_memory boolean")
    who = Filter("w1", "u1", ())
    found, remembered, traces = service.search(asks, kb, who)
    got = {(r.qid, r.uri): r for r in found.collect()}
    assert set(got) == {("1", "kb://chunk/a_0"), ("2", "kb://chunk/a_0")}  # others are not allowed or share no token
    assert (got["1", "kb://chunk/a_0"].graph, got["2", "kb://chunk/a_0"].graph) == (1.0, 0.0)
    assert got["1", "kb://chunk/a_0"].title == "a" and got["1", "kb://chunk/a_0"].citations[0].uri == "kb://doc/a"
    assert [(r.qid, r.uri, r.text) for r in remembered.collect()] == [("1", "m1", "ledger: key=secret password: ***")]
    trace = {r.qid: r for r in traces.collect()}
    assert (trace["1"].seeds, trace["1"].graph_nonzero, trace["1"].intent) == (1, True, "memory_context") and (trace["2"].seeds, trace["2"].reason) == (0, "requested_mode")


def test_search_with_expanded_queries(spark):
    """The name's alias finds a chunk that the query's own words do not; its lexical share stays that of the query."""
    kb = small_knowledge_base(spark)
    asks = spark.createDataFrame([("1", "ledger", "hybrid", True)], "qid string, query string, mode string, include_memory boolean")
    got = {r.uri: r for r in service.search(asks, kb, Filter("w1", "u1", ()), expand=True)[0].collect()}
    assert set(got) == {"kb://chunk/a_0", "kb://chunk/b_0"}
    assert got["kb://chunk/b_0"].lexical == 0.0 and got["kb://chunk/b_0"].memory == 1.0 and got["kb://chunk/a_0"].lexical == 1.0
