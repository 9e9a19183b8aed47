"""Queries over ingestion, memory, evaluation, routing, identity, metrics and stateful operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.catalog import query
from loamwork.functions import access, scores, text
from loamwork.operators import evaluate, ingest, match, memory, retrieve, route, service, vector
from loamwork.plans.catalog_kb import STRINGS, asked, chunks, docs
from loamwork.plans.sqltext import CHUNKS, HITS, KB, QUERIES, tokens
from loamwork.sources import tables
from loamwork.streaming import live, stateful

NEXT = KB + ", nextv AS (SELECT workspace_id, source_path, doc_id, text, CASE WHEN doc_id%7=0 THEN text||' edited' WHEN doc_id%11=0 THEN '' ELSE text END AS ntext FROM kb), ledger AS (SELECT workspace_id, source_path, sha256(text) AS checksum FROM kb WHERE doc_id%5<>0), st AS (SELECT n.*, CASE WHEN ntext='' OR coalesce(sha256(ntext)=checksum, false) THEN 'skipped' WHEN checksum IS NULL THEN 'created' ELSE 'updated' END AS status FROM nextv n LEFT JOIN ledger USING (workspace_id, source_path))"


def _changed(spark: SparkSession, d: str) -> DataFrame:
    old, n = docs(spark, d), F.col("doc_id")
    ledger = old.where(n % 5 != 0).select("workspace_id", "source_path", F.sha2("text", 256).alias("checksum"))
    now = old.withColumn("text", F.when(n % 7 == 0, F.concat("text", F.lit(" edited"))).when(n % 11 == 0, "").otherwise(F.col("text")))
    return ingest.changes(now, ledger)


@query("checksum_diff_counts", f"WITH {NEXT} SELECT workspace_id, count_if(status='created') AS created, count_if(status='updated') AS updated, count_if(status='skipped') AS skipped FROM st GROUP BY 1")
def checksum_diff_counts(spark, d):
    return ingest.counters(_changed(spark, d), "workspace_id")


@query("dry_run_counts", f"WITH {NEXT} SELECT count_if(status='created') AS created, count_if(status='updated') AS updated, count_if(status='skipped') AS skipped FROM st")
def dry_run_counts(spark, d):
    return ingest.counters(_changed(spark, d))


@query(
    "doc_identity",
    f"WITH {KB} SELECT doc_id, CASE WHEN doc_id%4=0 THEN substr(sha1(source_path),1,16) ELSE doc_key END AS doc_key, sha256(text) AS checksum FROM kb",
)
def doc_identity(spark, d):
    files = docs(spark, d).select("doc_id", "workspace_id", "source_path", "text")
    known = files.where(F.col("doc_id") % 4 == 0).select(F.substring(F.sha1("source_path"), 1, 16).alias("doc_key"), "workspace_id")
    return ingest.doc_identity(files, known).select("doc_id", "doc_key", F.sha2("text", 256).alias("checksum"))


@query(
    "stale_chunks",
    f"WITH {CHUNKS} SELECT uri FROM chunks WHERE doc_id%3=0 AND chunk_idx*680 >= length(text) + 0 AND chunk_idx > 0 UNION SELECT uri FROM chunks WHERE doc_id%3=0 AND chunk_idx > 0",
)
def stale_chunks(spark, d):
    """Every third document shrinks to its first chunk."""
    old = chunks(spark, d)
    new = old.where((F.col("doc_id") % 3 != 0) | (F.col("chunk_idx") == 0))
    return ingest.stale(old, new)


@query(
    "entity_merge",
    """WITH a AS (SELECT 'e'||s_suppkey AS uri, s_name AS name, [s_name, 'old'||(s_suppkey%3)] AS aliases FROM supplier WHERE s_suppkey%3<>0), b AS (SELECT 'e'||s_suppkey AS uri, s_name AS name, ['old'||(s_suppkey%2), 'new'] AS aliases FROM supplier WHERE s_suppkey%4<>0)
SELECT coalesce(a.uri,b.uri) AS uri, coalesce(a.name,b.name) AS name, array_to_string(CASE WHEN a.uri IS NULL THEN b.aliases WHEN b.uri IS NULL THEN a.aliases ELSE list_concat(a.aliases, list_filter(b.aliases, lambda x: NOT list_contains(a.aliases, x))) END, ',') AS aliases FROM a FULL JOIN b USING (uri)""",
)
def entity_merge(spark, d):
    s, k = session.table(spark, d, "supplier"), F.col("s_suppkey")
    row = lambda df, aliases: df.select(F.concat(F.lit("e"), k.cast("string")).alias("uri"), F.lit("w").alias("workspace_id"), F.col("s_name").alias("name"), aliases.alias("aliases"), F.array(F.lit("u")).alias("acl_allow"))
    a = row(s.where(k % 3 != 0), F.array("s_name", F.concat(F.lit(" old"), (k % 3).cast("string"))))
    b = row(s.where(k % 4 != 0), F.array(F.concat(F.lit("old"), (k % 2).cast("string")), F.lit("new "), F.lit(" ")))
    return ingest.merge_entities(a, b).select("uri", "name", F.array_join("aliases", ",").alias("aliases"))


@query("upsert_last_writer", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n=1")
def upsert_last_writer(spark, d):
    rows = ingest.last_writer(session.table(spark, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id"))
    return rows.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query(
    "table_upsert",
    "SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN 'X' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey%5<>0 OR o_orderkey%3=0",
)
def table_upsert(spark, d):
    """Rows of multiples of 3 are put in place of, or added to, a table without the multiples of 5."""
    o = session.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return ingest.upsert(o.where(F.col("o_orderkey") % 5 != 0), o.where(F.col("o_orderkey") % 3 == 0).withColumn("status", F.lit("X")), ["o_orderkey"])


@query(
    "resource_reads",
    f"WITH {KB} SELECT k.doc_uri||CASE WHEN doc_id%10=0 THEN 'x' ELSE '' END AS uri, CASE WHEN doc_id%10=0 OR workspace_id<>'w1' THEN 'NOT_FOUND' WHEN list_has_any(acl_allow, ['u1','role:reader']) THEN 'OK' ELSE 'PERMISSION_DENIED' END AS status FROM kb k",
)
def resource_reads(spark, d):
    t = docs(spark, d)
    want = t.select(F.concat("doc_uri", F.when(F.col("doc_id") % 10 == 0, "x").otherwise("")).alias("uri"))
    who = access.principals(F.lit("u1"), F.array(F.lit("reader")))
    return tables.resource(t.withColumnRenamed("doc_uri", "uri"), want, "w1", who, "doc").select("uri", "status")


TURNS = """turns AS (SELECT 'kb://memory/'||conv_id||'_'||turn AS uri, 'w'||(conv_id%2) AS workspace_id, 'u'||(conv_id%3) AS subject,
  CASE role WHEN 'user' THEN 'fact' WHEN 'assistant' THEN 'summary' ELSE 'note' END AS type, CASE WHEN turn%2=0 THEN 'Fact: '||text ELSE text END AS text, turn%3 AS n_citations, 0.5+(turn%5)/8.0 AS confidence, 'k'||conv_id AS request_key, conv_id FROM conversations)"""
WHY = """list_filter([CASE WHEN trim(text)='' THEN 'empty_text' END, CASE WHEN type NOT IN ('summary','fact','decision','preference') THEN 'invalid_type' END, CASE WHEN n_citations<=0 THEN 'missing_citations' END,
  CASE WHEN confidence<0.75 THEN 'low_confidence' END, CASE WHEN type='fact' AND len(list_filter(regexp_split_to_array(trim(text),'\\s+'), lambda w: w<>''))<3 THEN 'fact_too_short' END, CASE WHEN type='fact' AND NOT contains(text,':') AND NOT contains(text,'=') THEN 'fact_schema_mismatch' END], lambda x: x IS NOT NULL)""".replace("\\\\", "\\")


def turns(spark: SparkSession, d: str) -> DataFrame:
    c, n, role = F.col("conv_id"), F.col("turn"), F.col("role")
    return session.table(spark, d, "conversations").select(
        F.concat_ws("_", F.concat(F.lit("kb://memory/"), c.cast("string")), n.cast("string")).alias("uri"),
        F.concat(F.lit("w"), (c % 2).cast("string")).alias("workspace_id"),
        F.concat(F.lit("u"), (c % 3).cast("string")).alias("subject"),
        F.when(role == "user", "fact").when(role == "assistant", "summary").otherwise("note").alias("type"),
        F.when(n % 2 == 0, F.concat(F.lit("Fact: "), "text")).otherwise(F.col("text")).alias("text"),
        (n % 3).alias("n_citations"),
        (0.5 + (n % 5) / 8.0).alias("confidence"),
        F.concat(F.lit("k"), c.cast("string")).alias("request_key"),
        c,
    )


@query("memory_validate", f"WITH {TURNS} SELECT uri, array_to_string({WHY}, ',') AS reasons FROM turns")
def memory_validate(spark, d):
    why = memory.reasons(F.col("type"), F.col("text"), F.col("n_citations"), F.col("confidence"))
    return turns(spark, d).select("uri", F.array_join(why, ",").alias("reasons"))


@query(
    "memory_upsert_idempotent",
    f"WITH {TURNS} SELECT uri, subject, type FROM turns WHERE len({WHY})=0 AND conv_id%4<>0 UNION ALL SELECT uri, subject, 'old' FROM turns WHERE turns.conv_id%6=0 AND NOT (len({WHY})=0 AND conv_id%4<>0)",
)
def memory_upsert_idempotent(spark, d):
    t = turns(spark, d)
    store = t.where(F.col("conv_id") % 6 == 0).withColumn("type", F.lit("old")).select("uri", "workspace_id", "subject", "type", "text")
    ledger = t.where(F.col("conv_id") % 4 == 0).select("request_key").distinct()
    return memory.upsert(store, t, ledger)[0].select("uri", "subject", "type")


@query(
    "memory_search",
    f"""WITH {TURNS}, q AS (SELECT 'q'||item_id AS qid, CASE WHEN item_id%4=3 THEN regexp_replace(text, '(\\S{{2,3}})\\S*', '\\1', 'g') ELSE text END AS query, 'w'||(item_id%2) AS workspace_id, 'u'||(item_id%3) AS subject FROM benchmark),
a AS (SELECT qid, len(w) AS n, workspace_id, subject, unnest(w) AS token FROM (SELECT *, {tokens('query')} AS w FROM q)),
h AS (SELECT uri, workspace_id, subject, unnest({tokens('text')}) AS token FROM turns),
s AS (SELECT qid, uri, count(*)/any_value(n) AS score, 'vector' AS branch FROM a JOIN h USING (token, workspace_id, subject) GROUP BY qid, uri),
e AS (SELECT qid, lower(trim(query)) AS q, list_distinct(list_filter(regexp_split_to_array(replace(lower(trim(query)),'-',' '), '\\s+'), lambda x: length(x)>1)) AS w, workspace_id, subject FROM q WHERE qid NOT IN (SELECT qid FROM s)),
f AS (SELECT qid, uri, CASE WHEN contains(lower(trim(text)), q) THEN 1.0 WHEN len(w)=0 THEN 0.0 ELSE len(list_filter(w, lambda x: contains(lower(trim(text)), x)))/len(w) END AS score, 'lexical' AS branch FROM e JOIN turns USING (workspace_id, subject) WHERE q <> '' AND trim(text) <> '')
SELECT qid, uri, round(score,6) AS score, branch FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS r FROM (SELECT * FROM s UNION ALL SELECT * FROM f WHERE score > 0)) WHERE r<=10""",
)
def memory_search(spark, d):
    n = F.substring("qid", 2, 20).cast("long")
    q = asked(spark, d).withColumns({"workspace_id": F.concat(F.lit("w"), (n % 2).cast("string")), "subject": F.concat(F.lit("u"), (n % 3).cast("string"))})
    # every fourth query is cut to parts of its words, which no token equals, so that the fallback answers
    q = q.withColumn("query", F.when(n % 4 == 3, F.regexp_replace("query", r"(\S{2,3})\S*", "$1")).otherwise(F.col("query")))
    return memory.search(q, turns(spark, d)).select("qid", "uri", F.round("score", 6).alias("score"), "branch")


@query("memory_delete", f"WITH {TURNS} SELECT uri, substr(text,1,100) AS preview, workspace_id='w1' AND subject='u2' AS deleted FROM turns")
def memory_delete(spark, d):
    t = turns(spark, d)
    gone = memory.owned(t, "w1", "u2")
    left = memory.delete(t, gone)
    return memory.preview(gone).withColumn("deleted", F.lit(True)).unionByName(memory.preview(left).withColumn("deleted", F.lit(False)))


@query(
    "memory_bonus",
    f"WITH {TURNS}, c AS (SELECT uri AS muri, 'c'||(conv_id%20) AS chunk, length(text)%100/100.0 AS score FROM turns) SELECT 'q' AS qid, chunk AS uri, max(score) AS memory FROM c GROUP BY chunk",
)
def memory_bonus(spark, d):
    t = turns(spark, d).withColumn("citations", F.array(F.struct(F.concat(F.lit("c"), (F.col("conv_id") % 20).cast("string")).alias("chunk_uri"))))
    hits = t.select(F.lit("q").alias("qid"), "uri", ((F.length("text") % 100) / 100.0).alias("score"))
    return memory.chunk_bonus(hits, t)


@query(
    "confirm_tokens",
    "WITH a AS (SELECT o_custkey AS token, o_orderdate AS at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n FROM orders), t AS (SELECT o_custkey AS token, min(o_orderdate) AS issued_at FROM orders WHERE o_custkey%3<>0 GROUP BY 1) SELECT a.token, a.at, coalesce(epoch_us(a.at)-epoch_us(issued_at) <= 300000000, false) AND n=1 AS accepted FROM a LEFT JOIN t USING (token)",
)
def confirm_tokens(spark, d):
    o = session.table(spark, d, "orders").select(F.col("o_custkey").alias("token"), F.col("o_orderdate").alias("at"))
    issued = o.where(F.col("token") % 3 != 0).groupBy("token").agg(F.min("at").alias("issued_at"))
    return memory.confirm(issued, o)


RELEVANT = """first AS (SELECT qid, doc_uri AS item, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS rank FROM hits JOIN chunks USING (uri) GROUP BY qid, doc_uri),
rel AS (SELECT 'q'||item_id AS qid, doc_uri AS item FROM benchmark b JOIN kb ON contains(kb.text, b.text)), n AS (SELECT qid, count(*) AS n FROM rel GROUP BY 1),
hit AS (SELECT f.qid, rank FROM first f JOIN rel USING (qid, item)),
p AS (SELECT qid, count_if(rank<=10) AS found, sum(CASE WHEN rank<=10 THEN CASE WHEN rank=1 THEN 1.0 ELSE 1/log2(rank) END END) AS dcg, min(rank) AS f FROM hit GROUP BY 1),
i AS (SELECT qid, n, 1.0 + coalesce((SELECT sum(1/log2(r)) FROM range(2, 11) t(r) WHERE r <= n), 0) AS ideal FROM n),
per AS (SELECT qid, coalesce(found/n, 0) AS recall, coalesce(dcg/ideal, 0) AS ndcg, coalesce(1.0/f, 0) AS mrr FROM i LEFT JOIN p USING (qid))"""


def ranked_and_relevant(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by the rank of their best chunk; relevant are those in which the item's whole text stands."""
    q, c = asked(spark, d), chunks(spark, d)
    hits = vector.top(vector.lexical(q, c, 20), 20, F.desc("score"), F.col("uri")).join(c.select("uri", "doc_uri"), "uri")
    best = hits.groupBy("qid", "doc_uri").agg(F.min("rank").alias("rank"))
    ranked = vector.top(best.withColumnRenamed("rank", "best"), 20, F.col("best")).select("qid", F.col("doc_uri").alias("item"), "rank")
    held = match.contained(q.select(F.col("query").alias("string")), docs(spark, d).select("doc_uri", "text"), ["doc_uri"])
    return ranked, held.join(q, held["string"] == q["query"]).select("qid", F.col("doc_uri").alias("item"))


@query("recall_ndcg_mrr", f"WITH {HITS}, {RELEVANT} SELECT qid, round(recall,6) AS recall, round(ndcg,6) AS ndcg, round(mrr,6) AS mrr FROM per")
def recall_ndcg_mrr(spark, d):
    out = evaluate.quality(*ranked_and_relevant(spark, d))
    return out.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")])


@query(
    "evaluation_report",
    f"WITH {HITS}, {RELEVANT} SELECT count(*) AS queries, count_if(f) AS filtered_queries, "
    + ", ".join(f"round(avg({c}),6) AS {c}, round(coalesce(avg({c}) FILTER (WHERE f),0),6) AS filtered_{c}" for c in ("recall", "ndcg", "mrr"))
    + " FROM (SELECT *, CAST(substr(qid, 2) AS INT)%3=0 AS f FROM per)",
)
def evaluation_report(spark, d):
    ranked, relevant = ranked_and_relevant(spark, d)
    some = asked(spark, d).where(F.substring("qid", 2, 20).cast("int") % 3 == 0)
    out = evaluate.benchmark(ranked, relevant, some)
    return out.select("queries", "filtered_queries", *[F.round(c, 6).alias(c) for p in ("", "filtered_") for c in (f"{p}recall", f"{p}ndcg", f"{p}mrr")])


@query("citation_coverage", f"WITH {KB} SELECT round(count_if(doc_id%4<>0)/greatest(1,count(*)), 6) AS coverage FROM kb")
def citation_coverage(spark, d):
    cite = F.when(F.col("doc_id") % 4 != 0, F.array("doc_uri")).otherwise(F.array().cast(STRINGS))
    return evaluate.coverage(docs(spark, d).select(cite.alias("citations"))).select(F.round("coverage", 6).alias("coverage"))


@query(
    "p95_exclusive",
    """WITH r AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL),
p AS (SELECT *, greatest(1.0, least(n, 0.95*(n+1))) AS place FROM r)
SELECT event_type, round(sum(CASE WHEN r=floor(place) THEN v*(1-(place-floor(place))) WHEN r=floor(place)+1 THEN v*(place-floor(place)) END), 6) AS q FROM p GROUP BY 1""",
)
def p95_exclusive(spark, d):
    return evaluate.quantile_exclusive(session.table(spark, d, "events"), "event_type", "value", 0.95).select("event_type", F.round("q", 6).alias("q"))


@query("p95_nearest_lower", "SELECT event_type, round(list_sort(list(value))[CAST(floor(0.95*(count(*)-1)) AS INT)+1], 6) AS q FROM events WHERE value IS NOT NULL GROUP BY 1")
def p95_nearest_lower(spark, d):
    return evaluate.quantile_lower(session.table(spark, d, "events"), "event_type", "value", 0.95).select("event_type", F.round("q", 6).alias("q"))


@query("counters_by_label", "SELECT event_type, user_id%10 AS label, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def counters_by_label(spark, d):
    rows = stateful.counters(session.table(spark, d, "events").withColumn("label", F.col("user_id") % 10), "event_type", "label")
    return rows.withColumn("total", F.round("total", 4))


@query("latency_histogram", "SELECT event_type, le, count_if(value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 25.0, 100.0, 500.0])::DOUBLE AS le) GROUP BY 1, 2")
def latency_histogram(spark, d):
    return evaluate.histogram(session.table(spark, d, "events"), "event_type", "value", [1, 5, 25, 100, 500])


@query("graph_nonzero_rate", "SELECT event_type, round(count_if(value > 50)/count(*), 6) AS rate FROM events GROUP BY 1")
def graph_nonzero_rate(spark, d):
    rows = evaluate.rate(session.table(spark, d, "events").withColumn("hit", F.col("value") > 50), "hit", "rate", "event_type")
    return rows.select("event_type", F.round("rate", 6).alias("rate"))


@query("audit_hash", """SELECT event_id, sha256('{"event_type":"'||event_type||'","user_id":'||user_id||'}') AS params_hash FROM events""")
def audit_hash(spark, d):
    return service.audit(session.table(spark, d, "events"), ["user_id", "event_type"], "event_id")


ASK = "q AS (SELECT conv_id, turn, text||CASE conv_id%6 WHEN 0 THEN ' Delete memory' WHEN 1 THEN ' explain relevance' WHEN 2 THEN ' Impact of it' WHEN 3 THEN ' remember' ELSE '' END AS t, turn%2=0 AS m FROM conversations)"
INTENT = "CASE WHEN regexp_matches(lower(t), 'forget everything|delete memory|remove memory|forget what you know') THEN 'memory_delete' WHEN regexp_matches(lower(t), 'explain relevance|why this result') THEN 'explainability' WHEN regexp_matches(lower(t), 'dependency|impact|path') THEN 'relation_impact' WHEN m OR regexp_matches(lower(t), 'what did we decide|my context|remember') THEN 'memory_context' ELSE 'fact_lookup' END"


def _asks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id") % 6
    more = F.when(k == 0, " Delete memory").when(k == 1, " explain relevance").when(k == 2, " Impact of it").when(k == 3, " remember").otherwise("")
    return session.table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", more).alias("query"), (F.col("turn") % 2 == 0).alias("include_memory"), F.when(F.col("turn") % 5 == 0, "vector").otherwise("hybrid").alias("mode"))


@query("route_intent", f"WITH {ASK} SELECT conv_id, turn, {INTENT} AS intent, CASE WHEN turn%5=0 THEN 'requested_mode' WHEN regexp_matches(lower(t), 'dependency|path|impact') THEN 'structural_query' ELSE 'default_hybrid' END AS reason FROM q")
def route_intent(spark, d):
    return _asks(spark, d).select("conv_id", "turn", route.intent(F.col("query"), F.col("include_memory")).alias("intent"), route.reason(F.col("query"), F.col("mode")).alias("reason"))


@query(
    "execution_plan",
    f"""WITH {ASK}, r AS (SELECT conv_id, turn, {INTENT} AS intent FROM q), p(intent, step, tool) AS (VALUES ('memory_delete',1,'kb_memory_delete'),('explainability',1,'kb_search'),('explainability',2,'kb_explain'),('relation_impact',1,'kb_search'),('relation_impact',2,'kb_graph_expand'),('memory_context',1,'kb_memory_search'),('memory_context',2,'kb_search'),('fact_lookup',1,'kb_search'))
SELECT conv_id, turn, step, tool, CASE tool WHEN 'kb_graph_expand' THEN conv_id%4=0 WHEN 'kb_explain' THEN conv_id%3=0 WHEN 'kb_memory_delete' THEN true ELSE false END AS skipped FROM r JOIN p USING (intent)""",
)
def execution_plan(spark, d):
    steps = route.route(_asks(spark, d).withColumn("qid", F.struct("conv_id", "turn")))
    have = _asks(spark, d).select(F.struct("conv_id", "turn").alias("qid"), (F.col("conv_id") % 4).alias("seeds"), (F.col("conv_id") % 3).alias("uris"), F.lit(False).alias("allowed"))
    return route.executed(steps, have).select("qid.conv_id", "qid.turn", "step", "tool", "skipped")


@query(
    "principals",
    "SELECT c_custkey, array_to_string(list_concat(CASE WHEN c_custkey%4=0 THEN [] ELSE ['u'||c_custkey] END, ['role:'||lower(c_mktsegment)]), ',') AS who FROM customer",
)
def principals(spark, d):
    subject = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("c_custkey").cast("string")))
    who = access.principals(subject, F.array(F.concat(F.lit(" "), F.lower("c_mktsegment")), F.lit("  ")))
    return session.table(spark, d, "customer").select("c_custkey", F.array_join(who, ",").alias("who"))


@query(
    "jwt_claims",
    """SELECT c_custkey, CASE WHEN c_custkey%5=0 THEN NULL ELSE 'u'||c_custkey END AS subject, CASE WHEN c_custkey%5=0 THEN NULL ELSE 'w'||(c_custkey%3) END AS workspace_id, CASE WHEN c_custkey%5=0 THEN NULL WHEN c_custkey%2=0 THEN 'a,b' ELSE 'r' END AS roles, CASE WHEN c_custkey%2=0 THEN 'read,write' ELSE 'all' END AS scopes FROM customer""",
)
def jwt_claims(spark, d):
    k = F.col("c_custkey")
    s = k.cast("string")
    even = F.concat(F.lit('{"sub":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), s)), F.lit('","workspace_id":"w'), (k % 3).cast("string"), F.lit('","roles":["a","b"],"scope":"read  write"}'))
    odd = F.concat(F.lit('{"sub":"'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("u"), s)), F.lit('","workspace":"w'), (k % 3).cast("string"), F.lit('","realm_access":{"roles":["r"]},"scp":["all"," "]}'))
    payload = F.when(k % 2 == 0, even).otherwise(odd)
    c = access.claims(payload)
    return session.table(spark, d, "customer").select("c_custkey", c["subject"].alias("subject"), c["workspace_id"].alias("workspace_id"), F.when(c.isNotNull(), F.array_join(c["roles"], ",")).alias("roles"), F.array_join(access.scopes(payload), ",").alias("scopes"))


@query("normalize_time", "SELECT event_id, CASE event_id%4 WHEN 3 THEN NULL WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('second', ts) END AS at FROM events")
def normalize_time(spark, d):
    k, base = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    value = F.when(k == 0, F.concat(base, F.lit("Z"))).when(k == 1, base).when(k == 2, F.concat(base, F.lit("+02:00"))).otherwise("not a time")
    return session.table(spark, d, "events").select("event_id", text.utc(value).alias("at"))


@query("result_coercion", "SELECT event_id, CASE event_id%3 WHEN 0 THEN event_id WHEN 1 THEN 0 ELSE 0 END AS n FROM events")
def result_coercion(spark, d):
    k = F.col("event_id") % 3
    value = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, "many")
    return session.table(spark, d, "events").select("event_id", text.as_count(value).alias("n"))


@query("csv_parse", "SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' '||p_name||' ,, '||p_brand||',', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM part")
def csv_parse(spark, d):
    value = F.concat(F.lit(" "), "p_name", F.lit(" ,, "), "p_brand", F.lit(","))
    return session.table(spark, d, "part").select("p_partkey", F.array_join(text.csv_list(value), "|").alias("items"))


@query("path_allowlist", f"WITH {KB} SELECT doc_id, source_path = 'doc/1' OR starts_with(source_path, 'doc/1/') OR starts_with(source_path||'/x', 'doc/2/') AS ok FROM kb")
def path_allowlist(spark, d):
    path = F.when(F.col("doc_id") == 2, F.concat("source_path", F.lit("/x"))).otherwise(F.col("source_path"))
    return docs(spark, d).select("doc_id", access.path_allowed(path, ["doc/1", "doc/2/"]).alias("ok"))


@query("fit_dimensions", "SELECT vec_id, len(v) AS n, round(list_sum(v), 5) AS total FROM (SELECT vec_id, CAST(embedding AS DOUBLE[])[1:32+vec_id%40] AS w, CASE WHEN len(w)<64 THEN list_concat(w, list_transform(range(64-len(w)), lambda i: 0.0::DOUBLE)) ELSE w[1:64] END AS v FROM embeddings)")
def fit_dimensions(spark, d):
    w = F.slice(F.col("embedding").cast("array<double>"), F.lit(1), (32 + F.col("vec_id") % 40).cast("int"))
    v = scores.fit_dimensions(w, 64)
    return session.table(spark, d, "embeddings").select("vec_id", F.size(v).cast("long").alias("n"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(
    "seed_collectors",
    f"WITH {HITS} SELECT qid, string_agg(uri, ',' ORDER BY rank) AS uris FROM hits WHERE rank <= 5 GROUP BY qid",
)
def seed_collectors(spark, d):
    hits = vector.top(vector.lexical(asked(spark, d), chunks(spark, d), 20), 20, F.desc("score"), F.col("uri"))
    return retrieve.result_uris(hits, 5).select("qid", F.array_join("uris", ",").alias("uris"))


@query(
    "backfill_counts",
    "SELECT c_custkey, len(c_name||' '||c_mktsegment) AS chars, count(*) OVER () AS indexed, (SELECT count(*) FROM customer) AS seen, (SELECT count_if(c_custkey%9=0) FROM customer) AS skipped FROM customer WHERE c_custkey%9<>0",
)
def backfill_counts(spark, d):
    """Customers as entities, every ninth without text: component 257 of the unscaled vector is the number of characters."""
    from loamwork.operators import embedding, entities

    c, k = session.table(spark, d, "customer"), F.col("c_custkey")
    rows = c.select("c_custkey", entities.search_text(F.when(k % 9 != 0, F.col("c_name")), F.when(k % 9 != 0, F.array("c_mktsegment"))).alias("search_text"))
    made, counts = ingest.backfill(rows, 500, lambda df, n: embedding.embed_column(df, "search_text", embedding.Fallback(384), batch=n))
    chars = F.round(F.get("embedding", F.lit(257)) / F.get("embedding", F.lit(256)) * F.size(F.split("search_text", " "))).cast("long")
    return made.select("c_custkey", chars.alias("chars")).join(F.broadcast(counts))


@query("health", f"WITH {QUERIES} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM queries) AS queries, 'ok' AS status")
def health(spark, d):
    n = lambda t, name: session.table(spark, d, t).agg(F.count(F.lit(1)).alias(name))
    return n("documents", "documents").join(n("benchmark", "queries")).withColumn("status", F.lit("ok"))


@query(
    "token_bucket",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts)/1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, t, CAST(1.0 AS DOUBLE) AS kept, true AS allowed FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, t, CASE WHEN level >= 1 THEN level - 1 ELSE level END, level >= 1 FROM (SELECT e.*, least(2.0, w.kept + greatest(0, e.t - w.t) * 0.001)::DOUBLE AS level FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, user_id, allowed FROM w""",
)
def token_bucket(spark, d):
    e = session.table(spark, d, "events").select("event_id", "user_id", "ts")
    return stateful.limit(e, ["user_id"], rps=0.001, burst=2).select("event_id", "user_id", "allowed")


@query(
    "circuit_breaker",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type <> 'error' AS ok, epoch_us(ts)/1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, true AS allowed, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failed, CAST(0 AS DOUBLE) AS since FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, go, CASE WHEN NOT go THEN state WHEN ok THEN 'CLOSED' WHEN failed + 1 >= 2 THEN 'OPEN' ELSE state END, CASE WHEN NOT go THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN NOT go THEN since WHEN ok THEN 0 WHEN failed + 1 >= 2 THEN t ELSE since END
  FROM (SELECT e.*, w.state, w.failed, w.since, NOT (w.state = 'OPEN' AND e.t - w.since <= 3600) AS go FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
SELECT event_id, user_id, allowed, state FROM w""",
)
def circuit_breaker(spark, d):
    e = session.table(spark, d, "events").select("event_id", "event_type", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return stateful.breaker(e, "user_id", failures=2, seconds=3600).select("event_id", "user_id", "allowed", "state")


@query(
    "guarded_calls",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type <> 'error' AS ok, epoch_us(ts)/1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT user_id, n, event_id, t, true AS allowed, 'CLOSED' AS state, CASE WHEN ok THEN 0 ELSE 1 END AS failed, CAST(0 AS DOUBLE) AS since FROM e WHERE n = 1
  UNION ALL SELECT user_id, n, event_id, t, go, CASE WHEN NOT go THEN state WHEN ok THEN 'CLOSED' WHEN failed + 1 >= 2 THEN 'OPEN' ELSE state END, CASE WHEN NOT go THEN failed WHEN ok THEN 0 ELSE failed + 1 END, CASE WHEN NOT go THEN since WHEN ok THEN 0 WHEN failed + 1 >= 2 THEN t ELSE since END
  FROM (SELECT e.*, w.state, w.failed, w.since, NOT (w.state = 'OPEN' AND e.t - w.since <= 90000) AS go FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)),
g AS (SELECT user_id, event_id, t, row_number() OVER (PARTITION BY user_id ORDER BY n) AS k FROM w WHERE allowed),
b AS (SELECT user_id, k, event_id, t, CAST(0.0 AS DOUBLE) AS kept, true AS allowed FROM g WHERE k = 1
  UNION ALL SELECT user_id, k, event_id, t, CASE WHEN level >= 1 THEN level - 1 ELSE level END, level >= 1 FROM (SELECT g.*, least(1.0, b.kept + greatest(0, g.t - b.t) * 0.00001)::DOUBLE AS level FROM b JOIN g ON g.user_id = b.user_id AND g.k = b.k + 1))
SELECT event_id, user_id, allowed FROM b""",
)
def guarded_calls(spark, d):
    """The breaker of each user first, then the user's bucket for what the breaker lets through."""
    e = session.table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return stateful.guarded(e, ["user_id"], "user_id", 0.00001, 1, 2, 90000).select("event_id", "user_id", "allowed")


@query("idempotency_once", "SELECT user_id, event_type FROM events GROUP BY ALL")
def idempotency_once(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return stateful.once(session.table(spark, d, "events").withColumn("request_key", key)).select("user_id", "event_type")


def _streamed(spark: SparkSession, rows: DataFrame, make) -> DataFrame:
    """What a stream gives of rows that come in two halves of their time, each read by a start of its own on one checkpoint."""
    source, out, checkpoint = (session.fresh_path(spark, x) for x in ("stream-in", "stream-out", "stream-checkpoint"))
    middle = rows.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5)).first()[0]
    halves = rows.withColumn("half", (F.unix_micros(F.col("ts").cast("timestamp")) > middle).cast("int"))
    for half in (0, 1):
        halves.where(F.col("half") == half).drop("half").write.mode("append").parquet(source)
        live.run(make(spark.readStream.schema(rows.schema).parquet(source)), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_idempotent",
    """WITH RECURSIVE e AS (SELECT event_id, event_type||(user_id%20) AS key, ts, row_number() OVER (PARTITION BY event_type||(user_id%20) ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT key, i, event_id, event_id AS answer_of, ts AS since FROM e WHERE i = 1 UNION ALL
  SELECT e.key, e.i, e.event_id, CASE WHEN e.ts - p.since > INTERVAL 12 HOUR THEN e.event_id ELSE p.answer_of END, CASE WHEN e.ts - p.since > INTERVAL 12 HOUR THEN e.ts ELSE p.since END FROM p JOIN e ON e.key = p.key AND e.i = p.i + 1)
SELECT key, event_id, answer_of FROM p""",
)
def stream_idempotent(spark, d):
    """Requests by a stream that is started twice: which request answers each."""
    e = session.table(spark, d, "events").select("event_id", "ts", F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("request_key"))
    return _streamed(spark, e, lambda s: live.answer(s, "request_key", 12 * 3600)).select("key", "event_id", "answer_of")


@query(
    "stream_confirmations",
    """WITH RECURSIVE e AS (SELECT event_id, 'u'||(user_id%40) AS key, ts, event_type IN ('signup','view') AS issue, row_number() OVER (PARTITION BY user_id%40 ORDER BY ts, event_id) AS i FROM events),
p AS (SELECT key, i, event_id, CASE WHEN issue THEN ts END AS since, false AS used, CASE WHEN NOT issue THEN false END AS accepted FROM e WHERE i = 1 UNION ALL
  SELECT e.key, e.i, e.event_id, CASE WHEN issue THEN e.ts ELSE p.since END, CASE WHEN issue THEN false ELSE p.used OR coalesce(e.ts - p.since <= INTERVAL 6 HOUR, false) END, CASE WHEN NOT issue THEN coalesce(NOT p.used AND e.ts - p.since <= INTERVAL 6 HOUR, false) END FROM p JOIN e ON e.key = p.key AND e.i = p.i + 1)
SELECT key, event_id, accepted FROM p""",
)
def stream_confirmations(spark, d):
    """Views issue a token of the user, all else confirms it, by a stream that is started twice."""
    kind = F.when(F.col("event_type").isin("signup", "view"), live.ISSUE).otherwise(live.CONFIRM)
    e = session.table(spark, d, "events").select("event_id", "ts", F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("token"), kind.alias("kind"))
    return _streamed(spark, e, lambda s: live.confirmations(s, "token", 6 * 3600)).select("key", "event_id", "accepted")


@query(
    "health_parts",
    f"""WITH {KB} SELECT 'docs' AS part, 'ok' AS status, (SELECT count(*) FROM kb) AS n UNION ALL SELECT 'memory', 'ok', (SELECT count(*) FROM conversations) UNION ALL SELECT 'edges', 'error', NULL UNION ALL SELECT 'all', 'degraded', NULL""",
)
def health_parts(spark, d):
    """Health of a store one of whose tables can't be read."""
    absent = lambda: spark.read.parquet(f"{d}/absent.parquet")
    found = service.health(spark, {"docs": lambda: docs(spark, d), "memory": lambda: session.table(spark, d, "conversations"), "edges": absent})
    return found.select("part", "status", "n")
