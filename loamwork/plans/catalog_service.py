"""Queries over whole calls: search for a caller, ingestion, stores, identity, statuses."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.catalog import query
from loamwork.functions import access, scores
from loamwork.operators import chunking, graph, ingest, memory, retrieve, service, vector
from loamwork.operators.entities import Extraction
from loamwork.operators.filters import Filter
from loamwork.plans.catalog_graph import MENTIONS, mentions
from loamwork.plans.catalog_kb import REDACT_SQL, SENTENCE_SQL, STRINGS, asked, chunks, docs
from loamwork.plans.catalog_ops import INTENT, TURNS, WHY, turns
from loamwork.plans.sqltext import CHUNKS, KB, QUERIES, STOP, SYMBOLS, tokens
from loamwork.sources import files, tables

CALLER = Filter("w1", "u1", ("reader",))
SEES = "workspace_id='w1' AND list_has_any(acl_allow, ['u1','role:reader'])"
QUERY_TOKENS = "list_filter(regexp_extract_all(lower(query), '[A-Za-zА-Яа-яЁё0-9_]{3,}'), lambda w: w NOT IN ('the','and','with','from','that','this','for','are','mode','query','graph'))"

SEARCH_SQL = f"""WITH {MENTIONS}, {QUERIES}, {TURNS},
allowed AS (SELECT * FROM mentioned WHERE {SEES}),
asked AS (SELECT qid, len(words) AS n, unnest(words) AS token FROM (SELECT qid, {tokens('query')} AS words FROM queries)),
have AS (SELECT uri, unnest({tokens('text')}) AS token FROM allowed),
lexical AS (SELECT qid, uri, count(*)/any_value(n) AS score FROM have JOIN asked USING (token) GROUP BY qid, uri),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS rank FROM lexical) WHERE rank <= 20),
own AS (SELECT uri AS muri, conv_id, unnest({tokens('text')}) AS token FROM turns WHERE workspace_id='w1' AND subject='u1'),
mscore AS (SELECT qid, muri, conv_id, count(*)/any_value(n) AS score FROM own JOIN asked USING (token) WHERE CAST(substr(qid, 2) AS INT)%2=0 GROUP BY qid, muri, conv_id),
mtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, muri) AS r FROM mscore) WHERE r <= 5),
bonus AS (SELECT qid, 'kb://chunk/'||substr(sha1('w'||(conv_id%3)||':doc/'||conv_id),1,16)||'_0' AS uri, max(score) AS memory FROM mtop GROUP BY 1, 2),
ents AS (SELECT DISTINCT unnest(entity_uris) AS uri FROM allowed),
words AS (SELECT DISTINCT qid, unnest({QUERY_TOKENS}) AS w FROM queries WHERE CAST(substr(qid, 2) AS INT)%5<>0),
named AS (SELECT DISTINCT qid, uri FROM words JOIN ents ON contains(replace(uri, 'kb://entity/', ''), w)),
seeds AS (SELECT qid, uri FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY uri) AS n FROM named) WHERE n <= 20),
said AS (SELECT DISTINCT uri, doc_uri, unnest(entity_uris) AS e FROM allowed),
near AS (SELECT qid, uri, 0 AS hop FROM seeds UNION SELECT qid, said.uri, 1 FROM seeds JOIN said ON e = seeds.uri UNION SELECT qid, doc_uri, 1 FROM seeds JOIN said ON e = seeds.uri),
reached AS (SELECT qid, uri FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, uri) AS n FROM near) WHERE n <= 200),
fused AS (SELECT h.qid, h.uri, score AS vector, CASE WHEN g.uri IS NULL THEN 0.0 ELSE 1.0 END AS graph, coalesce(m.memory, 0.0) AS memory FROM hits h LEFT JOIN reached g USING (qid, uri) LEFT JOIN bonus m USING (qid, uri)),
scored AS (SELECT *, 0.7*(0.6*(0.7*vector+0.2*graph+0.1*memory)+0.4*vector)+0.3*vector AS score FROM fused),
best AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS rank FROM scored QUALIFY rank <= 10)"""


def knowledge_base(spark: SparkSession, d: str) -> service.KnowledgeBase:
    """The tables as ingestion leaves them: written once, then searched."""
    own = session.written(mentions(spark, d), "kb-chunks")
    return service.KnowledgeBase(docs(spark, d).select("doc_uri", "title"), own, session.written(graph.mention_nodes(own), "kb-nodes"), session.written(graph.mention_edges(own), "kb-edges"), _cited(spark, d))


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as memory, each citing the first chunk of a document."""
    n = F.col("conv_id")
    chunk = F.concat(F.lit("kb://chunk/"), F.substring(F.sha1(F.concat(F.lit("w"), (n % 3).cast("string"), F.lit(":doc/"), n.cast("string"))), 1, 16), F.lit("_0"))
    return turns(spark, d).withColumn("citations", F.array(F.struct(chunk.alias("chunk_uri"))))


def _requests(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring("qid", 2, 20).cast("int")
    return asked(spark, d).select("qid", "query", F.when(n % 5 == 0, "vector").otherwise("hybrid").alias("mode"), (n % 2 == 0).alias("include_memory"))


@query(
    "kb_search",
    SEARCH_SQL + f""" SELECT qid, uri, coalesce(title, 'Unknown') AS title, sha256({REDACT_SQL.format('c.text')}) AS snippet_sha, c.doc_uri AS cited, len(c.entity_uris) AS n_entities, round(vector,6) AS vector, graph, round(memory,6) AS memory, round(score,6) AS score, rank FROM best JOIN allowed c USING (uri)""",
)
def kb_search(spark, d):
    """The benchmark's texts, asked by one caller: every fifth by similarity alone, every second with memory."""
    found = service.search(_requests(spark, d), knowledge_base(spark, d), CALLER, fallback=False)[0]
    cite = F.get("citations", F.lit(0))
    return found.select("qid", "uri", "title", F.sha2("snippet", 256).alias("snippet_sha"), cite["uri"].alias("cited"), F.size("entities").cast("long").alias("n_entities"), F.round("vector", 6).alias("vector"), "graph", F.round("memory", 6).alias("memory"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "kb_search_traces",
    SEARCH_SQL
    + f""", t AS (SELECT qid, query AS t, CAST(substr(qid, 2) AS INT)%2=0 AS m, CAST(substr(qid, 2) AS INT)%5=0 AS v FROM queries)
SELECT qid, {INTENT} AS intent, CASE WHEN v THEN 'requested_mode' WHEN regexp_matches(lower(t), 'dependency|path|impact') THEN 'structural_query' ELSE 'default_hybrid' END AS reason,
 (SELECT count(*) FROM seeds s WHERE s.qid=t.qid) AS seeds, (SELECT count(*) FROM reached s WHERE s.qid=t.qid) AS reached, (SELECT count(*) FROM best s WHERE s.qid=t.qid AND graph>0) AS graph_bonus, (SELECT count(*) FROM best s WHERE s.qid=t.qid AND graph>0) > 0 AS graph_nonzero,
 (SELECT count(*) FROM mtop s WHERE s.qid=t.qid) AS memory_hits FROM t""",
)
def kb_search_traces(spark, d):
    _, hits, traces = service.search(_requests(spark, d), knowledge_base(spark, d), CALLER, fallback=False)
    remembered = hits.where("branch = 'vector'").groupBy("qid").agg(F.count(F.lit(1)).alias("memory_hits"))
    return traces.join(remembered, "qid", "left").fillna(0, ["memory_hits"]).select("qid", "intent", "reason", "seeds", "reached", "graph_bonus", "graph_nonzero", "memory_hits")


@query(
    "expand_from_entities",
    f"""WITH {MENTIONS}, {QUERIES}, ents AS (SELECT DISTINCT unnest(entity_uris) AS uri FROM mentioned WHERE {SEES}), named AS (SELECT uri, replace(uri, 'kb://entity/symbol:', '') AS name FROM ents),
a AS (SELECT qid, len(w) AS n, unnest(w) AS token FROM (SELECT qid, {tokens('query')} AS w FROM queries)),
s AS (SELECT qid, uri, name, 1.0/n AS score, row_number() OVER (PARTITION BY qid ORDER BY uri) AS rank FROM a JOIN named ON name = token QUALIFY rank <= 12)
SELECT qid, count(*) AS candidates, count_if(score >= 0.04) AS strong, min(name) AS first FROM s GROUP BY qid""",
)
def expand_from_entities(spark, d):
    """Candidates of query expansion among the entities that a caller sees."""
    nodes = graph.visible(graph.mention_nodes(mentions(spark, d)), CALLER.workspace_id, access.principals(F.lit("u1"), F.array(F.lit("reader"))))
    ents = nodes.where("type = 'Entity'").withColumn("aliases", F.array().cast(STRINGS))
    hits = retrieve.entity_hits(asked(spark, d), ents)
    return hits.groupBy("qid").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("score") >= 0.04).alias("strong"), F.min("name").alias("first"))


IDENTITY_SQL = """WITH c AS (SELECT c_custkey AS k, c_custkey%4 AS h, c_custkey%3 AS p, c_custkey%5 AS l FROM customer)
SELECT k, mode, CASE WHEN mode='strict' THEN CASE h WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'authorization_header' END ELSE CASE WHEN h>=2 THEN 'authorization_header' WHEN p=2 THEN 'payload_jwt' WHEN l>0 THEN 'legacy_acl' ELSE 'anonymous' END END AS source,
 CASE WHEN mode='strict' THEN CASE h WHEN 0 THEN 'missing_bearer_token' WHEN 1 THEN 'invalid_bearer_token' END END AS error,
 CASE WHEN h>=2 THEN 'h'||k WHEN mode='strict' THEN NULL WHEN p=2 THEN 'p'||k WHEN l>0 THEN 'l'||k ELSE 'anonymous' END AS subject
FROM c, (VALUES ('strict'), ('mixed')) m(mode)"""


@query("identity_precedence", IDENTITY_SQL)
def identity_precedence(spark, d):
    """Customers with a good, an invalid or no token in header and payload, and with or without stated identity; in two modes over HTTP."""
    c, k = session.table(spark, d, "customer"), F.col("c_custkey")
    token = lambda who: F.concat(F.lit('{"sub":"' + who), k.cast("string"), F.lit('","workspace_id":"w","roles":["r"]}'))
    header = F.when(k % 4 >= 2, token("h")).when(k % 4 == 1, "broken")
    payload = F.when(k % 3 == 2, token("p")).when(k % 3 == 1, "{}")
    stated = F.when(k % 5 > 0, F.concat(F.lit("l"), k.cast("string")))
    out = None
    for mode in ("strict", "mixed"):
        who = access.identity(mode, True, header, payload, stated, F.lit("w"), F.array().cast(STRINGS))
        rows = c.select(k.alias("k"), F.lit(mode).alias("mode"), who["source"].alias("source"), who["error"].alias("error"), who["subject"].alias("subject"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "chunk_dispatch",
    f"WITH c AS (SELECT doc_id, count(*) AS n, sum(span_end) AS ends FROM (WITH {CHUNKS} SELECT doc_id, span_end FROM chunks) GROUP BY 1), s AS (SELECT doc_id, count(*) AS n, sum(span_end) AS ends FROM ({SENTENCE_SQL}) GROUP BY 1) "
    "SELECT 'char' AS mode, doc_id, n, CAST(ends AS BIGINT) AS ends FROM c UNION ALL SELECT 'unknown', doc_id, n, CAST(ends AS BIGINT) FROM c UNION ALL SELECT 'sentence', doc_id, n, CAST(ends AS BIGINT) FROM s",
)
def chunk_dispatch(spark, d):
    out = None
    for mode in ("char", "sentence", "unknown"):
        rows = chunking.spans(session.table(spark, d, "documents"), mode).select("doc_id", F.explode("spans").alias("s"))
        per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s.end").alias("ends")).select(F.lit(mode).alias("mode"), "doc_id", "n", "ends")
        out = per if out is None else out.unionByName(per)
    return out


CODE_SQL = r"""WITH RECURSIVE l AS (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM (SELECT page_id, list_filter(regexp_extract_all(html, '[^\n]*\n|[^\n]+$'), lambda x: x <> '') AS p FROM pages)),
o AS (SELECT page_id, i, line, sum(length(line)) OVER w - length(line) AS a, sum(length(line)) OVER w AS b, lag(line) OVER w AS prev FROM l WINDOW w AS (PARTITION BY page_id ORDER BY i)),
f AS (SELECT *, sum(CASE WHEN i = 1 OR (regexp_replace(prev, '\s', '', 'g') = '' AND regexp_replace(line, '\s', '', 'g') <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS block FROM o),
g AS (SELECT page_id, block, CAST(min(a) AS BIGINT) AS a, CAST(max(b) AS BIGINT) AS b, regexp_replace(string_agg(line, '' ORDER BY i), '\s', '', 'g') = '' AS blank FROM f GROUP BY 1, 2),
kept AS (SELECT page_id, block, a, b FROM (SELECT *, block = max(block) OVER (PARTITION BY page_id) AS final FROM g) WHERE NOT (final AND blank AND b - a <= 800)),
cut AS (SELECT page_id, block, a, b, unnest(range(0, 1 + greatest(0, CAST(ceil((b-a-800)/680.0) AS INT)))) AS k FROM kept),
s AS (SELECT page_id, a + k*680 AS a, least(b, a + k*680 + 800) AS b, row_number() OVER (PARTITION BY page_id ORDER BY block, k) AS i FROM cut),
p AS (SELECT page_id, i, a AS start, b FROM s WHERE i = 1 UNION ALL SELECT s.page_id, s.i, CASE WHEN s.a = p.b AND s.b - p.start <= 800 THEN p.start ELSE s.a END, s.b FROM p JOIN s ON s.page_id = p.page_id AND s.i = p.i + 1)
SELECT page_id, start AS span_start, max(b) AS span_end FROM p GROUP BY page_id, start"""


@query("chunk_code", CODE_SQL)
def chunk_code(spark, d):
    """Markup as code: blocks after blank lines."""
    rows = chunking.spans(session.table(spark, d, "pages").withColumn("path", F.lit("page.html")), "code", "html", "path").select("page_id", F.explode("spans").alias("s"))
    return rows.select("page_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"))


@query(
    "vector_upsert",
    "SELECT vec_id AS uri, CASE WHEN vec_id%3=0 THEN 'new' ELSE 'old' END AS payload, round(CASE WHEN vec_id%3=0 THEN -1 ELSE 1 END * CAST(embedding AS DOUBLE[])[1], 6) AS first FROM embeddings WHERE vec_id%5<>0 OR vec_id%3=0",
)
def vector_upsert(spark, d):
    """Items of multiples of 3 with negated vectors are put into a store without the multiples of 5."""
    e = session.table(spark, d, "embeddings").select(F.col("vec_id").alias("uri"), F.lit("old").alias("payload"), F.col("embedding").cast("array<double>").alias("vec"))
    items = e.where(F.col("uri") % 3 == 0)
    after = vector.put(e.where(F.col("uri") % 5 != 0), items.select("uri", F.lit("new").alias("payload")), items.select("uri", F.transform("vec", lambda x: -x).alias("vec")))
    return after.select("uri", "payload", F.round(F.get("vec", F.lit(0)), 6).alias("first"))


@query(
    "vector_delete",
    "WITH x AS (SELECT vec_id AS uri, vec_id%4=0 AND label%2=0 AS gone FROM embeddings) SELECT uri, (SELECT count(*) FROM x WHERE gone) AS deleted FROM x WHERE NOT gone",
)
def vector_delete(spark, d):
    """Of the named ids those that also pass the filter go."""
    e = session.table(spark, d, "embeddings").select(F.col("vec_id").alias("uri"), "label")
    left, n = vector.remove(e, e.where(F.col("uri") % 4 == 0), F.col("label") % 2 == 0)
    return left.select("uri").join(F.broadcast(n))


@query(
    "relation_nodes",
    "WITH r AS (SELECT 's'||l_suppkey AS src, 'p'||l_partkey AS dst FROM lineitem WHERE l_linenumber <= 2 AND l_quantity <= 40) SELECT 's'||s_suppkey AS uri, 'Supplier' AS type FROM supplier UNION SELECT src, 'Entity' FROM r WHERE src NOT IN (SELECT 's'||s_suppkey FROM supplier) UNION SELECT dst, 'Entity' FROM r",
)
def relation_nodes(spark, d):
    """Parts become entities by what is stated of them; suppliers are there before."""
    n = F.col("l_linenumber")
    line = session.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.when(n == 1, "CALLS").when(n == 2, "OWNS").otherwise("KNOWS").alias("rel"), F.when(F.col("l_quantity") > 40, " ").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("dst"), F.lit("w").alias("workspace_id"), F.array(F.lit("u")).alias("acl_allow"))
    known = session.table(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uri"), F.lit("Supplier").alias("type"), F.col("s_name").alias("name"), F.lit("w").alias("workspace_id"), F.array(F.lit("u")).alias("acl_allow"))
    return graph.relation_nodes(line, known).select("uri", "type")


@query(
    "memory_graph",
    f"WITH {TURNS} SELECT uri AS src, 'MEMORY_REFERS_TO' AS rel, 'kb://entity/symbol:'||type AS dst, subject AS acl FROM turns UNION ALL SELECT uri, 'MEMORY_REFERS_TO', 'kb://entity/symbol:memory', subject FROM turns",
)
def memory_graph(spark, d):
    items = turns(spark, d).withColumn("entity_uris", F.array(F.concat(F.lit("kb://entity/symbol:"), "type"), F.lit("kb://entity/symbol:memory")))
    nodes = graph.memory_nodes(items).select(F.col("uri").alias("src"), F.get("acl_allow", F.lit(0)).alias("acl"))
    return graph.memory_edges(items).select("src", "rel", "dst").join(nodes, "src")


INGEST_SQL = f"""WITH old AS (SELECT * FROM documents WHERE doc_id%4<>0), {KB}, now AS (SELECT * REPLACE (CASE WHEN doc_id%6=1 THEN substr(text, 1, 900) WHEN doc_id%10=0 THEN '' ELSE text END AS text) FROM kb),
st AS (SELECT *, CASE WHEN text='' THEN 'skipped' WHEN doc_id%4=0 THEN 'created' WHEN text=(SELECT o.text FROM kb o WHERE o.doc_id=now.doc_id) THEN 'skipped' ELSE 'updated' END AS status FROM now),
final AS (SELECT doc_id, doc_key, CASE WHEN s.status='skipped' THEN kb.text ELSE s.text END AS text FROM kb JOIN st s USING (doc_id, doc_key) WHERE doc_id%4<>0 OR s.status='created')"""


def _state(spark: SparkSession, d: str) -> tuple[DataFrame, service.Store]:
    """Files, of which some have shrunk or become empty, and the store of what was ingested of them before (all but every fourth)."""
    n = F.col("doc_id")
    whole = docs(spark, d)
    before = whole.where(n % 4 != 0)
    own = mentions(spark, d).where(n % 4 != 0)
    store = service.Store(
        before.select("doc_uri", "doc_key", "workspace_id", "title", "source_path"),
        own.select("uri", "doc_uri", "workspace_id", "text", "span", "entity_uris"),
        graph.mention_nodes(own),
        graph.mention_edges(own),
        before.select("workspace_id", "source_path", F.sha2("text", 256).alias("checksum")),
    )
    rows = whole.withColumn("text", F.when(n % 6 == 1, F.substring("text", 1, 900)).when(n % 10 == 0, "").otherwise(F.col("text"))).drop("doc_uri", "doc_key")
    return rows, store


def _ingested(spark: SparkSession, d: str, only: DataFrame | None = None) -> tuple[service.Store, DataFrame]:
    rows, store = _state(spark, d)
    return service.ingest_files(rows, store, chunking.spans, only)


@query(
    "ingest_filesystem",
    INGEST_SQL + """, numbered AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text)-800)/680.0) AS INT)))) AS i FROM final WHERE length(text) > 0)
SELECT 'kb://chunk/'||doc_key||'_'||i AS uri, sha256(substr(text, i*680+1, 800)) AS text_sha, CAST(i*680 AS INT) AS span_start FROM numbered""",
)
def ingest_filesystem(spark, d):
    """All chunks after files have come, changed, shrunk and become empty."""
    return _ingested(spark, d)[0].chunks.select("uri", F.sha2("text", 256).alias("text_sha"), F.col("span.start").alias("span_start"))


@query("ingest_counters", INGEST_SQL + " SELECT count_if(status='created') AS created, count_if(status='updated') AS updated, count_if(status='skipped') AS skipped FROM st")
def ingest_counters(spark, d):
    return _ingested(spark, d)[1]


@query(
    "ingest_graph",
    INGEST_SQL + f""", numbered AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text)-800)/680.0) AS INT)))) AS i FROM final WHERE length(text) > 0),
held AS (SELECT 'kb://chunk/'||doc_key||'_'||i AS uri, 'kb://doc/'||doc_key AS doc_uri FROM numbered)
SELECT doc_uri AS src, 'CONTAINS' AS rel, count(*) AS n FROM held GROUP BY 1""",
)
def ingest_graph(spark, d):
    """Edges from documents to chunks after the same files: none leads to a chunk that is gone."""
    edges = _ingested(spark, d)[0].edges.where("rel = 'CONTAINS'")
    return edges.groupBy("src", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("ingest_changed", INGEST_SQL + ", part AS (SELECT * FROM st WHERE doc_id%3=0) SELECT count_if(status='created') AS created, count_if(status='updated') AS updated, count_if(status='skipped') AS skipped FROM part")
def ingest_changed(spark, d):
    """The same, of a list of changed paths alone."""
    changed = docs(spark, d).where(F.col("doc_id") % 3 == 0).select("source_path")
    return _ingested(spark, d, changed)[1]


@query("ingest_ledger", INGEST_SQL + " SELECT 'doc/'||doc_id AS source_path, sha256(text) AS checksum FROM final")
def ingest_ledger(spark, d):
    return _ingested(spark, d)[0].ledger.select("source_path", "checksum")


@query(
    "ingest_statuses",
    """WITH r AS (SELECT event_id, 'w'||(user_id%40) AS ws, event_id%5<>0 AS ok, ts FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY ws, ok ORDER BY ts, event_id) AS n FROM r),
s AS (SELECT event_id, CASE WHEN NOT ok THEN 'PERMISSION_DENIED' WHEN n > 1 OR ws IN ('w1','w2') THEN 'CONFLICT' ELSE 'OK' END AS status FROM f)
SELECT event_id, status, status='OK' AS ok, CASE WHEN status<>'OK' THEN status END AS error_code, status='CONFLICT' AS recoverable, CASE WHEN status='CONFLICT' THEN 'retry_later' ELSE 'none' END AS next_action FROM s""",
)
def ingest_statuses(spark, d):
    e = session.table(spark, d, "events")
    root = F.when(F.col("event_id") % 5 != 0, "data/docs/a").otherwise("etc")
    asks = e.select(F.col("event_id").alias("request_id"), F.concat(F.lit("w"), (F.col("user_id") % 40).cast("string")).alias("workspace_id"), root.alias("root"), F.col("ts").alias("at"))
    running = spark.createDataFrame([("w1",), ("w2",)], "workspace_id string")
    out = service.ingest_statuses(asks, running, ["data/docs"])
    return out.select(F.col("request_id").alias("event_id"), "status", service.contract(F.col("status")).alias("c")).select("event_id", "status", "c.*")


@query(
    "cycle_summary",
    """WITH r AS (SELECT CASE o_orderkey%7 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN o_orderkey%2=0 THEN 'full' ELSE 'git_diff' END AS method, o_orderkey%3+1 AS attempts, o_orderkey%11 AS created, o_custkey%13 AS updated FROM orders)
SELECT CAST(sum(created) FILTER (WHERE status='ok') AS BIGINT) AS created, CAST(sum(updated) FILTER (WHERE status='ok') AS BIGINT) AS updated, count_if(status='ok') AS processed_roots, count_if(status='skipped') AS skipped_roots, count_if(status='failed') AS failed_roots, count_if(status='ok' AND method='git_diff') AS git_diff_roots, count_if(status='ok' AND method='full') AS full_roots, count_if(status='ok' AND attempts>1) AS retried_roots FROM r""",
)
def cycle_summary(spark, d):
    k = F.col("o_orderkey")
    rows = session.table(spark, d, "orders").select(F.when(k % 7 == 0, "skipped").when(k % 7 == 1, "failed").otherwise("ok").alias("status"), F.when(k % 2 == 0, "full").otherwise("git_diff").alias("method"), (k % 3 + 1).alias("attempts"), (k % 11).alias("created"), (F.col("o_custkey") % 13).alias("updated"))
    return service.cycle_summary(rows)


@query(
    "memory_deleted",
    f"WITH {TURNS}, m AS (SELECT count(*) AS n FROM turns WHERE workspace_id='w1' AND subject='u2'), v AS (SELECT count(*) AS n FROM turns WHERE workspace_id='w1' AND subject='u2' AND conv_id%4<>1) SELECT least((SELECT n FROM m), (SELECT n FROM v)) AS deleted",
)
def memory_deleted(spark, d):
    """A quarter of the items has no vector: what counts as deleted is what both stores had."""
    t = turns(spark, d)
    gone = memory.owned(t, "w1", "u2")
    vectors = vector.remove(t.where(F.col("conv_id") % 4 != 1), gone, F.col("workspace_id") == "w1")[1]
    return memory.deleted_count(vectors, gone.agg(F.count(F.lit(1)).alias("deleted")))


@query(
    "metadata_lists",
    f"WITH {TURNS}, {CHUNKS} SELECT 'memory' AS kind, uri FROM turns WHERE workspace_id='w0' AND subject='u1' UNION ALL SELECT 'chunk', uri FROM chunks WHERE doc_id%50=0",
)
def metadata_lists(spark, d):
    mine = tables.of_owner(turns(spark, d), "w0", "u1").select(F.lit("memory").alias("kind"), "uri")
    some = docs(spark, d).where(F.col("doc_id") % 50 == 0)
    return mine.unionByName(tables.of_documents(chunks(spark, d), some).select(F.lit("chunk").alias("kind"), "uri"))


@query(
    "fusion_weights",
    "SELECT l_orderkey, l_linenumber, round(0.5*l_discount*10 + 0.3*l_tax*10 + 0.2*l_quantity/50, 6) AS base FROM lineitem",
)
def fusion_weights(spark, d):
    """Linear fusion with a caller's weights."""
    base = scores.linear(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 50, (0.5, 0.3, 0.2))
    return session.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(base, 6).alias("base"))



@query(
    "explain_mentions",
    f"WITH {MENTIONS}, m AS (SELECT DISTINCT uri, unnest(entity_uris) AS e FROM mentioned), top AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY e) AS n FROM m) SELECT c.uri, 'vector'||coalesce(','||r, '') AS reasons FROM chunks c LEFT JOIN (SELECT uri, string_agg('MENTIONS '||e, ',' ORDER BY n) AS r FROM top WHERE n <= 5 GROUP BY uri) g USING (uri)",
)
def explain_mentions(spark, d):
    """What chunks mention, the first five each: as edges of one kind are ordered by their ends, no others of a chunk need to become edges."""
    own = mentions(spark, d)
    first = F.slice(F.sort_array(F.array_distinct("entity_uris")), 1, 5)
    edges = graph.mention_edges(own.withColumn("entity_uris", first)).where("rel = 'MENTIONS'")
    return graph.explain(edges, own.select("uri"), 5).select("uri", F.array_join("reasons", ",").alias("reasons"))


@query("filter_ids", f"WITH {KB} SELECT doc_id, doc_uri FROM kb WHERE {SEES} AND source_path IN ('doc/1','doc/4','doc/10','doc/16','doc/22')")
def filter_ids(spark, d):
    """Named ids of those that a caller may see."""
    f = Filter(ids=("doc/1", "doc/4", "doc/10", "doc/16", "doc/22")).bound("w1", "u1", ("reader",))
    return f.apply(docs(spark, d), "source_path").select("doc_id", "doc_uri")


# Files whose texts begin with stated relations; then some say something else, are shorter or empty, and new ones come.
TELLS = "'Alpha_'||(doc_id%50)||' depends on Beta_'||(doc_id%7)||'. Ваза_'||(doc_id%3)||' вызывает Мир. '||text"
TOLD = Extraction(kinds=("symbol", "term"))


def _told_sql(later: bool) -> str:
    after = f"CASE WHEN doc_id%6=1 THEN 'ALPHA_'||(doc_id%50)||' calls Gamma_'||(doc_id%5)||'. '||substr(text, 1, 900) WHEN doc_id%10=0 THEN '' ELSE {TELLS} END"
    states = f"""states AS (SELECT * EXCLUDE (text), {TELLS} AS text, 0 AS phase, doc_id%6<>1 OR doc_id%10=0 AS lasts FROM kb WHERE doc_id%4<>0
  UNION ALL SELECT * EXCLUDE (text), {after}, 1, true FROM kb WHERE CASE WHEN doc_id%6=1 THEN true ELSE doc_id%10<>0 END AND (doc_id%4=0 OR doc_id%6=1))"""
    if not later:
        states = f"states AS (SELECT * EXCLUDE (text), {TELLS} AS text, 0 AS phase, true AS lasts FROM kb)"
    return f"""{KB}, {states.replace("doc_id%6<>1 OR doc_id%10=0 AS lasts", "doc_id%6<>1 AS lasts")},
cut AS (SELECT *, 'kb://chunk/'||doc_key||'_'||i AS uri, substr(text, i*680+1, 800) AS t FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text)-800)/680.0) AS INT)))) AS i FROM states WHERE length(text) > 0)),
spelled AS (SELECT *, unnest(list_filter({SYMBOLS.format('t')}, lambda w: lower(w) NOT IN {STOP})) AS alias, generate_subscripts(list_filter({SYMBOLS.format('t')}, lambda w: lower(w) NOT IN {STOP}), 1) AS place, 'symbol' AS kind FROM cut
  UNION ALL SELECT *, unnest(regexp_extract_all(t, '[А-Яа-яЁё][А-Яа-яЁё0-9_-]{{2,}}')), generate_subscripts(regexp_extract_all(t, '[А-Яа-яЁё][А-Яа-яЁё0-9_-]{{2,}}'), 1), 'term' FROM cut),
said AS (SELECT *, 'kb://entity/'||kind||':'||lower(alias) AS e FROM spelled),
firsts AS (SELECT workspace_id, e, alias, min([phase::VARCHAR, source_path, lpad(i::VARCHAR, 9, '0'), lpad(place::VARCHAR, 9, '0')]) AS pos FROM said GROUP BY ALL),
plain AS (SELECT workspace_id, e, alias, min(pos) AS pos FROM (SELECT * FROM firsts UNION ALL SELECT workspace_id, e, lower(any_value(alias)), list_concat(min(pos)[1:3], ['999999999']) FROM firsts GROUP BY workspace_id, e, pos[1]) GROUP BY ALL),
entity AS (SELECT workspace_id, e, list(alias ORDER BY pos) AS aliases FROM plain GROUP BY ALL),
lasting AS (SELECT * FROM said WHERE lasts),
relation AS (SELECT workspace_id, 'kb://entity/symbol:alpha_'||(doc_id%50) AS src, CASE WHEN t LIKE 'ALPHA%' THEN 'CALLS' ELSE 'DEPENDS_ON' END AS rel, 'kb://entity/symbol:'||CASE WHEN t LIKE 'ALPHA%' THEN 'gamma_'||(doc_id%5) ELSE 'beta_'||(doc_id%7) END AS dst FROM cut WHERE lasts AND i=0
  UNION SELECT workspace_id, 'kb://entity/term:ваза_'||(doc_id%3), 'CALLS', 'kb://entity/term:мир' FROM cut WHERE lasts AND i=0 AND t LIKE 'Alpha%'),
edge AS (SELECT workspace_id, doc_uri AS src, 'CONTAINS' AS rel, uri AS dst FROM cut WHERE lasts UNION SELECT workspace_id, uri, 'MENTIONS', e FROM lasting UNION SELECT workspace_id, e, 'DOCUMENTED_IN', doc_uri FROM lasting UNION SELECT * FROM relation)"""


def _told(spark: SparkSession, d: str, *names: str) -> tuple[service.Store, service.Store]:
    """The store after a first ingestion into an empty one, and after the second; names: tables of the first store that are written, where others are not read."""
    n, k = F.col("doc_id"), lambda m: (F.col("doc_id") % m).cast("string")
    tells = F.concat(F.lit("Alpha_"), k(50), F.lit(" depends on Beta_"), k(7), F.lit(". Ваза_"), k(3), F.lit(" вызывает Мир. "), "text")
    other = F.concat(F.lit("ALPHA_"), k(50), F.lit(" calls Gamma_"), k(5), F.lit(". "), F.substring("text", 1, 900))
    rows = docs(spark, d).drop("doc_uri", "doc_key")
    store = service.ingest_files(rows.where(n % 4 != 0).withColumn("text", tells), service.empty_store(spark), chunking.spans, extraction=TOLD)[0].written(*names)
    now = rows.withColumn("text", F.when(n % 6 == 1, other).when(n % 10 == 0, "").otherwise(tells))
    return store, service.ingest_files(now, store, chunking.spans, extraction=TOLD)[0]


@query(
    "ingest_entities",
    f"""WITH {_told_sql(True)}, acl AS (SELECT workspace_id, e, string_agg(DISTINCT p, ',' ORDER BY p) AS acl FROM (SELECT workspace_id, e, unnest(acl_allow) AS p FROM said) GROUP BY ALL)
SELECT e AS uri, workspace_id, aliases[1] AS name, array_to_string(aliases, ' ') AS aliases, replace(e, 'kb://entity/', '') AS canonical_key, acl FROM entity JOIN acl USING (workspace_id, e)""",
)
def ingest_entities(spark, d):
    """Names, spellings, keys and principals of all entities after a first and a second ingestion."""
    nodes = _told(spark, d, "docs", "chunks", "nodes", "ledger")[1].nodes.where("type = 'Entity'")
    return nodes.select("uri", "workspace_id", "name", F.array_join("aliases", " ").alias("aliases"), "canonical_key", F.array_join("acl_allow", ",").alias("acl"))


@query("ingest_edges", f"WITH {_told_sql(True)} SELECT src, rel, dst, workspace_id FROM edge")
def ingest_edges(spark, d):
    """All edges after the same: of what files said before only that is left which others say, too."""
    return _told(spark, d, "docs", "chunks", "edges", "ledger", "stated")[1].edges.select("src", "rel", "dst", "workspace_id")


@query("ingest_relation_change", f"WITH {_told_sql(True)}, old AS (SELECT DISTINCT 'w'||(doc_id%3) AS workspace_id, 'kb://entity/symbol:alpha_'||(doc_id%50) AS src, 'kb://entity/symbol:beta_'||(doc_id%7) AS dst FROM documents WHERE doc_id%4<>0) SELECT src, dst, workspace_id, EXISTS (FROM relation r WHERE r.workspace_id=old.workspace_id AND r.src=old.src AND r.dst=old.dst AND rel='DEPENDS_ON') AS stays FROM old")
def ingest_relation_change(spark, d):
    """Which relations of the first ingestion outlast the second."""
    keys = ["workspace_id", "src", "dst"]
    one, two = (s.edges.where("rel = 'DEPENDS_ON'").select(*keys) for s in _told(spark, d, "docs", "chunks", "ledger", "stated"))
    return one.join(two.withColumn("stays", F.lit(True)), keys, "left").select(*keys, F.coalesce("stays", F.lit(False)).alias("stays"))


def _ingested_base(spark: SparkSession, d: str, rows: DataFrame, extraction: Extraction, nodes: DataFrame | None = None) -> service.KnowledgeBase:
    store = service.empty_store(spark)
    store = service.ingest_files(rows, store if nodes is None else replace(store, nodes=nodes), chunking.spans, extraction=extraction)[0]
    scratch, store = store.scratch, store.written("docs", "chunks", "nodes", "edges")
    session.drop(*scratch)
    return store.knowledge_base(_cited(spark, d))


@query(
    "kb_search_ingested",
    SEARCH_SQL + """ SELECT qid, uri, coalesce(title, 'Unknown') AS title, c.doc_uri AS cited, len(c.entity_uris) AS n_entities, round(vector,6) AS vector, graph, round(memory,6) AS memory, round(score,6) AS score, rank FROM best JOIN allowed c USING (uri)""",
)
def kb_search_ingested(spark, d):
    """The same searches on a store that ingestion made from files."""
    base = _ingested_base(spark, d, docs(spark, d).drop("doc_uri", "doc_key"), Extraction(kinds=("symbol",)))
    found = service.search(_requests(spark, d), base, CALLER, fallback=False)[0]
    return found.select("qid", "uri", "title", F.get("citations", F.lit(0))["uri"].alias("cited"), F.size("entities").cast("long").alias("n_entities"), F.round("vector", 6).alias("vector"), "graph", F.round("memory", 6).alias("memory"), F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


EXPANDED_SQL = f"""WITH {_told_sql(False)},
seen_nodes AS (SELECT DISTINCT e AS uri FROM said WHERE {SEES} UNION SELECT uri FROM cut WHERE {SEES} UNION SELECT doc_uri FROM cut WHERE {SEES}),
q AS (SELECT 'q'||item_id AS qid, 'alpha_'||(item_id%50) AS name, 'beta_'||(item_id%50*3%7)||'.' AS more FROM benchmark),
asked AS (SELECT *, EXISTS (FROM seen_nodes s WHERE s.uri='kb://entity/symbol:'||name) AS known FROM q),
own AS (SELECT DISTINCT uri, doc_uri, {tokens('t')} AS words FROM cut WHERE {SEES}),
scores AS (SELECT qid, uri, (list_contains(words, name)::INT + list_contains(words, 'state')::INT + (known AND list_contains(words, more))::INT) / CASE WHEN known THEN 3 ELSE 2 END AS vector, (list_contains(words, name)::INT + list_contains(words, 'state')::INT) / 2 AS lexical FROM asked, own),
hits AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY vector DESC, uri) AS n FROM scores WHERE vector > 0 QUALIFY n <= 20),
seeds AS (SELECT qid, uri, row_number() OVER (PARTITION BY qid ORDER BY uri) AS n FROM asked JOIN seen_nodes ON uri LIKE 'kb://entity/%' AND (contains(replace(uri, 'kb://entity/', ''), name) OR contains(replace(uri, 'kb://entity/', ''), 'state')) QUALIFY n <= 20),
walk AS (SELECT src, dst FROM edge WHERE workspace_id='w1' UNION SELECT dst, src FROM edge WHERE workspace_id='w1'),
near AS (SELECT qid, uri, 0 AS hop FROM seeds UNION SELECT qid, dst, 1 FROM seeds JOIN walk ON src=uri WHERE dst IN (SELECT uri FROM seen_nodes)),
reached AS (SELECT qid, uri, row_number() OVER (PARTITION BY qid ORDER BY hop, uri) AS n FROM (SELECT qid, uri, min(hop) AS hop FROM near GROUP BY ALL) QUALIFY n <= 200),
fused AS (SELECT h.qid, h.uri, vector, lexical, CASE WHEN r.uri IS NULL THEN 0.0 ELSE 1.0 END AS graph FROM hits h LEFT JOIN reached r USING (qid, uri)),
scored AS (SELECT *, 0.7*(0.6*(0.7*vector+0.2*graph)+0.4*lexical)+0.3*lexical AS score FROM fused)
SELECT qid, uri, round(vector, 6) AS vector, graph, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, uri) AS rank FROM scored QUALIFY rank <= 10"""


@query("kb_search_expanded", EXPANDED_SQL)
def kb_search_expanded(spark, d):
    """Searches whose queries are expanded by what the store knew of the named entities before files were ingested."""
    k = (F.col("doc_id") % 50).cast("string")
    known = docs(spark, d).select(F.concat(F.lit("kb://entity/symbol:alpha_"), k).alias("uri"), F.lit("Entity").alias("type"), F.concat(F.lit("alpha_"), k).alias("name"), F.col("workspace_id"), F.array().cast(STRINGS).alias("acl_allow"), F.lit(None).cast("string").alias("canonical_key"), F.array(F.concat(F.lit("Beta_"), (F.col("doc_id") % 50 * 3 % 7).cast("string"), F.lit("."))).alias("aliases")).dropDuplicates(["uri", "workspace_id"])
    m = F.col("doc_id")
    told = F.concat(F.lit("Alpha_"), k, F.lit(" depends on Beta_"), (m % 7).cast("string"), F.lit(". Ваза_"), (m % 3).cast("string"), F.lit(" вызывает Мир. "), "text")
    base = _ingested_base(spark, d, docs(spark, d).drop("doc_uri", "doc_key").withColumn("text", told), TOLD, known)
    n = F.substring("qid", 2, 20).cast("int")
    asks = asked(spark, d).select("qid", F.concat(F.lit("Alpha_"), (n % 50).cast("string"), F.lit(" state")).alias("query"), F.lit("hybrid").alias("mode"), F.lit(False).alias("include_memory"))
    found = service.search(asks, base, CALLER, expand=True, fallback=False)[0]
    return found.select("qid", "uri", F.round("vector", 6).alias("vector"), "graph", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "point_ids",
    """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('kb:'||doc_id||':'||source)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8)||'-'||substr(h, 9, 4)||'-5'||substr(h, 14, 3)||'-'||translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')||substr(h, 18, 3)||'-'||substr(h, 21, 12) AS point FROM h""",
)
def point_ids(spark, d):
    raw = F.concat(F.col("doc_id").cast("string"), F.lit(":"), "source")
    return session.table(spark, d, "documents").select("doc_id", ingest.point_id(raw, prefix="kb:").alias("point"))


LINKED = f"""WITH {TURNS}, old AS (SELECT * FROM turns WHERE conv_id%2=0), put AS (SELECT * FROM turns WHERE conv_id%3=0 AND conv_id%5<>0 AND len({WHY})=0),
ref AS (SELECT uri, workspace_id, 'kb://entity/symbol:'||type AS dst FROM old WHERE uri NOT IN (SELECT uri FROM put) UNION SELECT uri, workspace_id, unnest(['kb://entity/symbol:'||type, 'kb://entity/symbol:new_'||(conv_id%4)]) FROM put)"""


def _linked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = turns(spark, d)
    of = lambda c: F.concat(F.lit("kb://entity/symbol:"), c)
    old = t.where(F.col("conv_id") % 2 == 0).withColumn("entity_uris", F.array(of(F.col("type"))))
    put = t.where(F.col("conv_id") % 3 == 0).withColumn("entity_uris", F.array(of(F.col("type")), of(F.concat(F.lit("new_"), (F.col("conv_id") % 4).cast("string")))))
    done = t.where(F.col("conv_id") % 5 == 0).select("request_key").distinct()
    entity = old.select(F.explode("entity_uris").alias("uri"), "workspace_id").distinct().select("uri", F.lit("Entity").alias("type"), "uri", "workspace_id").toDF("uri", "type", "name", "workspace_id").withColumn("acl_allow", F.array(F.lit("u0")))
    _, nodes, edges, _, _ = memory.upsert_linked(old, entity.unionByName(graph.memory_nodes(old)), graph.memory_edges(old), put, done)
    return nodes, edges


@query("memory_links", LINKED + " SELECT uri AS src, 'MEMORY_REFERS_TO' AS rel, dst, workspace_id FROM ref")
def memory_links(spark, d):
    """Edges after items were put over others: those of accepted items that were not put before, and what others had."""
    return _linked(spark, d)[1].select("src", "rel", "dst", "workspace_id")


@query(
    "memory_link_nodes",
    LINKED + """ SELECT uri, 'Memory' AS type, workspace_id, subject AS readers FROM (SELECT * FROM old UNION SELECT * FROM put) UNION
SELECT 'kb://entity/symbol:'||type, 'Entity', workspace_id, 'u0' FROM old UNION SELECT dst, 'Entity', workspace_id, '' FROM ref WHERE (dst, workspace_id) NOT IN (SELECT ('kb://entity/symbol:'||type, workspace_id) FROM old)""",
)
def memory_link_nodes(spark, d):
    return _linked(spark, d)[0].select("uri", "type", "workspace_id", F.array_join("acl_allow", ",").alias("readers"))


@query(
    "typed_reads",
    f"""WITH {CHUNKS}, {TURNS} SELECT 'doc' AS kind, doc_uri AS uri, workspace_id='w1' AS found, CASE WHEN workspace_id='w1' THEN title||'|'||source_path END AS fields FROM kb
UNION ALL SELECT 'chunk', uri, workspace_id='w1', CASE WHEN workspace_id='w1' THEN doc_uri||'|'||sha256(text) END FROM chunks
UNION ALL SELECT 'memory', uri, workspace_id='w1' AND subject='u1', CASE WHEN workspace_id='w1' AND subject='u1' THEN type||'|'||sha256(text) END FROM turns""",
)
def typed_reads(spark, d):
    """Point reads of each kind by one caller: only what is in the own workspace (of memory: one's own) is found."""
    doc, own, mine = docs(spark, d).withColumnRenamed("doc_uri", "uri"), chunks(spark, d), turns(spark, d)
    joined = lambda *c: F.when(F.col("found"), F.concat_ws("|", *c))
    rows = (("doc", doc, joined("title", "source_path")), ("chunk", own, joined("doc_uri", F.sha2("text", 256))), ("memory", mine, joined("type", F.sha2("text", 256))))
    out = None
    for kind, table, fields in rows:
        got = tables.get(table, table, kind, "w1", "u1").select(F.lit(kind).alias("kind"), "uri", "found", fields.alias("fields"))
        out = got if out is None else out.unionByName(got)
    return out


@query(
    "audit_log",
    "SELECT CAST(ts AS DATE) AS day, event_type AS tool, count(*) AS n, count(DISTINCT sha256('{\"event_id\":'||event_id||',\"value\":'||user_id||'}')) AS hashes, CAST(sum(user_id) AS BIGINT) AS results FROM events GROUP BY ALL",
)
def audit_log(spark, d):
    """Calls go to the log in two batches; the log is read back."""
    e = session.table(spark, d, "events")
    calls = e.select(F.col("ts").alias("at"), F.col("event_type").alias("tool"), F.col("user_id").alias("result_count"), "event_id", F.col("user_id").alias("value"))
    rows = service.audit(calls, ["event_id", "value"], "at", "tool", "result_count", "event_id")
    path = session.fresh_path(spark, "audit")
    for half in (0, 1):
        service.append_audit(rows.where(F.col("event_id") % 2 == half), path)
    return service.read_audit(spark, path).groupBy("day", "tool").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("params_hash").alias("hashes"), F.sum("result_count").alias("results"))


def _as_files(spark: SparkSession, d: str) -> str:
    """A folder in which each benchmark item is a text file of its own."""
    root = session.fresh_path(spark, "files")
    session.table(spark, d, "benchmark").select("item_id", F.col("text").alias("value")).repartition("item_id").write.partitionBy("item_id").text(root)
    return root


def _read_back(rows: DataFrame) -> DataFrame:
    """item_id and text of files, without the line end that writing adds."""
    return rows.select(F.regexp_extract("source_path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.regexp_replace("text", "\n$", "").alias("text"), "source", "tags")


@query("files_scan", "SELECT item_id, sha256(text) AS sha, 'ext:txt' AS tag FROM benchmark")
def files_scan(spark, d):
    """Items are written as files and read by the scan of a folder."""
    return _read_back(files.documents(spark, _as_files(spark, d))).select("item_id", F.sha2("text", 256).alias("sha"), F.get("tags", F.lit(0)).alias("tag"))


@query("files_targeted", "SELECT item_id, sha256(text) AS sha FROM benchmark WHERE item_id%3=0")
def files_targeted(spark, d):
    """Of the same files only those that are named."""
    root = _as_files(spark, d)
    some = session.table(spark, d, "benchmark").where(F.col("item_id") % 3 == 0).select("item_id").collect()
    return _read_back(files.documents(spark, root, include=[f"item_id={r.item_id}" for r in some])).select("item_id", F.sha2("text", 256).alias("sha"))


@query(
    "files_ingested",
    """WITH kb AS (SELECT item_id, 'w'||(item_id%3) AS workspace_id, 'item/'||item_id AS source_path, text FROM benchmark WHERE text <> ''), k AS (SELECT *, substr(sha1(workspace_id||':'||source_path), 1, 16) AS key FROM kb),
c AS (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((length(text)-800)/680.0) AS INT)))) AS i FROM k)
SELECT 'kb://chunk/'||key||'_'||i AS uri, workspace_id, sha256(substr(text, i*680+1, 800)) AS sha FROM c""",
)
def files_ingested(spark, d):
    """From files to a store."""
    read = _read_back(files.documents(spark, _as_files(spark, d)))
    n = F.col("item_id")
    rows = read.select(F.concat(F.lit("w"), (n % 3).cast("string")).alias("workspace_id"), F.concat(F.lit("item/"), n.cast("string")).alias("source_path"), "source", F.col("source").alias("title"), "tags", F.array(F.lit("u1")).alias("acl_allow"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), "text")
    store, _ = service.ingest_files(rows, service.empty_store(spark), chunking.spans)
    return store.chunks.select("uri", "workspace_id", F.sha2("text", 256).alias("sha"))


@query("json_lines_scan", "SELECT conv_id, turn, sha256(text) AS sha FROM conversations")
def json_lines_scan(spark, d):
    """Turns are written as JSON lines, each followed by a blank and a broken line, and read by the loose reader."""
    path = session.fresh_path(spark, "lines")
    t = session.table(spark, d, "conversations")
    lines = t.select(F.explode(F.array(F.to_json(F.struct("conv_id", "turn", "text")), F.lit("  "), F.lit("not json"), F.lit("[1, 2]"))).alias("value"))
    lines.write.text(path)
    return files.json_lines(spark, path, "conv_id long, turn long, text string").select("conv_id", "turn", F.sha2("text", 256).alias("sha"))


@query(
    "table_changes",
    """WITH old AS (SELECT o_orderkey AS k, CASE WHEN o_custkey%2=0 THEN 'w1' ELSE 'w0' END AS w, o_orderstatus AS status FROM orders WHERE o_orderkey%5<>0),
new AS (SELECT o_orderkey AS k, CASE WHEN o_custkey%2=0 THEN 'w1' ELSE 'w0' END AS w, 'X' AS status FROM orders WHERE o_orderkey%3=0),
one AS (SELECT * FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT * FROM new), two AS (SELECT * FROM one WHERE k%7<>0)
SELECT k, w, status, 1 AS times FROM two WHERE k%11<>0 UNION ALL SELECT k, w, 'Y', 1 FROM two WHERE k%11=0 UNION ALL SELECT k, 'w2', 'Y', 1 FROM two WHERE k%11=0""",
)
def table_changes(spark, d):
    """A table is made, filled, changed, cut, given another key and changed under that."""
    key = F.col("o_orderkey")
    o = session.table(spark, d, "orders").select(key.alias("k"), F.when(F.col("o_custkey") % 2 == 0, "w1").otherwise("w0").alias("w"), F.col("o_orderstatus").alias("status"))
    t = tables.Table(spark, session.fresh_path(spark, "table"), "k long, w string, status string", ["k"], 8)
    t.create()
    t.upsert(o.where(F.col("k") % 5 != 0))
    t.upsert(o.where(F.col("k") % 3 == 0).withColumn("status", F.lit("X")))
    t.delete(o.where(F.col("k") % 7 == 0))
    t.rekey(["k", "w"])
    now = t.read().where(F.col("k") % 11 == 0)
    t.upsert(now.unionByName(now.withColumn("w", F.lit("w2"))).withColumn("status", F.lit("Y")))
    return t.read().groupBy("k", "w", "status").agg(F.count(F.lit(1)).alias("times"))


@query(
    "kb_search_clamped",
    SEARCH_SQL.replace("WHERE rank <= 20)", "WHERE rank <= 100)").replace("QUALIFY rank <= 10)", "QUALIFY rank <= 100)") + " SELECT qid, uri, graph, round(score,6) AS score, rank FROM best",
)
def kb_search_clamped(spark, d):
    """Who asks for 5,000 results gets a hundred."""
    found = service.search(_requests(spark, d), knowledge_base(spark, d), CALLER, top_k=5000, top_n=5000, fallback=False)[0]
    return found.select("qid", "uri", "graph", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
