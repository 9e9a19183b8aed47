"""Queries over the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.catalog import query
from loamwork.functions import access
from loamwork.operators import entities, extract, graph
from loamwork.plans.catalog_kb import STRINGS, chunks, docs
from loamwork.plans.sqltext import CHUNKS, STOP, SYMBOLS


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their symbol entities."""
    names = F.array_distinct(F.transform(entities.names(F.col("text"), "symbol"), lambda v: entities.uri_of("symbol", v)))
    return chunks(spark, d).withColumn("entity_uris", names)


MENTIONS = CHUNKS + f""", mentioned AS (SELECT *, list_distinct(list_transform(list_filter({SYMBOLS.format('text')}, lambda w: lower(w) NOT IN {STOP}), lambda w: 'kb://entity/symbol:'||lower(w))) AS entity_uris FROM chunks)"""


@query(
    "graph_nodes",
    f"""WITH {MENTIONS}, rows AS (SELECT doc_uri AS uri, 'Document' AS type, workspace_id, acl_allow FROM mentioned UNION ALL SELECT uri, 'Chunk', workspace_id, acl_allow FROM mentioned
 UNION ALL SELECT e, 'Entity', workspace_id, acl_allow FROM (SELECT unnest(entity_uris) AS e, workspace_id, acl_allow FROM mentioned)),
acl AS (SELECT uri, workspace_id, string_agg(DISTINCT p, ',' ORDER BY p) AS acl FROM (SELECT uri, workspace_id, unnest(acl_allow) AS p FROM rows) GROUP BY ALL)
SELECT uri, workspace_id, min(type) AS type, any_value(acl) AS acl FROM rows JOIN acl USING (uri, workspace_id) GROUP BY uri, workspace_id""",
)
def graph_nodes(spark, d):
    return graph.mention_nodes(mentions(spark, d)).select("uri", "workspace_id", "type", F.array_join("acl_allow", ",").alias("acl"))


@query(
    "graph_edges",
    f"""WITH {MENTIONS}, e AS (SELECT uri, doc_uri, unnest(entity_uris) AS e FROM mentioned)
SELECT doc_uri AS src, 'CONTAINS' AS rel, uri AS dst FROM mentioned UNION SELECT uri, 'MENTIONS', e FROM e UNION SELECT e, 'DOCUMENTED_IN', doc_uri FROM e""",
)
def graph_edges(spark, d):
    return graph.mention_edges(mentions(spark, d)).select("src", "rel", "dst")


# a graph of the trade tables: regions, nations, suppliers, customers, orders
TRADE = """nodes AS (
  SELECT 'r'||r_regionkey AS uri, 'Region' AS type, r_name AS name, 0 AS n FROM region UNION ALL SELECT 'n'||n_nationkey, 'Entity', n_name, n_nationkey FROM nation
  UNION ALL SELECT 's'||s_suppkey, 'Entity', s_name, s_suppkey FROM supplier UNION ALL SELECT 'c'||c_custkey, 'Entity', c_name, c_custkey FROM customer),
edges AS (
  SELECT 'r'||n_regionkey AS src, 'OWNS' AS rel, 'n'||n_nationkey AS dst FROM nation UNION ALL SELECT 's'||s_suppkey, 'DEPENDS_ON', 'n'||s_nationkey FROM supplier
  UNION ALL SELECT 'c'||c_custkey, 'DEPENDS_ON', 'n'||c_nationkey FROM customer UNION ALL SELECT DISTINCT 's'||l_suppkey, 'AFFECTS', 'c'||o_custkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey),
vis AS (SELECT uri FROM nodes WHERE type='Region' OR n%7<>0),
ve AS (SELECT * FROM edges WHERE src IN (SELECT uri FROM vis) AND dst IN (SELECT uri FROM vis)),
und AS (SELECT src, dst FROM ve UNION SELECT dst, src FROM ve)"""


def trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: session.table(spark, d, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    hidden = lambda c: F.when(F.col(c) % 7 != 0, F.array(F.lit("role:reader"))).otherwise(F.array().cast(STRINGS))
    rows = [
        t("region").select(name("r", "r_regionkey").alias("uri"), F.lit("Region").alias("type"), F.col("r_name").alias("name"), F.array(F.lit("role:reader")).alias("acl_allow")),
        *[t(n).select(name(p, k).alias("uri"), F.lit("Entity").alias("type"), F.col(label).alias("name"), hidden(k).alias("acl_allow")) for n, p, k, label in (("nation", "n", "n_nationkey", "n_name"), ("supplier", "s", "s_suppkey", "s_name"), ("customer", "c", "c_custkey", "c_name"))],
    ]
    nodes = rows[0]
    for r in rows[1:]:
        nodes = nodes.unionByName(r)
    line = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(name("s", "l_suppkey").alias("src"), F.lit("AFFECTS").alias("rel"), name("c", "o_custkey").alias("dst")).distinct()
    edges = (
        t("nation")
        .select(name("r", "n_regionkey").alias("src"), F.lit("OWNS").alias("rel"), name("n", "n_nationkey").alias("dst"))
        .unionByName(t("supplier").select(name("s", "s_suppkey").alias("src"), F.lit("DEPENDS_ON").alias("rel"), name("n", "s_nationkey").alias("dst")))
        .unionByName(t("customer").select(name("c", "c_custkey").alias("src"), F.lit("DEPENDS_ON").alias("rel"), name("n", "c_nationkey").alias("dst")))
        .unionByName(line)
    )
    return nodes.withColumn("workspace_id", F.lit("w")), edges


def seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = trade(spark, d)
    nodes = graph.visible(nodes, "w", access.principals(F.lit("u"), F.array(F.lit("reader"))))
    return nodes, graph.visible_edges(edges, nodes)


@query("graph_visible", f"WITH {TRADE} SELECT src, rel, dst FROM ve")
def graph_visible(spark, d):
    return seen(spark, d)[1]


def _bfs_sql(depth: int) -> str:
    return f"""WITH RECURSIVE {TRADE}, walk AS (SELECT 'x'||uri AS qid, uri, 0 AS hop FROM vis WHERE uri LIKE 'r%' UNION SELECT qid, dst, hop+1 FROM walk JOIN und ON src=uri WHERE hop < {depth}),
near AS (SELECT qid, uri, min(hop) AS hop FROM walk GROUP BY ALL)
SELECT qid, uri, hop FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hop, uri) AS n FROM near) WHERE n <= 200"""


def _bfs(spark: SparkSession, d: str, depth: int) -> DataFrame:
    nodes, edges = seen(spark, d)
    seeds = nodes.where("type = 'Region'").select(F.concat(F.lit("x"), "uri").alias("qid"), "uri")
    return graph.expand(edges, seeds, depth)


@query("bfs_depth1", _bfs_sql(1))
def bfs_depth1(spark, d):
    return _bfs(spark, d, 1)


@query("bfs_depth2", _bfs_sql(2))
def bfs_depth2(spark, d):
    return _bfs(spark, d, 2)


@query("bfs_depth3", _bfs_sql(3))
def bfs_depth3(spark, d):
    return _bfs(spark, d, 3)


@query(
    "graph_paths",
    f"""WITH RECURSIVE {TRADE}, walk AS (SELECT 'x'||uri AS qid, uri, 0 AS hop FROM vis WHERE uri LIKE 'r%' UNION SELECT qid, dst, hop+1 FROM walk JOIN und ON src=uri WHERE hop < 2),
near AS (SELECT DISTINCT qid, uri FROM walk), cut AS (SELECT qid, uri FROM (SELECT n.*, row_number() OVER (PARTITION BY n.qid ORDER BY h.hop, n.uri) AS k FROM near n JOIN (SELECT qid, uri, min(hop) AS hop FROM walk GROUP BY ALL) h USING (qid, uri)) WHERE k <= 200)
SELECT a.qid, src, rel, dst, src||'>'||rel||'>'||dst AS path FROM ve JOIN cut a ON a.uri=src JOIN cut b ON b.uri=dst AND a.qid=b.qid""",
)
def graph_paths(spark, d):
    edges = seen(spark, d)[1]
    return graph.expanded_edges(edges, _bfs(spark, d, 2)).withColumn("path", F.array_join("path", ">"))


@query(
    "resolve_entities",
    f"""WITH {TRADE}, q AS (SELECT 'q'||item_id AS qid, unnest(list_filter(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яЁё0-9_]{{3,}}'), lambda w: w NOT IN ('the','and','with','from','that','this','for','are','mode','query','graph'))) AS w FROM benchmark),
ents AS (SELECT uri, lower(name) AS name, replace(lower(name), ' ', '_') AS key, 'alias'||substr(uri, 2) AS alias FROM nodes WHERE type='Entity'),
hit AS (SELECT DISTINCT qid, uri FROM q JOIN ents ON contains(key, w) OR contains(alias, w) OR list_contains(string_split(name, ' '), w))
SELECT qid, uri FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY uri) AS n FROM hit) WHERE n <= 20""",
)
def resolve_entities(spark, d):
    nodes, _ = trade(spark, d)
    q = session.table(spark, d, "benchmark").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("query"))
    key = F.replace(F.lower("name"), F.lit(" "), F.lit("_"))
    return graph.resolve(q, nodes.withColumns({"canonical_key": key, "aliases": F.array(F.concat(F.lit("Alias"), F.expr("substr(uri, 2)")))}))


@query(
    "explain_uri",
    f"""WITH {TRADE}, both_ways AS (SELECT src AS uri, rel, dst AS other FROM ve UNION SELECT dst, rel, src FROM ve),
top AS (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY rel, other) AS n FROM both_ways),
g AS (SELECT uri, string_agg(rel||' '||other, ',' ORDER BY n) AS r FROM top WHERE n <= 20 GROUP BY uri)
SELECT v.uri, 'vector'||coalesce(','||r, '') AS reasons FROM vis v LEFT JOIN g USING (uri)""",
)
def explain_uri(spark, d):
    nodes, edges = seen(spark, d)
    return graph.explain(edges, nodes.select("uri")).select("uri", F.array_join("reasons", ",").alias("reasons"))


@query(
    "detach_delete",
    f"""WITH {TRADE}, gone AS (SELECT uri FROM nodes WHERE type<>'Region' AND uri LIKE 's%'), left_edges AS (SELECT * FROM edges WHERE src NOT IN (SELECT uri FROM gone) AND dst NOT IN (SELECT uri FROM gone))
SELECT (SELECT count(*) FROM nodes WHERE uri NOT IN (SELECT uri FROM gone)) AS nodes_left, (SELECT count(*) FROM left_edges) AS edges_left""",
)
def detach_delete(spark, d):
    nodes, edges = trade(spark, d)
    left, ends = graph.detach_delete(nodes, edges.withColumn("workspace_id", F.lit("w")), nodes.where(F.startswith("uri", F.lit("s"))), "w")
    return left.agg(F.count(F.lit(1)).alias("nodes_left")).join(ends.agg(F.count(F.lit(1)).alias("edges_left")))


@query(
    "relation_edges",
    "WITH r AS (SELECT 's'||l_suppkey AS src, CASE l_linenumber WHEN 1 THEN 'CALLS' WHEN 2 THEN 'OWNS' ELSE 'KNOWS' END AS rel, CASE WHEN l_quantity > 40 THEN ' ' ELSE 'p'||l_partkey END AS dst FROM lineitem) SELECT DISTINCT src, rel, dst FROM r WHERE rel IN ('CALLS','OWNS') AND trim(dst) <> ''",
)
def relation_edges(spark, d):
    n = F.col("l_linenumber")
    rel = F.when(n == 1, "CALLS").when(n == 2, "OWNS").otherwise("KNOWS")
    dst = F.when(F.col("l_quantity") > 40, " ").otherwise(F.concat(F.lit("p"), F.col("l_partkey").cast("string")))
    rows = session.table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), rel.alias("rel"), dst.alias("dst"), F.lit("w").alias("workspace_id"))
    return graph.relation_edges(rows).select("src", "rel", "dst")


@query(
    "graph_coverage",
    f"WITH {MENTIONS}, g AS (SELECT DISTINCT doc_uri FROM mentioned WHERE workspace_id='w1' AND list_has_any(acl_allow, ['u1','role:reader']) AND len(entity_uris) > 0) SELECT count(g.doc_uri) AS docs_in_graph, count(*) AS docs, round(count(g.doc_uri)/count(*), 6) AS coverage FROM kb LEFT JOIN g USING (doc_uri)",
)
def graph_coverage(spark, d):
    """Documents that a caller reaches in the graph from an entity, of all."""
    own = mentions(spark, d)
    nodes = graph.visible(graph.mention_nodes(own), "w1", access.principals(F.lit("u1"), F.array(F.lit("reader"))))
    reached = graph.visible_edges(graph.mention_edges(own), nodes, ["DOCUMENTED_IN"]).select(F.col("dst").alias("doc_uri")).distinct()
    found = docs(spark, d).select("doc_uri").join(reached.withColumn("hit", F.lit(True)), "doc_uri", "left")
    return found.agg(F.count("hit").alias("docs_in_graph"), F.count(F.lit(1)).alias("docs")).withColumn("coverage", F.round(F.col("docs_in_graph") / F.col("docs"), 6))


# documents in which every ninth word is followed by a word that states a relation
VERBS = ["calls", "Owns", "вызывает", "implements", "владеет", "affects", "Реализует"]
STATED_SQL = f"""WITH texts AS (SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: CASE WHEN i%9=5 THEN w||' '||({VERBS})[1+(i//9)%7] ELSE w END), ' ') AS text FROM documents),
tile AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS tile FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS p FROM texts)),
word AS (SELECT doc_id, tile, sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i) AS b, sum(length(tile)) OVER (PARTITION BY doc_id ORDER BY i) - length(tile) AS a, lead(tile, 1) OVER o AS t1, lead(tile, 2) OVER o AS t2, lag(tile, 1) OVER o AS s1, lag(tile, 2) OVER o AS s2 FROM tile WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
ent AS (SELECT doc_id, a, b, uri, row_number() OVER (PARTITION BY doc_id ORDER BY a, b, uri) AS n FROM (
  SELECT doc_id, a, b, 'kb://entity/symbol:'||lower(tile) AS uri FROM word WHERE regexp_full_match(tile, '[A-Za-z_][A-Za-z0-9_]{{2,}}') AND lower(tile) NOT IN {STOP}
  UNION ALL SELECT doc_id, a, b + 1 + length(t2), 'kb://entity/table:'||lower(tile)||'.'||lower(t2) FROM word WHERE t1='.' AND regexp_full_match(tile, '[A-Za-z_]+') AND regexp_full_match(t2, '[A-Za-z_]+') AND NOT coalesce(s1='.' AND regexp_full_match(s2, '[A-Za-z_]+'), false)
  UNION ALL SELECT doc_id, a, b, 'kb://entity/term:'||lower(tile) FROM word WHERE regexp_full_match(tile, '[А-Яа-яЁё][А-Яа-яЁё0-9_-]{{2,}}'))),
trig AS (SELECT doc_id, a, b, CASE lower(tile) WHEN 'calls' THEN 'CALLS' WHEN 'вызывает' THEN 'CALLS' WHEN 'owns' THEN 'OWNS' WHEN 'владеет' THEN 'OWNS' WHEN 'affects' THEN 'AFFECTS' ELSE 'IMPLEMENTS' END AS rel FROM word WHERE lower(tile) IN ('calls','вызывает','owns','владеет','affects','implements','реализует')),
near AS (SELECT t.doc_id, t.a, t.b, t.rel, e.uri, e.n, t.a - e.b AS l, e.a - t.b AS r, least(abs(e.a - t.a), abs(e.b - t.a)) AS d FROM trig t JOIN ent e ON e.doc_id=t.doc_id AND e.b >= t.a - 260 AND e.a <= t.b + 260),
side AS (SELECT doc_id, a, rel, arg_min(uri, [l, n]) FILTER (WHERE l BETWEEN 0 AND 220) AS x, arg_min(uri, [r, n]) FILTER (WHERE r BETWEEN 0 AND 220) AS y, arg_min(uri, [d, n]) FILTER (WHERE d <= 240) AS first FROM near GROUP BY ALL),
two AS (SELECT s.doc_id, s.a, s.rel, x, y, first, arg_min(uri, [d, n]) FILTER (WHERE d <= 240 AND uri <> first) AS second FROM side s JOIN near USING (doc_id, a, rel) GROUP BY ALL),
chosen AS (SELECT doc_id, a, rel, coalesce(x <> y, false) AS direct, CASE WHEN coalesce(x <> y, false) THEN x ELSE first END AS src, CASE WHEN coalesce(x <> y, false) THEN y ELSE second END AS dst FROM two)"""


def _stating(spark: SparkSession, d: str) -> DataFrame:
    def tell(word, i):
        verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.floor((i + 1) / 9) % 7 + 1).cast("int"))
        return F.when((i + 1) % 9 == 5, F.concat(word, F.lit(" "), verb)).otherwise(word)

    words = F.transform(F.split("text", " "), tell)
    return session.table(spark, d, "documents").select("doc_id", F.array_join(words, " ").alias("text"))


@query(
    "relations_stated",
    STATED_SQL + " SELECT doc_id, src, rel, dst, min(a) AS start FROM chosen WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY ALL",
)
def relations_stated(spark, d):
    """Relations of whole texts with many entities, by the table function; where a side is missing or both are one, the two nearest count."""
    rows = extract.relations_of(_stating(spark, d), carry=["doc_id"])
    return rows.select("doc_id", "src", "rel", "dst", F.col("start").cast("long").alias("start"))


@query(
    "entities_by_table_function",
    STATED_SQL + " SELECT uri, count(*) AS n, CAST(sum(a) AS BIGINT) AS starts, CAST(sum(b) AS BIGINT) AS ends FROM ent GROUP BY uri",
)
def entities_by_table_function(spark, d):
    """All entities of the same texts with their offsets, called from SQL."""
    extract.register(spark)
    found = spark.sql("SELECT r.uri, r.start, r.end FROM {texts} AS t, LATERAL kb_entities(t.text) AS r", texts=_stating(spark, d))
    return found.groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("starts"), F.sum("end").alias("ends"))
