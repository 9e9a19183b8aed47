"""Validated memory: facts with citations, idempotent upserts, search with a lexical fallback, owner-checked deletion with confirmation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.operators import entities, graph, match
from loamwork.operators.vector import lexical, top

# Kinds of memory and the confidence that is asked for.
KINDS = ["summary", "fact", "decision", "preference"]
LEAST_CONFIDENCE = 0.75
TOKEN_SECONDS = 300


def reasons(kind: Column, value: Column, n_citations: Column, confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """Why an item is not accepted, in a fixed order; an empty array accepts it."""
    words = F.size(F.filter(F.split(F.trim(value), r"\s+"), lambda w: w != ""))
    fact = kind == "fact"
    rules = [
        (F.trim(value) == "", "empty_text"),
        (~kind.isin(KINDS), "invalid_type"),
        (n_citations <= 0, "missing_citations"),
        (confidence < least, "low_confidence"),
        (fact & (words < 3), "fact_too_short"),
        (fact & ~F.contains(value, F.lit(":")) & ~F.contains(value, F.lit("=")), "fact_schema_mismatch"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(True)), F.lit(name)) for test, name in rules]), lambda r: r.isNotNull())


def idempotency_key(workspace: Column, subject: Column, key: Column, items: Column) -> Column:
    return F.sha2(F.concat_ws(":", workspace, subject, key, items), 256)


def upsert(store: DataFrame, items: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(store, report, ledger) after items (uri, workspace_id, subject, type, text, n_citations, confidence, request_key).

    A request whose key is in the ledger changes nothing. Rejected items are in the report with their reasons. Accepted ones replace rows of the same uri.
    """
    fresh = items.join(ledger.select("request_key"), "request_key", "left_anti")
    judged = fresh.withColumn("reasons", reasons(F.col("type"), F.col("text"), F.col("n_citations"), F.col("confidence")))
    good = judged.where(F.size("reasons") == 0)
    kept = store.join(good.select("uri").distinct(), "uri", "left_anti")
    return kept.unionByName(good.select(*store.columns)), judged.select("uri", "request_key", "reasons"), ledger.unionByName(fresh.select("request_key").distinct())


def upsert_linked(store: DataFrame, nodes: DataFrame, edges: DataFrame, items: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(store, nodes, edges, report, ledger): upsert(), with accepted items (which also have entity_uris) as nodes of the graph that only their owners see,
    and edges to the entities they refer to. A replaced item's former edges go; entities that there are none of become nodes, which nobody sees until a document
    mentions them."""
    after, report, keys = upsert(store, items, ledger)
    good = items.join(report.where(F.size("reasons") == 0).select("uri", "request_key").distinct(), ["uri", "request_key"], "left_semi")
    mine = good.select("uri", "workspace_id").distinct()
    own, fresh = graph.memory_nodes(good), graph.memory_edges(good)
    kept = nodes.join(mine, ["uri", "workspace_id"], "left_anti").select(*graph.NODE).unionByName(own)
    ends = fresh.select(F.col("dst").alias("uri"), "workspace_id").distinct().join(kept.select("uri", "workspace_id"), ["uri", "workspace_id"], "left_anti")
    unseen = ends.select("uri", F.lit("Entity").alias("type"), entities.display_name(F.col("uri")).alias("name"), "workspace_id", F.array().cast("array<string>").alias("acl_allow"))
    others = edges.join(mine.withColumnRenamed("uri", "src"), ["src", "workspace_id"], "left_anti")
    return after, kept.unionByName(unseen), others.select("src", "rel", "dst", "workspace_id").unionByName(fresh.select("src", "rel", "dst", "workspace_id")), report, keys


def search(queries: DataFrame, memory: DataFrame, top_k: int = 10) -> DataFrame:
    """(qid, uri, score, rank, branch): similarity hits of the caller's memory; queries without any fall back to lexical scores over 0.

    queries: qid, query, workspace_id, subject.
    """
    mine = memory.select("uri", "workspace_id", "subject", "text")
    owner = ["workspace_id", "subject"]
    first = top(lexical(queries, mine, top_k, owner), top_k, F.desc("score"), F.col("uri")).withColumn("branch", F.lit("vector"))
    empty = queries.join(first.select("qid").distinct(), "qid", "left_anti")
    pairs = match.containing(empty, mine, ["uri", *owner]).join(empty.select("qid", *owner), ["qid", *owner]).select("qid", "uri", "score")
    return first.unionByName(top(pairs, top_k, F.desc("score"), F.col("uri")).withColumn("branch", F.lit("lexical")))


def owned(memory: DataFrame, workspace_id: str, subject: str, ids: list[str] | None = None) -> DataFrame:
    """Rows that the subject may delete: its own, all or those named."""
    mine = memory.where((F.col("workspace_id") == workspace_id) & (F.col("subject") == subject))
    return mine if ids is None else mine.where(F.col("uri").isin(ids))


def preview(rows: DataFrame) -> DataFrame:
    return rows.select("uri", F.substring("text", 1, 100).alias("preview"))


def deleted_count(from_vectors: DataFrame, from_metadata: DataFrame) -> DataFrame:
    """One row: the smaller of two counts (column deleted)."""
    both = from_vectors.select("deleted").unionByName(from_metadata.select("deleted"))
    return both.agg(F.min("deleted").alias("deleted"))


def delete(memory: DataFrame, gone: DataFrame) -> DataFrame:
    return memory.join(gone.select("uri"), "uri", "left_anti")


def chunk_bonus(hits: DataFrame, memory: DataFrame) -> DataFrame:
    """(qid, uri, memory): for each chunk that hit memories cite, the best score."""
    cited = memory.select("uri", F.explode("citations").alias("c")).select("uri", F.col("c.chunk_uri").alias("chunk_uri"))
    return hits.join(cited, "uri").groupBy("qid", F.col("chunk_uri")).agg(F.max("score").alias("memory")).withColumnRenamed("chunk_uri", "uri")


def confirm(tokens: DataFrame, attempts: DataFrame, seconds: int = TOKEN_SECONDS) -> DataFrame:
    """attempts (token, at) with `accepted`: the token exists (token, issued_at), is not older than `seconds`, and this is its first use."""
    from pyspark.sql import Window as W

    first = F.row_number().over(W.partitionBy("token").orderBy("at")) == 1
    age = F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("issued_at").cast("timestamp"))
    return attempts.join(tokens, "token", "left").select("token", "at", (F.coalesce((age >= 0) & (age <= seconds * 1_000_000), F.lit(False)) & first).alias("accepted"))
