"""Hybrid retrieval for a set of queries: similarity, graph and memory signals, fusion, reranking, evidence."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import scores, text
from loamwork.operators import entities
from loamwork.operators.vector import lexical, top

TOP_K, TOP_N, MOST_K, MOST_DEPTH = 20, 10, 100, 3


def depth_of(mode: str, depth: int) -> int:
    """Steps of graph expansion: none in vector mode; graph and hybrid are the same."""
    return 0 if mode == "vector" else min(depth, MOST_DEPTH)


def rrf(signals: DataFrame, k: int = scores.RRF_K) -> DataFrame:
    """(qid, uri, rrf) of ranked signals (qid, signal, uri, score): sum of 1 / (k + rank) over the signals, ties by uri."""
    ranked = signals.withColumn("rank", F.row_number().over(W.partitionBy("qid", "signal").orderBy(F.desc("score"), "uri")))
    return ranked.groupBy("qid", "uri").agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"))


def fuse(hits: DataFrame, graph: DataFrame, memory: DataFrame, mode: str = "linear") -> DataFrame:
    """Hits (qid, uri, score, lexical) with graph (qid, uri) and memory (qid, uri, memory) bonuses -> vector, graph, memory, base and score of each hit.

    Graph and memory re-score hits; they add none. In rrf mode all of their uris take ranks.
    """
    g = graph.select("qid", "uri").distinct().withColumn("graph", F.lit(1.0))
    m = memory.groupBy("qid", "uri").agg(F.max("memory").alias("memory"))
    rows = hits.withColumnRenamed("score", "vector").join(g, ["qid", "uri"], "left").join(m, ["qid", "uri"], "left").withColumns({"graph": F.coalesce("graph", F.lit(0.0)), "memory": F.coalesce("memory", F.lit(0.0))})
    if mode == "rrf":
        signals = hits.select("qid", F.lit("vector").alias("signal"), "uri", "score").unionByName(g.select("qid", F.lit("graph").alias("signal"), "uri", F.col("graph").alias("score"))).unionByName(m.select("qid", F.lit("memory").alias("signal"), "uri", F.col("memory").alias("score")))
        rows = rows.join(rrf(signals).withColumnRenamed("rrf", "base"), ["qid", "uri"])
    else:
        rows = rows.withColumn("base", scores.linear(F.col("vector"), F.col("graph"), F.col("memory")))
    return rows.withColumn("score", scores.blend(F.col("base"), F.col("lexical"), mode))


def rerank(rows: DataFrame, top_n: int = TOP_N, raw: str = "lexical") -> DataFrame:
    """Mixes in the reranker's score (token overlap unless a model's raw score is given) and keeps the best top_n of each query."""
    mixed = rows.withColumn("score", scores.reranked(F.col("score"), scores.unit_interval(F.col(raw))))
    return top(mixed, top_n, F.desc("score"), F.col("uri"))


class Reranker(Protocol):
    """A model that scores texts for queries; higher is better, on any scale."""

    def score(self, pairs: list[tuple[str, str]]) -> Sequence[float]: ...


def model_scores(rows: DataFrame, queries: DataFrame, chunks: DataFrame, model: Reranker) -> DataFrame:
    """rows (qid, uri) with the column `raw`: the model's scores of query and text (the uri where a text is empty), batch by batch. Where the model fails, or gives
    no score for each pair, a batch gets the shares of query tokens in the texts, as without a model."""
    session.ship(rows.sparkSession)

    @F.pandas_udf("double")
    def judge(query: pd.Series, value: pd.Series) -> pd.Series:
        pairs = list(zip(query.fillna(""), value.fillna(""), strict=True))
        try:
            found = [float(x) for x in model.score(pairs)]
            if len(found) != len(pairs):
                raise ValueError("a score for each pair")
            return pd.Series(found, dtype="float64")
        except Exception:  # whatever a model may raise
            words = [(set(q.lower().split()), set(t.lower().split())) for q, t in pairs]
            return pd.Series([len(q & t) / max(len(q), 1) for q, t in words], dtype="float64")

    value = F.when(F.coalesce("text", F.lit("")) == "", F.col("uri")).otherwise(F.col("text"))
    told = rows.join(queries.select("qid", "query"), "qid").join(chunks.select("uri", "text"), "uri", "left")
    return told.select(*rows.columns, judge(F.col("query"), value).alias("raw"))


def expand_queries(queries: DataFrame, hits: DataFrame, limit: int = 3, least: float = 0.4) -> DataFrame:
    """(qid, expanded): the query and up to `limit` names or aliases of entity hits (qid, rank, score, name, aliases) that it does not hold yet."""
    terms = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("terms")))), lambda x: x["terms"]))
    found = hits.where(F.col("score") >= least).groupBy("qid").agg(terms.alias("terms"))
    q = queries.select("qid", "query").join(found, "qid", "left")
    start = F.array().cast("array<string>")

    def add(acc, term):
        t = F.trim(F.coalesce(term, F.lit("")))
        new = (t != "") & ~F.contains(F.lower("query"), F.lower(t)) & ~F.exists(acc, lambda x: F.lower(x) == F.lower(t)) & (F.size(acc) < limit)
        return F.when(new, F.concat(acc, F.array(t))).otherwise(acc)

    more = F.aggregate(F.coalesce("terms", start), start, add)
    return q.select("qid", F.concat_ws(" ", F.array("query"), more).alias("expanded"))


def evidence(rows: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows (with uri) with title, snippet (masked), citation and entity references; a missing chunk is titled Unknown."""
    c = chunks.select("uri", F.col("doc_uri").alias("_doc"), F.col("text").alias("_text"), F.col("span").alias("_span"), F.col("entity_uris").alias("_ents"))
    d = docs.select(F.col("doc_uri").alias("_doc"), F.col("title").alias("_title"))
    x = rows.join(c, "uri", "left").join(d, "_doc", "left")
    cite = F.when(F.col("_doc").isNotNull(), F.array(F.struct(F.col("_doc").alias("uri"), F.col("uri").alias("chunk_uri"), F.col("_span").alias("span")))).otherwise(F.array().cast("array<struct<uri:string,chunk_uri:string,span:struct<start:int,end:int>>>"))
    refs = F.transform(F.coalesce("_ents", F.array().cast("array<string>")), lambda e: F.struct(e.alias("uri"), F.lit("Entity").alias("type"), F.element_at(F.split(e, "/"), -1).alias("name")))
    return x.select(*rows.columns, F.coalesce("_title", F.lit("Unknown")).alias("title"), text.redact(F.coalesce("_text", F.lit(""))).alias("snippet"), cite.alias("citations"), refs.alias("entities"))


def search(queries: DataFrame, chunks: DataFrame, graph: DataFrame, memory: DataFrame, mode: str = "linear", top_k: int = TOP_K, top_n: int = TOP_N, with_rerank: bool = True, expanded: DataFrame | None = None, find: Callable[[DataFrame, int], DataFrame] | None = None, reranker: Reranker | None = None) -> DataFrame:
    """The whole search: the expanded query finds hits, the original one gives the lexical share.

    find: the hits (qid, uri, score) of queries, so many for each; unless given, by tokens over an index of the chunks. reranker: a model that scores what is
    fused, instead of token overlap.
    """
    asked = queries if expanded is None else expanded.select("qid", F.col("expanded").alias("query"))
    hits = (find or (lambda q, k: lexical(q, chunks, k)))(asked, min(top_k, MOST_K))
    if expanded is None and find is None:
        hits = hits.withColumn("lexical", F.col("score"))
    else:
        share = text.overlap(text.tokens(F.col("query")), text.tokens(F.col("text")))
        # written before it is scored: the hits are few, and two joins and the ranks read them
        hits = session.written(hits, "hits")
        near = chunks.select("uri", "text").join(session.sent(hits.select("uri")), "uri", "left_semi")
        hits = hits.join(queries.select("qid", "query"), "qid").join(near, "uri").select("qid", "uri", "score", share.alias("lexical"))
    fused = fuse(hits, graph, memory, mode)
    if reranker is not None:
        return rerank(model_scores(fused, queries, chunks, reranker), min(top_n, top_k), "raw")
    return rerank(fused, min(top_n, top_k)) if with_rerank else top(fused, top_k, F.desc("score"), F.col("uri"))


def entity_hits(queries: DataFrame, ents: DataFrame, limit: int = 3) -> DataFrame:
    """(qid, rank, score, name, aliases): entities (uri, name, aliases) whose search text is nearest to the query; max(10, 4 * limit) candidates of each."""
    none = F.array().cast("array<string>")
    ents = ents.select("uri", "name", (F.coalesce("aliases", none) if "aliases" in ents.columns else none).alias("aliases"))
    rows = ents.select("uri", "name", "aliases", entities.search_text(F.col("name"), F.col("aliases")).alias("text")).where("text is not null")
    hits = top(lexical(queries, rows, max(10, 4 * limit)), max(10, 4 * limit), F.desc("score"), F.col("uri"))
    return hits.join(rows.select("uri", "name", "aliases"), "uri").select("qid", "rank", "score", "name", "aliases")


def seed_entities(results: DataFrame, limit: int) -> DataFrame:
    """(qid, seeds): the first different entities over the results in order of rank."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct("rank", "entities"))), lambda x: F.transform(x["entities"], lambda e: e["uri"]))
    return results.groupBy("qid").agg(F.slice(F.array_distinct(F.flatten(lists)), 1, limit).alias("seeds"))


def result_uris(results: DataFrame, limit: int) -> DataFrame:
    return results.groupBy("qid").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "uri"))), lambda x: x["uri"])), 1, limit).alias("uris"))


__all__ = ["Reranker", "depth_of", "entities", "entity_hits", "evidence", "expand_queries", "fuse", "model_scores", "rerank", "result_uris", "rrf", "search", "seed_entities"]
