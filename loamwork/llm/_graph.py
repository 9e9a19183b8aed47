"""Connected components of links that may not fit on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, class_id) for every node of the links (columns a, b): the smallest node of its component.

    Alternates large-star and small-star steps (each node points its larger neighbours, then its smaller ones, at the smallest it knows) until no
    link changes. Links stay distributed and are written to the shared folder after each round. A node's links shrink to one. A hub's links
    are never gathered: minima are combined before the shuffle, and links meet their node's minimum in a join whose large partitions adaptive execution splits.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = session.written(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        before_edges, edges = edges, session.written(small, "links")
        session.drop(before_edges)
        session.let_go(links.sparkSession)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class_id")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("class_id"))).distinct()
