"""Retrieval quality, latency quantiles, counters and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork import session


def quality(ranked: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, ndcg, mrr) of ranked (qid, item, rank) against relevant (qid, item).

    The gain at rank r is 1 for r = 1 and 1 / log2(r) after. An item counts at its best rank only.
    """
    best = ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank"))
    n = relevant.distinct().groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    hits = best.join(relevant.distinct(), ["qid", "item"])
    gain = F.when(F.col("rank") == 1, F.lit(1.0)).otherwise(1 / F.log2("rank"))
    per = hits.groupBy("qid").agg(F.count_if(F.col("rank") <= k).alias("found"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"), F.min("rank").alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda s, r: s + F.when(r == 1, F.lit(1.0)).otherwise(1 / F.log2(r)))
    rows = n.join(per, "qid", "left")
    return rows.select("qid", F.coalesce(F.col("found") / F.col("n"), F.lit(0.0)).alias("recall"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def coverage(results: DataFrame) -> DataFrame:
    """Share of results (citations) that cite something; no result: 0."""
    return results.agg((F.count_if(F.size("citations") > 0) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("coverage"))


def quantile_exclusive(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """Quantile at place q (n + 1), between neighbours by share, within the values."""
    place = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.lit(q) * (F.col("n") + 1)))
    low = F.floor(place)
    near = at_ranks(df, key, value, [low, F.least(low + 1, F.col("n"))])
    # the second neighbour has a share only where the place lies behind the first
    share = F.when(F.col("which") == 0, 1 - (place - low)).otherwise(place - low)
    return near.groupBy(key).agg(F.sum(F.col("v") * share).alias("q"))


def quantile_lower(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """The value at place floor(q (n - 1)) from 0."""
    return at_ranks(df, key, value, [F.floor(F.lit(q) * (F.col("n") - 1)) + 1]).select(key, F.col("v").alias("q"))


#: Values of a key that are sorted in one task at most; a key of more is narrowed first, by counts in so many intervals.
SORTED, INTERVALS = 100_000, 1024


def at_ranks(df: DataFrame, key: str, value: str, ranks: list[Column], most: int | None = None) -> DataFrame:
    """(key, which, n, v): of each key's n values (without nulls) the ones at the given ranks from 1 (columns over n).

    Keys of up to `most` values are sorted. Of others, values are counted in intervals between the least and the largest one, which tasks sum up before anything
    is sent; the interval that holds the rank is cut again, until it has no more than `most` values, or one value only. The first cut is by magnitude, so
    that a few passes do whatever the values are. Nothing but counts of intervals is gathered for a key.
    """
    most = SORTED if most is None else most
    rows = df.where(F.col(value).isNotNull()).select(F.col(key).alias("_key"), F.col(value).cast("double").alias("v"))
    sizes = session.written(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    wanted = sizes.select("*", F.posexplode(F.array(*(r.cast("long") for r in ranks))).alias("which", "rank"))
    state = wanted.select("_key", "which", "n", "rank", "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    wide = (F.col("inside") > most) & ~F.col("low").eqNullSafe(F.col("high"))
    first = True
    while not state.where(wide).isEmpty():
        state = session.written(_narrowed(rows, state.where(wide), first).unionByName(state.where(~wide)), "ranks")
        first = False
    own = F.col("of").eqNullSafe(F.col("_key")) & F.col("v").between(F.col("low"), F.col("high"))
    held = rows.withColumnRenamed("_key", "of").join(state.where(~F.col("low").eqNullSafe(F.col("high"))), own)
    place = F.row_number().over(W.partitionBy("_key", "which").orderBy("v"))
    sorted_ = held.withColumn("place", place + F.col("below")).where("place = rank").select("_key", "which", "n", "v")
    alone = state.where(F.col("low").eqNullSafe(F.col("high"))).select("_key", "which", "n", F.col("low").alias("v"))
    return sorted_.unionByName(alone).withColumnRenamed("_key", key)


def _narrowed(rows: DataFrame, state: DataFrame, by_magnitude: bool) -> DataFrame:
    """The state with the interval that holds each rank in place of the one before."""
    magnitude = lambda c: F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 1000))  # noqa: E731  (rises with c)
    scale = magnitude if by_magnitude else (lambda c: c)
    v, low, high = (scale(F.col(c)) for c in ("v", "low", "high"))
    part = F.least(F.lit(INTERVALS - 1), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * INTERVALS).cast("int")))
    # what has no place between finite ends stands at its end
    part = F.when(F.col("v") == F.col("high"), INTERVALS).when(F.col("v") == F.col("low"), -1).otherwise(F.coalesce(part, F.lit(0)))
    own = F.col("of").eqNullSafe(F.col("_key")) & F.col("v").between(F.col("low"), F.col("high"))
    counts = rows.withColumnRenamed("_key", "of").join(state, own).groupBy("_key", "which", "n", "rank", "below", part.alias("part")).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("inside"))
    upto = F.sum("inside").over(W.partitionBy("_key", "which").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    placed = counts.withColumn("below", F.col("below") + F.coalesce(upto, F.lit(0)))
    return placed.where((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("inside"))).select(*state.columns)


def histogram(df: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """(key, le, n): how many values are at most each bound (cumulative)."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    rows = df.groupBy(key).agg(*counts)
    return rows.select(key, F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("x")).select(key, "x.le", "x.n")


def rate(df: DataFrame, hit: str, name: str = "rate", *by: str) -> DataFrame:
    """Share of rows where `hit` is true (of each key, if keys are given); 0 without rows."""
    return df.groupBy(*by).agg(F.coalesce(F.count_if(F.col(hit)) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias(name))


def gates(report: dict[str, float]) -> list[str]:
    """Release gates that a report misses."""
    # Thresholds of release gates.
    rules = [("recall", 0.85, 1), ("ndcg", 0.75, 1), ("p95_rerank_ms", 3500, -1), ("p95_ms", 1500, -1)]
    missed = [name for name, bound, sign in rules if name in report and sign * report[name] < sign * bound]
    if report.get("graph_candidates", 0) >= 10 and report.get("graph_nonzero_rate", 1) < 0.70:
        missed.append("graph_nonzero_rate")
    return missed


def benchmark(ranked: DataFrame, relevant: DataFrame, filtered: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean recall, ndcg and mrr over all queries, and over those (qid) that ask with filters, with the numbers of both."""
    per = quality(ranked, relevant, k).join(filtered.select("qid", F.lit(True).alias("_f")).distinct(), "qid", "left").withColumn("_f", F.coalesce("_f", F.lit(False)))
    mean = lambda c, test, name: F.coalesce(F.avg(F.when(test, F.col(c))), F.lit(0.0)).alias(name)
    every = [mean(c, F.lit(True), c) for c in ("recall", "ndcg", "mrr")]
    some = [mean(c, F.col("_f"), f"filtered_{c}") for c in ("recall", "ndcg", "mrr")]
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if("_f").alias("filtered_queries"), *every, *some)


def write_report(report: DataFrame, folder: str) -> list[str]:
    """Writes a report of one row as JSON and returns the gates that it misses."""
    report.coalesce(1).write.mode("overwrite").json(folder)
    return gates(report.first().asDict())
