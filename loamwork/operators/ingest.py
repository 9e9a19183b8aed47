"""Incremental ingestion: what changed, stale rows, entity merge, upserts by rewritten tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changes(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """files (workspace_id, source_path, text) with checksum and status: created, updated or skipped (unchanged, blank path or empty text)."""
    now = files.withColumn("checksum", F.sha2("text", 256))
    before = ledger.select("workspace_id", "source_path", F.col("checksum").alias("before"))
    blank = (F.trim(F.coalesce("source_path", F.lit(""))) == "") | (F.coalesce(F.length("text"), F.lit(0)) == 0)
    status = F.when(blank | F.col("checksum").eqNullSafe(F.col("before")), "skipped").when(F.col("before").isNull(), "created").otherwise("updated")
    return now.join(before, ["workspace_id", "source_path"], "left").withColumn("status", status).drop("before")


def counters(changed: DataFrame, *by: str) -> DataFrame:
    """Numbers of created, updated and skipped files."""
    return changed.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("created", "updated", "skipped")])


def doc_identity(files: DataFrame, known: DataFrame) -> DataFrame:
    """files with doc_key: an existing key of the path alone in the same workspace stays, else workspace and path make it."""
    scoped = F.substring(F.sha1(F.concat_ws(":", "workspace_id", "source_path")), 1, 16)
    old = F.substring(F.sha1("source_path"), 1, 16)
    rows = files.withColumn("_old", old)
    have = known.select(F.col("doc_key").alias("_old"), "workspace_id", F.lit(True).alias("_has")).distinct()
    return rows.join(have, ["_old", "workspace_id"], "left").withColumn("doc_key", F.when(F.col("_has"), F.col("_old")).otherwise(scoped)).drop("_old", "_has")


def point_id(raw: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8", prefix: str = "") -> Column:
    """The name-based UUID (version 5) of prefix and raw in a namespace (by default that of URLs), from the bits of a SHA-1 hash."""
    hashed = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(F.concat(F.lit(prefix), raw), "UTF-8")))
    part = lambda a, n: F.substring(hashed, a, n)
    # the hexadecimal digit with the variant has 8 to b
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def stale(old: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """Keys that the new rows no longer have."""
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def merge_entities(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row for each (uri, workspace_id): aliases and ACLs of both sides, old ones first, each once and without blanks."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda s: F.trim(s)), lambda x: x != "")
    a, b = existing.alias("a"), incoming.alias("b")
    joined = a.join(b, (F.col("a.uri") == F.col("b.uri")) & (F.col("a.workspace_id") == F.col("b.workspace_id")), "full")
    both = lambda c: F.array_union(tidy(F.col(f"a.{c}")), tidy(F.col(f"b.{c}")))
    return joined.select(F.coalesce("a.uri", "b.uri").alias("uri"), F.coalesce("a.workspace_id", "b.workspace_id").alias("workspace_id"), F.coalesce("a.name", "b.name").alias("name"), both("aliases").alias("aliases"), both("acl_allow").alias("acl_allow"))


def last_writer(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key by the given order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in place of those of equal keys."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def backfill(entities: DataFrame, batch: int, embed: Callable[[DataFrame, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(embedded, counters): entities with text are embedded, so many by a call of the model; seen, indexed and skipped are counted."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    ready = entities.where(F.col("search_text").isNotNull())
    counts = entities.agg(F.count(F.lit(1)).alias("seen"), F.count("search_text").alias("indexed"), F.count_if(F.col("search_text").isNull()).alias("skipped"))
    return embed(ready, batch), counts
