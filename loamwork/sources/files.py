"""Text files, JSON lines and changed-file lists as tables."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from loamwork import session

#: Extensions that are read unless others are given.
EXTENSIONS = (".md", ".txt", ".py", ".sql")


def documents(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, include: list[str] | None = None) -> DataFrame:
    """source_path, title, source (relative path), tags and text of text files below root.

    Extensions are told apart without regard to case; bytes that are not UTF-8 are dropped. `include` reads only those paths (those outside
    root are left out; an empty list reads nothing).
    """
    root = root.rstrip("/")
    paths = [root] if include is None else [p if p.startswith("/") else f"{root}/{p}" for p in include]
    paths = [p for p in paths if p == root or p.startswith(root + "/")]
    schema = "source_path string, title string, source string, tags array<string>, text string"
    if not paths:
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    path = F.regexp_replace("path", "^file:/*", "/")
    ext = F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))
    rows = raw.withColumn("source_path", path).where(ext.isin([e.lower() for e in extensions]))
    ext = F.lower(F.regexp_extract("source_path", r"\.[^./]*$", 0))
    # invalid bytes decode to the replacement character, which is dropped
    text = F.replace(F.expr("try_validate_utf8(cast(content as string))"), F.lit("�"), F.lit(""))
    text = F.coalesce(text, F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit("")))
    return rows.select(
        "source_path",
        F.element_at(F.split("source_path", "/"), -1).alias("title"),
        F.expr(f"substring(source_path, {len(root) + 2})").alias("source"),
        F.array(F.concat(F.lit("ext:"), F.substring(ext, 2, 100))).alias("tags"),
        text.alias("text"),
    )


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and other values are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").where(F.startswith(F.trim("value"), F.lit("{")))
    return lines.select(F.from_json("value", schema).alias("x")).where("x is not null").select("x.*")


def changed(repo: str, since: str = "HEAD~1", timeout: float = 30) -> list[str]:
    """Paths that git tells as changed; none if it fails or takes too long."""
    try:
        got = subprocess.run(["git", "-C", repo, "diff", "--name-only", since], capture_output=True, text=True, timeout=timeout)
    except (OSError, subprocess.TimeoutExpired):
        return []
    return [x for x in got.stdout.splitlines() if x.strip()] if got.returncode == 0 else []


class GitChanges(DataSource):
    """spark.read.format("git_changes"): root and source_path of the files that git tells as changed in several repositories, each a partition of its own.

    Options: roots (one on a line), since (HEAD~1), timeout (30 seconds). A root where git fails or takes too long has no rows, like changed(). Executors
    must see the repositories. Register it with spark.dataSource.register(GitChanges).
    """

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return "root string, source_path string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _GitReader(self.options)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = [x.strip() for x in options.get("roots", "").splitlines() if x.strip()]
        self.since, self.timeout = options.get("since", "HEAD~1"), float(options.get("timeout", 30))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(root) for root in self.roots]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        for path in changed(partition.value, self.since, self.timeout) if partition is not None else []:
            yield partition.value, path


def changes(spark: SparkSession, roots: list[str], since: str = "HEAD~1") -> DataFrame:
    """root and source_path of changed files of several repositories."""
    session.ship(spark)
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").option("roots", "\n".join(roots)).option("since", since).load()
