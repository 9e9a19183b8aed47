"""Session helpers: the shared working folder, written intermediate tables and Python path of workers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="loamwork-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loamwork-{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        delete_path(spark, path)
    except Exception:  # the session may have ended before; the folder is a scratch folder then cleaned by its owner
        pass


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and lost executors cost nothing that is done."""
    path = fresh_path(df.sparkSession, name)
    with _shuffles_deleted(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete a query's shuffle files when it ends: nothing reads those of a table that was written, and left alone they lie on the executors' disks
    until the driver happens to collect its garbage, beside those of all later steps."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing needs any more; others are left alone."""
    for t in tables:
        if path := t.__dict__.get("_written_at"):
            delete_path(t.sparkSession, path)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect what it no longer needs: only then does Spark remove broadcasts, shuffles and generated classes of plans that are done with, and
    the driver give back memory. Left to itself it waits until the heap is full, which rounds over small tables never let shrink."""
    spark.sparkContext._jvm.System.gc()


#: Rows and bytes in an Arrow batch (a longer row is a batch by itself): Spark's own bound of 10,000 rows is many MB of text in each worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers of a local session import this package (clusters install it or pass it with --py-files), and bounds the batches that they are sent
    from now on (Spark reads the setting when a job runs, so it stays set; a smaller one of the session's own is left alone)."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}", None) or "0"
        size = int(own) if own.lstrip("-").isdigit() else 0
        if not 0 < size <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def trim() -> None:
    """Gives back memory that a task no longer needs: its Python worker stays, and may lie idle beside those of other tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def sent(keys: DataFrame, most: int = 100_000) -> DataFrame:
    """Different keys, marked to be sent to all tasks if they are at most `most`, so that a large table that meets them stays where it lies."""
    keys = keys.distinct()
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
