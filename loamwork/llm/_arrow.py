"""Small helpers shared by the operators that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session

#: Rows and bytes in an Arrow batch (a longer row is a batch by itself), so that a batch stays within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds batches for all that this session sends to Python workers from now on (Spark reads the setting when a job runs, so it stays set)."""
    session.ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) != str(BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Gives back memory that a task no longer needs: its worker stays, and may lie idle beside those of other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def texts(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and text alone (null text: empty), whatever else the table has; with carry also all its columns as they are, as a struct `row`."""
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), *row)


def carried(df: DataFrame, columns: list[str]) -> str:
    """The columns of df as they stand in a schema string, after others."""
    return "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in columns)


def ids_of(batch: pa.RecordBatch, column: str = "doc_id") -> list:
    return batch.column(column).to_pylist()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a table's size (for files: their size)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def vector_row(vector, name: str = "vector") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([vector.tobytes()], pa.binary())], [name])


def sum_vectors(df: DataFrame, dtype: str, size: int, tasks: int = 16):
    """The sum of equally long vectors (binary column `vector`): summed in a few streaming tasks, then on the driver. The size is fixed, whatever the rows."""
    import numpy as np

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), dtype)
        yield vector_row(total)

    parts = map_batches(df.select("vector").repartition(tasks), add, "vector binary").collect()
    return sum((np.frombuffer(r[0], dtype) for r in parts), np.zeros(size, dtype))
