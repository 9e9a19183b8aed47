"""Chunking strategies: each gives an array of (start, end) spans for a text column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import text
from loamwork.operators import embedding


def char(value: Column, most: int = text.MAX_CHARS, overlap: int = text.OVERLAP) -> Column:
    return text.char_spans(F.length(value), None, most, overlap)


def sentence(value: Column, most: int = text.MAX_CHARS, overlap: int = text.OVERLAP) -> Column:
    """Sentences are packed up to `most`; a longer sentence is cut in windows."""
    return text.cut_long(text.pack_spans(text.tiles(text.sentences(value)), most), most, overlap)


def code(value: Column, language: str = "python", most: int = text.MAX_CHARS, overlap: int = text.OVERLAP) -> Column:
    """Blocks begin at top-level definitions (Python), or after blank lines; short neighbours are joined, long blocks cut in windows."""
    lines = F.filter(F.regexp_extract_all(value, F.lit(r"[^\n]*\n|[^\n]+$"), F.lit(0)), lambda x: x != "")
    spans = F.zip_with(text.tiles(lines), lines, lambda s, x: F.struct(s["start"].alias("start"), s["end"].alias("end"), x.alias("line")))
    if language == "python":
        begins = lambda prev, line: line.rlike(r"^(def |class |async def )")
    else:
        begins = lambda prev, line: (F.trim(F.regexp_replace(prev, r"\s+", "")) == "") & (F.regexp_replace(line, r"\s+", "") != "")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit("x").alias("prev"), empty.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = (acc["start"] >= 0) & begins(acc["prev"], s["line"])
        return F.struct(
            F.when((acc["start"] < 0) | new, s["start"]).otherwise(acc["start"]).alias("start"),
            s["end"].alias("end"),
            s["line"].alias("prev"),
            F.when(new, F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).otherwise(acc["out"]).alias("out"),
        )

    def finish(acc: Column) -> Column:
        last = F.struct(acc["start"].alias("start"), acc["end"].alias("end"))
        blank = (acc["end"] - acc["start"] <= most) & F.substring(value, acc["start"] + 1, acc["end"] - acc["start"]).rlike(r"^\s*$")
        return F.when((acc["start"] < 0) | blank, acc["out"]).otherwise(F.concat(acc["out"], F.array(last)))

    return text.pack_spans(text.cut_long(F.aggregate(spans, zero, step, finish), most, overlap), most)


def like_blocks(sentences: Column, threshold: float, dimensions: int) -> Column:
    """Array of (start, end) of runs of neighbouring sentences whose cosines are at least threshold, for arrays of sentences that tile a text. Array functions
    would copy the array for each sentence; this is linear in the text."""
    session.ship(SparkSession.active())

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def find(values: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = values.flatten()
        ends = np.cumsum(pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        begins = embedding.neighbour_cosines(flat, dimensions) < threshold
        begins[first] = True
        at = np.flatnonzero(begins)
        own = np.repeat(np.arange(len(sizes)), sizes)
        base = np.concatenate([[0], ends])[np.repeat(first, sizes[sizes > 0])]  # characters of the rows before
        start = np.concatenate([[0], ends])[at] - base[at]
        last = np.append(at[1:], len(flat)) - 1
        end = ends[last] - base[last] if len(at) else at
        bounds = np.concatenate([[0], np.cumsum(np.bincount(own[at], minlength=len(sizes)))])
        made = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made)

    return find(sentences)


def semantic(df: DataFrame, column: str = "text", threshold: float = 0.5, most: int = text.MAX_CHARS, overlap: int = text.OVERLAP, merge: bool = True, dimensions: int = 384) -> DataFrame:
    """df with a column `spans`: sentences are split where neighbours' embeddings have a cosine below threshold, then short neighbours are joined.

    A row's sentences become an array, and blocks of it are found over whole batches.
    """
    value = F.col(column)
    rows = df.withColumn("_s", text.sentences(value))
    blocks = like_blocks(F.col("_s"), threshold, dimensions)
    spans = text.cut_long(blocks, most, overlap)
    spans = text.pack_spans(spans, most) if merge else spans
    return rows.withColumn("spans", F.when(F.size("_s") <= 1, char(value, most, overlap)).otherwise(spans)).drop("_s")


def spans(df: DataFrame, mode: str = "char", column: str = "text", path: str | None = None, most: int = text.MAX_CHARS, overlap: int = text.OVERLAP, threshold: float = 0.5) -> DataFrame:
    """df with a column `spans` by the named strategy: semantic, code (Python for paths that end in .py, else by blank lines), sentence, and char for all other names."""
    if mode == "semantic":
        return semantic(df, column, threshold, most, overlap)
    value = F.col(column)
    if mode == "code":
        is_python = F.endswith(F.col(path), F.lit(".py")) if path else F.lit(True)
        return df.withColumn("spans", F.when(is_python, code(value, "python", most, overlap)).otherwise(code(value, "generic", most, overlap)))
    return df.withColumn("spans", sentence(value, most, overlap) if mode == "sentence" else char(value, most, overlap))
