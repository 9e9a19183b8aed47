"""Embeddings: an interface, the deterministic fallback, presets, batching over different texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork import session

# Preset -> model, dimensions, query prefix, passage prefix.
PRESETS = {
    "multilingual-e5-large": ("intfloat/multilingual-e5-large", 1024, "query: ", "passage: "),
    "paraphrase-multilingual": ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384, "", ""),
    "bge-m3": ("BAAI/bge-m3", 1024, "", ""),
    "all-MiniLM-L6-v2": ("sentence-transformers/all-MiniLM-L6-v2", 384, "", ""),
}


#: Texts of one call of a model, unless told otherwise.
CALL = 512


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Fallback:
    """Counts of bytes; components 256 to 259 are the numbers of words, characters, digits and capitals; of length 1."""

    def __init__(self, dimensions: int = 384) -> None:
        self.dimensions = dimensions

    def one(self, text: str) -> np.ndarray:
        n = self.dimensions
        raw = np.frombuffer(text.encode("utf-8", "ignore"), np.uint8)
        out = np.zeros(n)
        if not len(raw):
            return out
        counts = np.bincount(raw, minlength=256).astype(float)
        np.add.at(out, np.arange(256) % n, counts)
        extra = [len(text.split()), len(text), sum(map(str.isdigit, text)), sum(map(str.isupper, text))]
        for k, x in enumerate(extra):
            if n > 256 + k:
                out[256 + k] = x
        return out / np.linalg.norm(out)

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.stack([self.one(t or "") for t in texts]) if len(texts) else np.zeros((0, self.dimensions))


class WithFallback:
    """A model whose failures are made good by another: batch by batch, or (batch of 0) for a whole call. Vectors are cut or filled to its dimensions."""

    def __init__(self, model: Embedder, other: Embedder, batch: int = 0) -> None:
        self.model, self.other, self.batch, self.dimensions = model, other, batch, other.dimensions

    def _one(self, texts: list[str]) -> np.ndarray:
        try:
            found = np.asarray(self.model.embed(texts), float)
            if len(found) != len(texts):
                raise ValueError("a vector for each text")
            fitted = np.zeros((len(texts), self.dimensions))
            n = min(self.dimensions, found.shape[1])
            fitted[:, :n] = found[:, :n]
            return fitted
        except Exception:  # whatever a remote model may raise
            return self.other.embed(texts)

    def embed(self, texts: list[str]) -> np.ndarray:
        step = self.batch or max(len(texts), 1)
        parts = [self._one(texts[i : i + step]) for i in range(0, len(texts), step)]
        return np.concatenate(parts) if parts else np.zeros((0, self.dimensions))


_ASCII = re.compile(r"[\x00-\x7f]+")
#: Texts whose counts of bytes are held at once.
COUNTED = 2048


def neighbour_cosines(texts: pa.Array, dimensions: int) -> np.ndarray:
    """The cosine of each text's fallback vector and that of the text before it (the first one's is 0; 0 where a vector is zero). Counts of bytes are
    taken over slices of the buffer, in whole numbers, so there is no call for each text or character."""
    out = np.zeros(len(texts))
    last = np.zeros((1, 260), np.int64)
    for low in range(0, len(texts), COUNTED):
        some = texts.slice(low, COUNTED)
        values = ["" if v is None else v for v in some.to_pylist()]
        raw = np.frombuffer("".join(values).encode("utf-8", "ignore"), np.uint8)
        sizes = np.array([len(v) if v.isascii() else len(v.encode("utf-8", "ignore")) for v in values], np.int64)
        n = len(values)
        counts = np.zeros((n, 260), np.int64)
        counts[:, :256] = np.bincount(np.repeat(np.arange(n), sizes) * 256 + raw, minlength=n * 256).reshape(n, 256)
        counts[:, 256] = [len(v.split()) for v in values]
        counts[:, 257] = [len(v) for v in values]
        counts[:, 258], counts[:, 259] = counts[:, 48:58].sum(1), counts[:, 65:91].sum(1)
        for k, v in enumerate(values):
            if not v.isascii():
                rest = _ASCII.sub("", v)
                counts[k, 258] += sum(map(str.isdigit, rest))
                counts[k, 259] += sum(map(str.isupper, rest))
        if dimensions < 256:
            folded = np.zeros_like(counts)
            np.add.at(folded.T, np.arange(256) % dimensions, counts[:, :256].T)
            counts = folded
        else:
            counts[:, dimensions:] = 0
        before = np.concatenate([last, counts[:-1]])
        norm = np.sqrt((counts * counts).sum(1)) * np.sqrt((before * before).sum(1))
        np.divide((counts * before).sum(1), norm, out=out[low : low + n], where=norm > 0)
        last = counts[-1:]
    return out


def embed_column(df: DataFrame, column: str, model: Embedder, output: str = "embedding", preset: str = "all-MiniLM-L6-v2", passage: bool = True, batch: int = 0) -> DataFrame:
    """df with a vector for each row; every different text is embedded once, with the preset's prefix; batch: texts of one call of the model (0: at most CALL).

    Vectors leave a task call by call, and meet the rows by a merge join: their size can't be told before they are made, so they are never sent out whole.
    """
    spark = df.sparkSession
    session.ship(spark)
    prefix, step = PRESETS[preset][3 if passage else 2], batch or CALL

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for low in range(0, part.num_rows, step):
                own = part.column("_text").slice(low, step)
                found = np.asarray(model.embed([prefix + (x or "") for x in own.to_pylist()]), np.float64)
                if len(found) != len(own):
                    raise ValueError("a vector for each text")
                ends = pa.array(np.arange(len(own) + 1, dtype=np.int32) * found.shape[1])
                yield pa.RecordBatch.from_arrays([own, pa.ListArray.from_arrays(ends, pa.array(found.ravel()))], ["_text", output])
        session.trim()

    unique = df.select(F.col(column).cast("string").alias("_text")).distinct().mapInArrow(embed, f"_text string, `{output}` array<double>")
    return df.join(unique.hint("merge"), df[column].eqNullSafe(unique["_text"]), "left").drop("_text")


CACHE = "key string, vec array<double>, used_at timestamp"


def cache_key(text: Column, model: str, revision: str, preset: str, passage: bool) -> Column:
    """What a vector is kept under: a hash of model, revision, prefix and text."""
    prefix = PRESETS[preset][3 if passage else 2]
    return F.sha2(F.concat_ws("\x00", F.lit(model), F.lit(revision), F.concat(F.lit(prefix), F.coalesce(text, F.lit("")))), 256)


def embed_cached(df: DataFrame, column: str, model: Embedder, cache: DataFrame, at: Column, name: str, revision: str, output: str = "embedding", preset: str = "all-MiniLM-L6-v2", passage: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(df with vectors, the cache after it, counts): different texts that the cache (CACHE) has for this model and revision are taken from there, and only
    others are embedded; both are marked as used at the time `at`. counts: one row with texts, cached and embedded. A null text is an empty one."""
    session.ship(df.sparkSession)
    keyed = df.withColumn("_key", cache_key(F.col(column), name, revision, preset, passage))
    texts = keyed.groupBy("_key").agg(F.first(F.coalesce(column, F.lit(""))).alias("text"))
    known = cache.select(F.col("key").alias("_key"), "vec")
    met = session.written(texts.join(known.hint("merge"), "_key", "left"), "cache-met")
    fresh = embed_column(met.where("vec IS NULL").select("_key", "text"), "text", model, "vec", preset, passage)
    vectors = session.written(met.where("vec IS NOT NULL").select("_key", "vec", F.lit(True).alias("cached")).unionByName(fresh.select("_key", "vec", F.lit(False).alias("cached"))), "vectors")
    used = vectors.select(F.col("_key").alias("key"), "vec", at.cast("timestamp").alias("used_at"))
    after = cache.join(used.select("key").hint("merge"), "key", "left_anti").select("key", "vec", "used_at").unionByName(used)
    counts = vectors.agg(F.count(F.lit(1)).alias("texts"), F.count_if("cached").alias("cached"), F.count_if(~F.col("cached")).alias("embedded"))
    return keyed.join(vectors.select("_key", F.col("vec").alias(output)).hint("merge"), "_key", "left").drop("_key"), after, counts


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The cache with its `most` entries that were used last; entries that were last used at the same instant as the last of them stay as well.

    That instant is found by counting, not by sorting the cache in one task."""
    from loamwork.operators import evaluate

    micros = F.unix_micros("used_at").cast("double")
    ranked = evaluate.at_ranks(cache.select(F.lit(1).alias("all"), micros.alias("used")), "all", "used", [F.greatest(F.lit(1), F.col("n") - most + 1)])
    return cache.join(F.broadcast(ranked.select(F.col("v").alias("_least"))), micros >= F.col("_least")).drop("_least") if most > 0 else cache.limit(0)
