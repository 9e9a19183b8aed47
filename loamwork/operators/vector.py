"""Top-k search for sets of queries: by shared tokens (through an inverted index, see lexindex) and by cosine.

Queries go out in blocks of bounded size. Where all items that share a token with a query are asked for, and not the best k, every item is looked at once for a
block, where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loamwork import session
from loamwork.functions import text
from loamwork.operators import lexindex

#: Queries that are sent to tasks at a time; more queries make more passes.
QUERY_BLOCK = 4096
#: Scores that are held at once.
CELLS = 1 << 18


def top(df: DataFrame, k: int, *by: Column, key: str = "qid", rank: str = "rank") -> DataFrame:
    """The first k rows of each key, with their rank from 1."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(*by))).where(F.col(rank) <= k)


def _blocks(queries: DataFrame, *columns: Column) -> Iterator[list]:
    """Rows of queries in blocks of about QUERY_BLOCK."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).select("qid", *columns).collect()
        if rows:
            yield rows


class _Asked:
    """A block of queries as lists of the queries that have each token."""

    def __init__(self, words: list[list[str]], scopes: list[str]) -> None:
        number: dict[str, list[int]] = {}
        for k, own in enumerate(words):
            for w in own:
                number.setdefault(w, []).append(k)
        self.tokens = list(number)
        self.at = np.concatenate([[0], np.cumsum([len(q) for q in number.values()])]).astype(np.int64)
        self.queries = np.array([k for q in number.values() for k in q], np.int64)
        self.sizes = np.array([max(len(w), 1) for w in words], np.float64)
        self.names = sorted(set(scopes))
        self.scopes = np.array([self.names.index(s) for s in scopes], np.int64)

    def scores(self, words: pa.Array, scopes: pa.Array, kinds: pa.Array, names: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first item, scores by item and query) for slices of items."""
        step = max(1, CELLS // len(self.sizes))
        for a in range(0, len(words), step):
            part = words.slice(a, step)
            sizes = pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = pc.fill_null(pc.index_in(part.flatten(), value_set=kinds), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            item = np.repeat(np.arange(len(part)), sizes)[found >= 0]
            found = found[found >= 0]
            n = self.at[found + 1] - self.at[found]
            ends = np.cumsum(n)
            place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[found] - (ends - n), n)
            count = np.bincount(np.repeat(item, n) * len(self.sizes) + self.queries[place], minlength=len(part) * len(self.sizes)).reshape(len(part), -1)
            own = pc.fill_null(pc.index_in(scopes.slice(a, step), value_set=names), -1).to_numpy(zero_copy_only=False)
            yield a, np.where(own[:, None] == self.scopes[None, :], count / self.sizes[None, :], 0.0)


def _scope(columns: list[str]) -> Column:
    return F.concat_ws("\x00", *columns).alias("scope") if columns else F.lit("").alias("scope")


def lexical(queries: DataFrame, items: DataFrame, k: int | None = None, scope: list[str] | None = None, least: int = 1) -> DataFrame:
    """(qid, uri, score): share of the query's tokens (of `least` characters or more) in the item, for items (uri, text) that share one or more.

    k: only the k best of each query, ties by uri, by an inverted index of the items (`index` searches one that is there). scope: columns in which query and
    item must be equal.
    """
    if k is not None:
        return indexed(queries, index(items, scope or [], least), k, scope=scope, least=least)
    spark = items.sparkSession
    session.ship(spark)
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, uri {items.schema['uri'].dataType.simpleString()}, score double"
    have = items.select("uri", _words("text", least).alias("words"), _scope(scope or []))
    out = None
    for rows in _blocks(queries, _words("query", least).alias("words"), _scope(scope or [])):
        sent = spark.sparkContext.broadcast(([r["qid"] for r in rows], _Asked([r["words"] or [] for r in rows], [r["scope"] for r in rows])))
        found = have.mapInArrow(_finder(sent), kinds)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kinds) if out is None else out


def _words(column: str, least: int) -> Column:
    words = text.tokens(F.col(column))
    return F.filter(words, lambda t: F.length(t) >= least) if least > 1 else words


def index(items: DataFrame, carry: list[str], least: int = 1) -> lexindex.Index:
    """An inverted index of items (uri, text); carry: columns that searches filter by."""
    return lexindex.build(items, _words("text", least), carry)


def indexed(queries: DataFrame, index: lexindex.Index, k: int, keep: Column | None = None, scope: list[str] | None = None, least: int = 1) -> DataFrame:
    """(qid, uri, score): the k items of the index that hold the largest shares of each query's tokens, ties by uri; keep: a filter over carried columns."""
    blocks = _blocks(queries, _words("query", least).alias("words"), _scope(scope or []))
    found = lexindex.search(blocks, queries.schema["qid"].dataType.simpleString(), index, k, keep, scope)
    return top(found, k, F.desc("score"), F.col("uri")).drop("rank")


def _finder(sent):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked = sent.value
        qids, kinds, names = pa.array(qids), pa.array(asked.tokens, pa.string()), pa.array(asked.names, pa.string())
        for batch in batches:
            for first, scores in asked.scores(batch.column("words"), batch.column("scope"), kinds, names):
                item, q = np.nonzero(scores > 0)
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(q)), batch.column("uri").take(pa.array(first + item)), pa.array(scores[item, q])], ["qid", "uri", "score"])
        session.trim()

    return find


def nearest(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(qid, uri, score, rank): the k items (uri, vec) of largest cosine for each query (qid, vec); exact, in double precision.

    Each task keeps k items of a block's queries, so what is shuffled does not grow with the items in a task.
    """
    spark = items.sparkSession
    session.ship(spark)
    out = None
    for rows in _blocks(queries, F.col("vec").cast("array<double>").alias("vec")):
        sent = spark.sparkContext.broadcast(([r["qid"] for r in rows], np.array([r["vec"] for r in rows])))

        def score(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            qids, q = sent.value
            qn = np.linalg.norm(q, axis=1)
            best: list[pd.DataFrame] = []
            for part in parts:
                if not len(part):
                    continue
                x = np.stack(part["vec"].to_numpy())
                norm = qn[:, None] * np.linalg.norm(x, axis=1)[None, :]
                s = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0)
                m = min(k, len(part))
                cut = np.partition(s, -m, axis=1)[:, -m][:, None]
                row, col = np.nonzero(s >= cut)
                best.append(pd.DataFrame({"qid": np.array(qids, object)[row], "uri": part["uri"].to_numpy()[col], "score": s[row, col]}))
            if best:
                yield pd.concat(best).sort_values(["qid", "score", "uri"], ascending=[True, False, True]).groupby("qid").head(k)

        kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, uri {items.schema['uri'].dataType.simpleString()}, score double"
        found = items.select("uri", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(score, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "qid string, uri string, score double, rank int")
    return top(out, k, F.desc("score"), F.col("uri"))


def put(store: DataFrame, items: DataFrame, vectors: DataFrame) -> DataFrame:
    """The store (uri, payload columns, vec) with items (uri, payload columns) in place of, or beside, its rows; vectors: uri and vec of each item.

    Fails if an item has no vector or several.
    """
    found = vectors.groupBy("uri").agg(F.count(F.lit(1)).alias("_n"), F.first("vec").alias("vec"))
    joined = items.join(found, "uri", "left")
    checked = joined.withColumn("vec", F.when(F.col("_n") == 1, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("vectors and items differ: "), F.col("uri").cast("string"))))).drop("_n")
    return store.join(items.select("uri").distinct(), "uri", "left_anti").unionByName(checked.select(*store.columns))


def remove(store: DataFrame, uris: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(store, count): without the rows of uris that also pass the filter, and how many they were."""
    gone = store.where(keep).join(uris.select("uri").distinct(), "uri", "left_semi").select("uri")
    return store.join(gone, "uri", "left_anti"), gone.agg(F.count(F.lit(1)).alias("deleted"))
