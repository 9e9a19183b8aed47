"""An inverted index over items (chunks, memory, entities) for exact top-k searches by shared tokens.

Items are dealt out in shards as they lie, so building moves nothing: a task numbers the items of a shard by uri and writes, for each token, the numbers of
the items that hold it. A search takes from the index only the lists that its queries name, brings them together by shard, beside those items of the shard
that a filter lets through, and finds each query's best k there. A word that all items have is one list of bounded length in each shard, and no key.
Within a shard a query's lists are read shortest first. An item that is in none of those read so far can at most reach the number of lists left: as soon as k
items have more than that, the longer lists are only looked up for items that can still be among the best (exact: equal scores count as reachable).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork import session

#: Items and tokens of a shard at most (an item of more tokens is a shard by itself).
SHARD_ITEMS, SHARD_TOKENS = 16_384, 1 << 20
#: Lists shorter than this are read whole, whatever the bound says.
SHORT = 512


@dataclass(frozen=True)
class Index:
    """items: shard, number, uri and carried columns; lists: shard, token, numbers (binary, rising 32-bit integers)."""

    items: DataFrame
    lists: DataFrame
    carried: tuple[str, ...] = ()


def build(items: DataFrame, words: Column, carry: list[str] | None = None) -> Index:
    """The index of items (uri) with different tokens `words` (array of strings), written to the shared folder. carry: columns to filter searches by."""
    spark = items.sparkSession
    session.ship(spark)
    carry = [c for c in carry or [] if c != "uri"]
    kind = lambda c: items.schema[c].dataType.simpleString()
    schema = f"shard long, number int, uri {kind('uri')}, " + "".join(f"{c} {kind(c)}, " for c in carry) + "token string, numbers binary"
    made = session.written(items.select("uri", *carry, words.alias("_words")).mapInArrow(lambda x: _build(x, carry), schema), "lexical-index")
    return Index(made.where("number IS NOT NULL").drop("token", "numbers"), made.where("number IS NULL").select("shard", "token", "numbers"), tuple(carry))


def updated(index: Index, gone: DataFrame, fresh: DataFrame, words: Column) -> Index:
    """The index without the items of `gone` (uri) and with `fresh` ones, which replace items of the same uri; new shards are added, and no list is written anew."""
    added = build(fresh, words, list(index.carried))
    dead = gone.select("uri").unionByName(fresh.select("uri")).distinct()
    return Index(index.items.join(dead, "uri", "left_anti").select(*index.items.columns).unionByName(added.items), index.lists.unionByName(added.lists), index.carried)


def _build(batches: Iterator[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = tokens = 0
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("_words")), 0).to_numpy(zero_copy_only=False)
        low = 0
        for high in range(1, batch.num_rows + 1):
            if n and (n >= SHARD_ITEMS or tokens + sizes[high - 1] > SHARD_TOKENS):
                held.append(batch.slice(low, high - 1 - low))
                yield from _shard(held, carry)
                held, low, n, tokens = [], high - 1, 0, 0
            n += 1
            tokens += int(sizes[high - 1])
        held.append(batch.slice(low))
    if n:
        yield from _shard(held, carry)
    held.clear()
    session.trim()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def _shard(held: list[pa.RecordBatch], carry: list[str]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    table = table.take(pc.sort_indices(table.column("uri")))
    shard, n = uuid.uuid4().int >> 65, table.num_rows
    own = [_whole(table.column(c)) for c in ("uri", *carry)]
    names = ["shard", "number", "uri", *carry, "token", "numbers"]
    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), pa.array(np.arange(n), pa.int32()), *own, pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], names)
    words = _whole(table.column("_words"))
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    numbers = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))])
    for low in range(0, len(coded.dictionary), 50_000):
        high = min(low + 50_000, len(coded.dictionary))
        at = pa.array((bounds[low : high + 1] - bounds[low]) * 4, pa.int32())
        lists = pa.Array.from_buffers(pa.binary(), high - low, [None, at.buffers()[1], pa.py_buffer(numbers[bounds[low] : bounds[high]].tobytes())])
        none = [pa.nulls(high - low, x.type) for x in own]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(high - low, shard)), pa.nulls(high - low, pa.int32()), *none, coded.dictionary.slice(low, high - low).cast(pa.string()), lists], names)


class Asked:
    """A block of queries: their tokens, and the scope in which each searches."""

    def __init__(self, qids: list, words: list[list[str]], scopes: list[str]) -> None:
        self.qids, self.scopes = qids, scopes
        number: dict[str, int] = {}
        self.words = [np.array([number.setdefault(w, len(number)) for w in own], np.int64) for own in words]
        self.number, self.sizes = number, [max(len(w), 1) for w in words]


def best(lists: list[np.ndarray], allowed: np.ndarray | None, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of the k items that stand in most lists (equal counts: smaller numbers first); allowed: which items may be found (all if None)."""
    lists = sorted(lists, key=len)
    count = np.zeros(n, np.int32)
    left = len(lists)
    chosen = None
    for x in lists:
        if chosen is None and len(x) >= SHORT and left < len(lists):
            live = np.flatnonzero(count if allowed is None else count * allowed)
            if len(live) >= k:
                kth = np.partition(count[live], len(live) - k)[len(live) - k]
                if kth > left:
                    chosen = live[count[live] + left >= kth]
        if chosen is None:
            count[x] += 1
        else:
            at = np.minimum(np.searchsorted(x, chosen), len(x) - 1)
            count[chosen] += x[at] == chosen
        left -= 1
    found = chosen if chosen is not None else np.flatnonzero(count if allowed is None else count * allowed)
    if len(found) > k:
        key = count[found].astype(np.int64) * n + (n - 1 - found)
        found = found[np.argpartition(key, len(found) - k)[len(found) - k :]]
    return found, count[found]


def _search(items: pa.Table, lists: pa.Table, asked: Asked, k: int) -> pa.Table:
    numbers = items.column("number").to_numpy()
    n = int(numbers.max()) + 1 if len(numbers) else 0
    found: dict[int, np.ndarray] = {}
    for token, data in zip(lists.column("token").to_pylist(), lists.column("numbers").to_pylist(), strict=True):
        if (own := asked.number.get(token)) is not None:
            x = np.frombuffer(data, np.int32)
            found[own] = x[: np.searchsorted(x, n)]  # items behind the last allowed one can't be found
    place = np.full(n, -1, np.int64)
    place[numbers] = np.arange(len(numbers))
    scopes = np.array(items.column("scope").to_pylist(), object)
    masks: dict[str, np.ndarray | None] = {}
    for s in set(asked.scopes):
        mask = np.zeros(n, np.int32)
        mask[numbers[scopes == s]] = 1
        masks[s] = None if mask.all() else mask
    q, item, share = [], [], []
    for j, words in enumerate(asked.words):
        own = [found[w] for w in words.tolist() if w in found and len(found[w])]
        if own:
            at, count = best(own, masks[asked.scopes[j]], n, k)
            q += [j] * len(at)
            item.append(place[at])
            share.append(count / asked.sizes[j])
    item = np.concatenate(item) if item else np.zeros(0, np.int64)
    share = np.concatenate(share) if share else np.zeros(0)
    return pa.table({"qid": pa.array(asked.qids).take(pa.array(q, pa.int64())), "uri": items.column("uri").take(pa.array(item)), "score": pa.array(share)})


def search(blocks: Iterator[list], qid_type: str, index: Index, k: int, keep: Column | None = None, scope: list[str] | None = None) -> DataFrame:
    """(qid, uri, score): at most k of each query and shard, among them all of its k best (ties by uri). blocks: rows (qid, words, scope) of queries;
    keep: a filter over the index's carried columns; scope: carried columns in which query and item must be equal."""
    spark = index.items.sparkSession
    session.ship(spark)
    items = index.items if keep is None else index.items.where(keep)
    items = items.select("shard", "number", "uri", (F.concat_ws("\x00", *scope) if scope else F.lit("")).alias("scope"))
    kinds = f"qid {qid_type}, uri {items.schema['uri'].dataType.simpleString()}, score double"
    out = None
    for rows in blocks:
        asked = Asked([r["qid"] for r in rows], [r["words"] or [] for r in rows], [r["scope"] for r in rows])
        if not asked.number:
            continue
        sent = spark.sparkContext.broadcast(asked)
        named = spark.createDataFrame([(w,) for w in asked.number], "token string")
        lists = index.lists.join(named, "token", "left_semi").select(F.col("shard").alias("_shard"), "token", "numbers")
        found = items.groupBy("shard").cogroup(lists.groupBy("_shard")).applyInArrow(_finder(sent, k), kinds)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kinds) if out is None else out


def _finder(sent, k: int):
    def find(items: pa.Table, lists: pa.Table) -> pa.Table:
        found = _search(items, lists, sent.value, k)
        session.trim()  # what a shard took is given back before the next one comes
        return found

    return find
