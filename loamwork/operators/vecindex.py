"""One vector index for chunks, entities and memory: cells around centroids, filters inside, upserts and deletions by key, exact where asked.

Centroids are fitted on a bounded sample; the index then holds every vector. A task puts the vectors of its rows into blocks, each of one cell and of bounded
size, so a cell that holds a third of all vectors is many blocks, and building moves nothing. A search asks the blocks of the cells whose centroids are
nearest to a query (or all: exact), beside those of their items that the filter lets through. A batch of blocks is multiplied with the queries at once, and
what can be among a query's k best by that product is scored by itself: cosines in double precision of the vectors as they were given. Only k of each query
leave a batch, and none that k better ones of the same task stand before. Vectors that are null, zero, or hold what is no finite number are never found and never ask.
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

#: Vectors of a block and of the sample for centroids at most; rounds of fitting; bytes of queries that are sent at once.
BLOCK, SAMPLE, ROUNDS, QUERY_BYTES = 4096, 20_000, 8, 8 << 20
#: Items and queries whose products are held at once, numbers that are held for exact scores, and by how much a product may be off.
ITEMS, QUERIES, NUMBERS, OFF = 2048, 256, 1 << 20, 1e-9


@dataclass(frozen=True)
class Index:
    """items: block, number, uri and carried columns; blocks: block, cell, vectors (binary doubles); centroids of the cells, of length 1."""

    items: DataFrame
    blocks: DataFrame
    centroids: np.ndarray
    carried: tuple[str, ...] = ()


def usable(x: np.ndarray) -> np.ndarray:
    """Which rows are vectors that take part."""
    return np.isfinite(x).all(1) & (x != 0).any(1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square runs over or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(vectors: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of length 1 by rounds of assignment to the nearest cosine; a cell that loses all its vectors keeps its centroid."""
    rng = np.random.default_rng(seed)
    found = vectors[np.sort(rng.permutation(len(vectors))[:cells])]
    for _ in range(ROUNDS):
        own = (vectors @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, vectors)
        some = (sums != 0).any(1)
        found[some] = unit(sums[some])
    return found


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their vectors)."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes)
    flat = column.flatten()
    if len(at) and not flat.null_count and (sizes[at] == sizes[at[0]]).all():
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(at), -1)
    else:
        values = [(k, v) for k, v in enumerate(column.to_pylist()) if v and None not in v]
        if not values:
            return np.zeros(0, np.int64), np.zeros((0, 1))
        at, x = np.array([k for k, _ in values], np.int64), np.array([v for _, v in values], np.float64)
    good = usable(x)
    return at[good], x[good]


def build(items: DataFrame, carry: list[str] | None = None, cells: int | None = None, centroids: np.ndarray | None = None) -> Index:
    """The index of items (uri, vec and the carried columns), written to the shared folder. cells: by default the square root of the number of vectors,
    at most 4,096; centroids: those of another index, instead of fitted ones."""
    spark = items.sparkSession
    session.ship(spark)
    carry = [c for c in carry or [] if c not in ("uri", "vec")]
    rows = items.select("uri", F.col("vec").cast("array<double>").alias("vec"), *carry)
    if centroids is None:
        n = rows.where(F.size("vec") > 0).count()
        share = min(1.0, 1.2 * SAMPLE / max(n, 1))
        sample = rows.select("vec") if share == 1.0 else rows.select("vec").sample(share, seed=7)
        _, x = _vectors(pa.array([r[0] for r in sample.limit(SAMPLE).collect()], pa.list_(pa.float64())))
        centroids = fit(unit(x), max(1, min(cells or int(n**0.5), 4096, len(x)))) if len(x) else np.zeros((0, 1))
    kind = lambda c: items.schema[c].dataType.simpleString()
    schema = f"block long, number int, uri {kind('uri')}, " + "".join(f"{c} {kind(c)}, " for c in carry) + "cell int, vectors binary"
    made = session.written(rows.mapInArrow(lambda x: _build(x, carry, centroids), schema), "vector-index")
    return Index(made.where("number IS NOT NULL").drop("cell", "vectors"), made.where("number IS NULL").select("block", "cell", "vectors"), centroids, tuple(carry))


def _build(batches: Iterator[pa.RecordBatch], carry: list[str], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    names = ["uri", *carry]
    held: dict[int, tuple[list[pa.RecordBatch], list[np.ndarray]]] = {}
    size: dict[int, int] = {}

    def block(cell: int) -> Iterator[pa.RecordBatch]:
        rows, vectors = held.pop(cell)
        n, number = size.pop(cell), uuid.uuid4().int >> 65
        table = pa.Table.from_batches(rows)
        own = [x.chunk(0) if isinstance(x := table.column(c).combine_chunks(), pa.ChunkedArray) else x for c in names]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n), pa.int32()), *own, pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["block", "number", *names, "cell", "vectors"])
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int32()), *(pa.nulls(1, x.type) for x in own), pa.array([cell], pa.int32()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], ["block", "number", *names, "cell", "vectors"])

    for batch in batches:
        at, x = _vectors(batch.column("vec"))
        if not len(at):
            continue
        cell = (unit(x) @ centroids.T).argmax(1)
        for c in np.unique(cell).tolist():
            mine = np.flatnonzero(cell == c)
            for low in range(0, len(mine), BLOCK):
                some = mine[low : low + BLOCK]
                if size.get(c, 0) + len(some) > BLOCK:
                    yield from block(c)
                rows, vectors = held.setdefault(c, ([], []))
                rows.append(batch.select(names).take(pa.array(at[some])))
                vectors.append(x[some])
                size[c] = size.get(c, 0) + len(some)
        while sum(size.values()) > 16 * BLOCK:  # so that a task holds few vectors, whatever the number of cells
            yield from block(max(size, key=size.get))
    for c in list(held):
        yield from block(c)


def updated(index: Index, gone: DataFrame, fresh: DataFrame) -> Index:
    """The index without the items of `gone` (uri) and with `fresh` ones (uri, vec, carried), which replace items of the same uri; blocks are only added."""
    added = build(fresh, list(index.carried), centroids=index.centroids) if len(index.centroids) else build(fresh, list(index.carried))
    dead = gone.select("uri").unionByName(fresh.select("uri")).distinct()
    return Index(index.items.join(dead, "uri", "left_anti").select(*index.items.columns).unionByName(added.items), index.blocks.unionByName(added.blocks), added.centroids, index.carried)


def search(queries: DataFrame, index: Index, k: int, keep: Column | None = None, probes: int | None = None) -> DataFrame:
    """(qid, uri, score, rank): the k nearest items by cosine for each query (qid, vec), ties by uri; keep: a filter over the carried columns; probes: cells that
    each query visits (all by default: exact). Queries go out in blocks of bounded size."""
    from loamwork.operators.vector import top

    spark = index.items.sparkSession
    session.ship(spark)
    items = index.items if keep is None else index.items.where(keep)
    items = items.select("block", "number", "uri")
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, uri {items.schema['uri'].dataType.simpleString()}, score double"
    asked = queries.select("qid", F.col("vec").cast("array<double>").alias("vec"))
    parts = max(1, -(-asked.count() * index.centroids.shape[1] * 8 // QUERY_BYTES))
    # a block has a bounded number of items
    let = items.groupBy("block").agg(F.collect_list(F.struct("number", "uri")).alias("items"))
    out = None
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == p).collect()
        at, x = _vectors(pa.array([r["vec"] for r in rows], pa.list_(pa.float64())))
        if not len(at) or not len(index.centroids):
            continue
        x = unit(x)
        by_cell, visited = None, index.blocks
        if probes and probes < len(index.centroids):
            near = (x @ index.centroids.T).argsort(1)[:, ::-1][:, :probes]
            order = np.argsort(near, axis=None, kind="stable")
            cells, first = np.unique(near.ravel()[order], return_index=True)
            by_cell = dict(zip(cells.tolist(), np.split(order // probes, first[1:]), strict=True))
            visited = visited.where(F.col("cell").isin(sorted(by_cell)))
        sent = spark.sparkContext.broadcast(([rows[i]["qid"] for i in at.tolist()], x, by_cell))
        found = visited.hint("merge").join(let, "block").select("cell", "vectors", "items").mapInArrow(_finder(sent, k), kinds)
        out = found if out is None else out.unionByName(found)
    return top(spark.createDataFrame([], kinds) if out is None else out, k, F.desc("score"), F.col("uri"))


def _first(q: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best items of each query, by query; equal scores: smaller items first."""
    order = np.lexsort((item, -score, q))
    own = q[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[place < k]


def best(x: np.ndarray, asked: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, item, score): the k nearest of the items x to each query asked, both of length 1, equal scores by place, without what scores less than the
    query's `least`; that is raised where k are found."""
    found = []
    step = max(1, NUMBERS // x.shape[1])
    for a in range(0, len(asked), QUERIES):
        ask, low = asked[a : a + QUERIES], least[a : a + QUERIES]
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for b in range(0, len(x), ITEMS):
            part = x[b : b + ITEMS]
            s = ask @ part.T
            cut = low if len(part) <= k else np.maximum(low, np.partition(s, len(part) - k, axis=1)[:, len(part) - k])
            q, item = np.nonzero(s >= cut[:, None] - OFF)
            # row by row, so that equal vectors have equal scores
            score = np.concatenate([np.zeros(0), *((part[item[i : i + step]] * ask[q[i : i + step]]).sum(1) for i in range(0, len(q), step))])
            some = score >= low[q]
            q, item, score = q[some], item[some] + b, score[some]
            some = _first(q, item, score, k)
            q, item, score = q[some], item[some], score[some]
            full = np.flatnonzero(np.bincount(q, minlength=len(ask)) == k)
            low[full] = np.maximum(low[full], score[np.searchsorted(q, full, side="right") - 1])
            parts.append((q, item, score))
        q, item, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        some = _first(q, item, score, k)
        found.append((q[some] + a, item[some], score[some]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _finder(sent, k: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, asked, by_cell = sent.value
        qids = pa.array(qids)
        least = np.full(len(asked), -np.inf)
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            for rows in [np.arange(len(cells))] if by_cell is None else [np.flatnonzero(cells == c) for c in np.unique(cells)]:
                if not len(rows):
                    continue
                own = batch.take(pa.array(rows))
                items = own.column("items")
                numbers = np.split(items.flatten().field("number").to_numpy(), np.cumsum(pc.list_value_length(items).to_numpy())[:-1])
                x = np.concatenate([np.frombuffer(v.as_buffer(), np.float64).reshape(-1, asked.shape[1])[n] for v, n in zip(own.column("vectors"), numbers, strict=True)])
                uris = items.flatten().field("uri")
                order = pc.sort_indices(uris)
                x, uris = unit(x[order.to_numpy()]), uris.take(order)
                mine = np.arange(len(asked)) if by_cell is None else by_cell[int(cells[rows[0]])]
                low = least[mine]
                q, item, score = best(x, asked[mine], low, k)
                least[mine] = low
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(mine[q])), uris.take(pa.array(item)), pa.array(score)], ["qid", "uri", "score"])
        session.trim()

    return find
