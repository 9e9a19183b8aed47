"""Approximate nearest neighbours by an inverted multi-index.

1. Equal vectors are one entry with its KEEP smallest ids (no more can be among a query's neighbours). A query vector is looked up once, too.
2. Unit vectors are cut in two halves; each half is quantised with its own codebook, fitted on at most FIT_ROWS entries. A pair of codes is a cell;
   every entry is indexed in its cell. Large cells are split in blocks of BLOCK entries.
3. A query visits cells by rising sum of its halves' squared distances to the codes (multi-sequence search with a heap) until they hold `visit` of all
   entries, and LEAST entries at least. `visit` is what the fitting sample needs for the target recall against brute force.
4. Blocks are gathered in groups of about GROUP entries, and a query is sent once to each group in which it visits any block. There each task reranks by cosine in double precision on the original vectors. Products of
   whole blocks choose, and the scores of what they choose are summed anew in one order, so that a score does not depend on the block it was found in.

Defined results: vectors that are null or zero or hold null or non-finite components take no part, nor do those whose length is not the commonest; a vec_id that
repeats counts once for each different vector; rows with a null vec_id take no part; fewer candidates than k give all; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow

K = 5
FIT_ROWS, FIT_QUERIES, STEPS = 20_000, 400, 15
LEAST, BLOCK, GROUP = 2_000, 4_096, 32_768
#: Queries whose best entries a task holds at once.
HELD = 20_000
TARGET = 0.96
#: Entries for each cell on average, and most codes of a half.
CELL, MOST_CODES = 128, 256
#: More blocks than a cell can have.
MOST_BLOCKS = 1 << 40


def entries(vectors: DataFrame, keep: int, every: int) -> DataFrame:
    """key, vec (doubles), the smallest ids and the asked ids of each different vector of a batch; vectors that take no part are left out."""
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    clean = clean.where("vec_id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vec, x -> x <> 0)")
    sizes = clean.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).limit(1).collect()
    n = sizes[0]["n"] if sizes else 0

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy().reshape(-1, n) + 0.0
            found: dict[bytes, list[int]] = {}
            for k, vec_id in enumerate(batch.column("vec_id").to_pylist()):
                found.setdefault(rows[k].tobytes(), []).append(vec_id)
            keys = [hashlib.md5(x).digest() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(found), pa.binary()), pa.array([sorted(set(i))[:keep] for i in found.values()], pa.list_(pa.int64())), pa.array([[i for i in set(x) if i % every == 0] for x in found.values()], pa.list_(pa.int64()))], ["key", "vec", "ids", "asked"])

    got = _arrow.map_batches(clean.where(F.size("vec") == n), join, "key binary, vec binary, ids array<bigint>, asked array<bigint>")
    return got


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components between 1/2 and 1: cosines stay the same to the last bit, and no square runs over or
    vanishes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if x.size else x


def _codebook(x: np.ndarray, codes: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's steps."""
    c = x[rng.choice(len(x), codes, replace=False)].copy()
    for _ in range(STEPS):
        near = _distances(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=codes)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)


class MultiIndex:
    """Codebooks of both halves; cells are numbered first code * codes + second code."""

    def __init__(self, sample: np.ndarray, codes: int, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.codes, self.half = codes, max(1, sample.shape[1] // 2)
        unit = self.unit(sample)
        self.books = [_codebook(unit[:, : self.half], codes, rng), _codebook(unit[:, self.half :], codes, rng)]

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        x = scaled(x)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u = self.unit(x)
        return _distances(u[:, : self.half], self.books[0]), _distances(u[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.both(x)
        return a.argmin(axis=1) * self.codes + b.argmin(axis=1)

    def visits(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
        """Cells with entries in the order of a's and b's summed distance, until they hold enough entries."""
        first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[first].tolist(), b[second].tolist()
        first, second = first.tolist(), second.tolist()
        heap, out, have = [(x[0] + y[0], 0, 0)], [], 0
        reached = [0] * self.codes  # in row i the columns before reached[i] are out of the heap
        while heap and have < enough:
            _, i, j = heapq.heappop(heap)
            reached[i] = j + 1
            cell = first[i] * self.codes + second[j]
            if counts[cell]:
                out.append(cell)
                have += int(counts[cell])
            # a cell is pushed when its left and upper neighbours have been visited
            if i + 1 < self.codes and reached[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < self.codes and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        return out


def needed_share(index: MultiIndex, sample: np.ndarray, k: int, target: float, seed: int = 4) -> float:
    """Share of the sample that must be visited to meet `target` of the k true neighbours of sample queries."""
    rng = np.random.default_rng(seed)
    asked = rng.choice(len(sample), min(len(sample), FIT_QUERIES), replace=False)
    unit = index.unit(sample)
    cell = index.cells(sample)
    counts = np.bincount(cell, minlength=index.codes**2)
    a, b = index.both(sample[asked])
    need = []
    for q, x, y in zip(asked, a, b, strict=True):
        s = unit @ unit[q]
        s[q] = -np.inf
        top = np.argpartition(-s, min(k, len(s) - 1))[:k]
        order = np.argsort((x[:, None] + y[None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), np.int64)
        upto[order] = np.cumsum(counts[order])
        need += upto[cell[top]].tolist()
    return float(np.quantile(need, target) / len(sample)) if need else 1.0


def search(vectors: DataFrame, k: int = K, every: int = 50, target: float = TARGET) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    _arrow.prepare(spark)
    keep = k + 1
    parts = session.written(entries(vectors, keep, every), "vector-parts")
    merged = session.written(parts.groupBy("key").agg(F.first("vec").alias("vec"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")), "vectors")
    asked = parts.select("key", F.explode("asked").alias("query_id")).distinct()
    n = merged.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    sample = np.stack([np.frombuffer(bytes(r["vec"])) for r in merged.orderBy(F.xxhash64("key"), "key").select("vec").limit(FIT_ROWS).collect()])
    codes = max(1, min(MOST_CODES, len(sample), int(2 ** np.floor(np.log2(max(1.0, np.sqrt(n / CELL)))))))
    index = MultiIndex(sample, codes)
    share = needed_share(index, sample, k, target) if n > LEAST and len(sample) > k else 1.0
    enough = n if n <= LEAST else int(max(LEAST, share * n))
    sent = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("vec")]) if batch.num_rows else np.zeros((0, sample.shape[1]))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.cells(x).astype(np.int32)), *batch.columns], ["cell", *batch.schema.names])

    placed = _arrow.map_batches(merged, assign, "cell int, key binary, vec binary, ids array<bigint>")
    counts = np.zeros(codes * codes, np.int64)
    for r in placed.groupBy("cell").count().collect():  # a row for each cell, MOST_CODES squared at most
        counts[r["cell"]] = r["count"]
    blocks = np.maximum(1, -(-counts // BLOCK))
    before, each = np.cumsum(counts) - counts, -(-counts // blocks)
    held = spark.sparkContext.broadcast((counts, blocks, before, each, enough))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_of, blocks_of, before_of, each_of, least = held.value
        for batch in batches:
            x = np.stack([np.frombuffer(v.as_buffer()) for v in batch.column("vec")]) if batch.num_rows else np.zeros((0, 1))
            if not len(x):
                continue
            a, b = sent.value.both(x)
            for q in range(len(x)):
                to = np.array(sent.value.visits(a[q], b[q], n_of, least), np.int64)
                cell = np.repeat(to, blocks_of[to])
                block = np.arange(len(cell)) - np.repeat(np.cumsum(blocks_of[to]) - blocks_of[to], blocks_of[to])
                group = (before_of[cell] + block * each_of[cell]) // GROUP
                order = np.argsort(group, kind="stable")
                at = np.flatnonzero(np.append(True, np.diff(group[order]) != 0)) if len(order) else order
                units = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array((cell * MOST_BLOCKS + block)[order]))
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(group[order][at]), pa.array([batch.column("key")[q].as_py()] * m, pa.binary()), pa.array([batch.column("vec")[q].as_py()] * m, pa.binary()), units], ["group", "key", "vec", "units"])

    lookups = merged.join(asked.select("key").distinct(), "key", "left_semi").select("key", "vec")
    probes = _arrow.map_batches(lookups, route, "group long, key binary, vec binary, units array<bigint>")
    # a row for each cell, MOST_CODES squared at most
    info = spark.createDataFrame([(int(c), int(blocks[c]), int(before[c]), int(each[c])) for c in np.flatnonzero(counts)], "cell int, blocks int, before long, each long")
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    stored = placed.join(F.broadcast(info), "cell").withColumn("block", block).withColumn("group", F.floor((F.col("before") + F.col("block") * F.col("each")) / F.lit(GROUP)))
    unit = F.col("cell").cast("long") * F.lit(MOST_BLOCKS) + F.col("block")
    none = lambda t: F.lit(None).cast(t)
    rows = stored.select("group", unit.alias("unit"), "key", "vec", "ids", none("array<bigint>").alias("units")).unionByName(probes.select("group", none("long").alias("unit"), "key", "vec", none("array<bigint>").alias("ids"), "units"))
    dealt = rows.repartition("group").sortWithinPartitions("group", F.col("unit").asc_nulls_last())

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[tuple[float, int, list[int]]]] = {}
        now: int | None = None
        raw: list[bytes] = []
        names: list[list[int]] = []
        places: list[int] = []
        block = norms = bounds = None

        def ask(keys: list[bytes], vecs: list[bytes], units: pa.ListArray) -> None:
            nonlocal block, norms, bounds
            if not raw:
                return
            if block is None:
                block = scaled(np.frombuffer(b"".join(raw)).reshape(len(raw), -1))
                norms = np.sqrt(np.einsum("ij,ij->i", block, block))
                unit = np.array(places, np.int64)
                at = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
                bounds = dict(zip(unit[at].tolist(), zip(at.tolist(), np.append(at[1:], len(unit)).tolist(), strict=True), strict=True))
            q = scaled(np.frombuffer(b"".join(vecs)).reshape(len(vecs), -1))
            lengths = np.sqrt(np.einsum("ij,ij->i", q, q))
            asks = units.flatten().to_numpy()
            by = np.repeat(np.arange(len(units)), units.value_lengths().to_numpy())
            order = np.argsort(asks, kind="stable")
            cut = np.flatnonzero(np.append(True, np.diff(asks[order]) != 0))
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for x, y in zip(cut, np.append(cut[1:], len(order)), strict=True):
                a, b = bounds.get(int(asks[order[x]]), (0, 0))
                if a == b:
                    continue
                who = by[order[x:y]]
                s = (q[who] @ block[a:b].T) / (lengths[who][:, None] * norms[None, a:b])
                m = min(keep, b - a)
                row, col = np.nonzero(s >= np.partition(s, b - a - m, axis=1)[:, b - a - m][:, None] - 1e-9)
                found.append((who[row], a + col))
            if not found:
                return
            who, which = (np.concatenate(c) for c in zip(*found, strict=True))
            exact = (block[which] * q[who]).sum(axis=1) / (lengths[who] * norms[which])
            first = np.array([n[0] for n in names], np.int64)[which]
            order = np.lexsort((first, -exact, who))
            order = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) < keep]
            for k, i, e in zip(who[order].tolist(), which[order].tolist(), exact[order].tolist(), strict=True):
                own = best.setdefault(keys[k], [])
                own.append((-e, names[i][0], names[i]))
                if len(own) > 4 * keep:
                    own.sort()
                    del own[keep:]

        def found() -> Iterator[pa.RecordBatch]:
            out = [(q, -s, ids) for q, own in best.items() for s, _, ids in sorted(own)[:keep]]
            best.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(pa.int64()))], ["key", "score", "ids"])

        for batch in batches:
            if len(best) >= HELD:
                yield from found()
            group, stands = batch.column("group").to_numpy(), batch.column("unit").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (stands[1:] != stands[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if group[a] != now:
                    now, block, raw, names, places = int(group[a]), None, [], [], []
                part = batch.slice(a, b - a)
                if stands[a]:
                    raw += part.column("vec").to_pylist()
                    names += part.column("ids").to_pylist()
                    places += part.column("unit").to_pylist()
                else:
                    ask(part.column("key").to_pylist(), part.column("vec").to_pylist(), part.column("units"))
        yield from found()

    near = _arrow.map_batches(dealt, rerank, "key binary, score double, ids array<bigint>")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")))
    lists = near.groupBy("key").agg(F.slice(ordered, 1, keep).alias("found"))
    flat = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("vec_id")))))
    chosen = lists.select("key", flat.alias("found")).join(asked, "key").select("query_id", F.slice(F.array_sort(F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))), 1, k).alias("found"))
    return chosen.select("query_id", F.posexplode("found").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return search(session.table(spark, sf_dir, "embeddings"))
