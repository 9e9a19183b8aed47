"""Quality classifier: random Fourier features over document statistics, ridge scores from partition-summed normal equations, isotonic calibration.

1. Every document becomes STATISTICS numbers (whole text), written once with its doc_id to the shared folder.
2. Means and spreads over all documents are summed in the partitions.
3. Labelled training rows become random Fourier features of a Gaussian kernel; partitions sum X'X and X'y for each of FOLDS folds (by a hash of
   doc_id); the driver solves FOLDS + 1 ridge systems of fixed size.
4. Each fold's scores by the model that has not seen it fill a histogram, which isotonic regression turns into probabilities.

Defined results: a null or empty text has statistics 0 and is scored like any other; labels that are null are ignored, those that repeat count each;
documents that repeat are scored each; a null doc_id is scored and not learned from (held_out is null); with no labels (or one class alone) all scores
are the smoothed share of label 1; an empty table gives no rows; extra columns are not read unless they are carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _words

FEATURES, FOLDS, RIDGE, GAMMA, SEED = 256, 4, 1.0, 0.04, 17
BINS, LOW, HIGH = 2048, -0.5, 1.5
#: Bytes of labelled statistics that one task sums.
TASK_BYTES = 256 << 20

_CLASS = np.zeros(256, np.int64)  # 0 others, 1 lower case, 2 upper case, 3 digits, 4 sentence marks, 5 other marks, 6 space, 7 line ends, 8 first bytes of further letters, 9 following bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
for _c in b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _CLASS[_c] = 5
for _c in b".,;:?":
    _CLASS[_c] = 4
_CLASS[[32, 9]], _CLASS[[10, 13]] = 6, 7
_CLASS[192:], _CLASS[128:192] = 8, 9


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over each document."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of document statistics for each text."""
    words = _words.split(texts, "space_lower")
    n_docs = len(texts)
    kinds = _CLASS[words.data]
    size = np.maximum(np.diff(words.offsets), 1).astype(np.float64)
    share = [_per_doc(kinds == k, words.offsets) / size for k in (2, 3, 4, 5, 6, 7, 8)]
    same = np.append(False, words.data[1:] == words.data[:-1]) if len(words.data) else np.zeros(0, bool)
    mark = (kinds == 5) | (kinds == 4)
    runs = _per_doc(same & mark, words.offsets) / size
    n = np.diff(words.bounds).astype(np.float64)
    full = np.maximum(n, 1)
    length = (words.ends - words.starts).astype(np.float64)
    mean = _per_doc(length, words.bounds) / full
    spread = np.sqrt(np.maximum(_per_doc(length * length, words.bounds) / full - mean * mean, 0))
    short = _per_doc(length <= 3, words.bounds) / full
    final = words.data[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    ends_marked = _per_doc(_CLASS[final] == 5, words.bounds) / full
    ends_sentence = _per_doc(_CLASS[final] == 4, words.bounds) / full
    lone = _per_doc((length == 1) & (_CLASS[final] == 5), words.bounds) / full
    again = np.append(False, words.codes[1:] == words.codes[:-1]) if len(words.codes) else np.zeros(0, bool)
    repeated = _per_doc(again, words.bounds) / full
    # different words and pairs of a document, as shares of all
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), np.diff(words.bounds))
    key = np.unique(doc * max(len(words.vocab), 1) + words.codes)
    kinds_of = np.bincount(key // max(len(words.vocab), 1), minlength=n_docs) / full
    pair = _words.mix(words.codes[1:].astype(np.uint64) * np.uint64(1 << 31) + words.codes[:-1].astype(np.uint64)) if len(words.codes) > 1 else np.zeros(0, np.uint64)
    inside = doc[1:] == doc[:-1]
    order = np.lexsort((pair[inside], doc[1:][inside]))
    p, d = pair[inside][order], doc[1:][inside][order]
    fresh = np.append(True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])) if len(p) else np.zeros(0, bool)
    pairs = np.bincount(d[fresh], minlength=n_docs) / np.maximum(n - 1, 1)
    lines = _per_doc(kinds == 7, words.offsets) + 1
    columns = [*share, runs, np.log1p(n), np.log1p(mean), np.log1p(spread), short, ends_marked, ends_sentence, lone, repeated, kinds_of, pairs, np.log1p(n / lines)]
    return np.stack(columns, axis=1).astype(np.float32) if n_docs else np.zeros((0, STATISTICS), np.float32)


STATISTICS = 19


def statistics_table(docs: DataFrame, carry: bool = False) -> DataFrame:
    """doc_id and statistics of each document row; with carry also its columns, as a struct `row`."""
    own = _arrow.texts(docs, carry)
    more = ["row"] if carry else []

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            rows = statistics(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary()), *map(batch.column, more)], ["doc_id", "stats", *more])

    return session.written(_arrow.map_batches(own, measure, "doc_id long, stats binary" + _arrow.carried(own, more)), "quality-statistics")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, STATISTICS).astype(np.float64)


def fold_column(doc_id: Column, parts: int = 4) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


class Features:
    """Standardised statistics, then cosines of random projections; the last is 1."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, n: int = FEATURES, gamma: float = GAMMA) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.spread = mean, spread
        self.directions = rng.normal(0, np.sqrt(2 * gamma), (STATISTICS, n))
        self.phases = rng.uniform(0, 2 * np.pi, n)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)


def isotonic(weights: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool-adjacent-violators over bins; rising shares of label 1 (a bin without rows takes its neighbours' value)."""
    prior = hits.sum() / max(weights.sum(), 1)
    blocks: list[list[float]] = []
    for w, h in zip(weights, hits, strict=True):
        blocks.append([h, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            h2, w2, n2 = blocks.pop()
            blocks[-1][0] += h2
            blocks[-1][1] += w2
            blocks[-1][2] += n2
    out = np.concatenate([np.full(int(n), (h + prior) / (w + 1)) for h, w, n in blocks])
    return np.maximum.accumulate(np.clip(out, 0, 1))


def bins_of(score: np.ndarray) -> np.ndarray:
    return np.clip(((score - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)


def fit_and_score(stats: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """labels: doc_id, label (0 or 1), of training rows alone."""
    spark = stats.sparkSession

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * STATISTICS + 1)
        for batch in batches:
            x = _matrix(batch.column("stats"))
            total += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield _arrow.vector_row(total)

    total = _arrow.sum_vectors(_arrow.map_batches(stats.select("stats"), moments, "vector binary"), "float64", 2 * STATISTICS + 1)
    n = max(total[-1], 1)
    mean = total[:STATISTICS] / n
    spread = np.sqrt(np.maximum(total[STATISTICS:-1] / n - mean * mean, 0)) + 1e-6
    make = spark.sparkContext.broadcast(Features(mean, spread))
    known = session.written(
        stats.join(labels, "doc_id").select("stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")),
        "quality-training",
    )
    known = known.coalesce(max(32, _arrow.input_bytes(known) // TASK_BYTES))
    width = FEATURES + 1
    shape = (FOLDS, width + 2, width)  # X'X, X'y, then the number of rows and of labels 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            x, y, fold = make.value(_matrix(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            for f in range(FOLDS):
                own, hit = x[fold == f], y[fold == f]
                total[f, :width] += own.T @ own
                total[f, width] += own.T @ hit
                total[f, width + 1, :2] += len(hit), hit.sum()
        yield _arrow.vector_row(total)

    sums = _arrow.sum_vectors(_arrow.map_batches(known, equations, "vector binary"), "float64", int(np.prod(shape))).reshape(shape)
    rows, ones = sums[:, width + 1, 0].sum(), sums[:, width + 1, 1].sum()
    base = (ones + 1) / (rows + 2)
    flat = rows == 0 or ones in (0, rows)

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:width] + RIDGE * np.eye(width), s[width])

    everything = sums.sum(axis=0)
    weights = [solve(everything)] + [solve(everything - sums[f]) for f in range(FOLDS)]
    sent = spark.sparkContext.broadcast(weights)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for batch in batches:
            x, y, fold = make.value(_matrix(batch.column("stats"))), batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            score = np.einsum("ij,ij->i", x, np.stack(sent.value[1:])[fold]) if len(x) else np.zeros(0)
            np.add.at(total, (0, bins_of(score)), 1)
            np.add.at(total, (1, bins_of(score)), y)
        yield _arrow.vector_row(total)

    counts = _arrow.sum_vectors(_arrow.map_batches(known, histogram, "vector binary"), "float64", 2 * BINS).reshape(2, BINS)
    curve = spark.sparkContext.broadcast(np.full(BINS, base) if flat else isotonic(counts[0], counts[1]))

    more = [c for c in stats.columns if c == "row"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = make.value(_matrix(batch.column("stats"))) @ sent.value[0]
            value = curve.value[bins_of(raw)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), *map(batch.column, more)], ["doc_id", "score", "predicted", *more])

    return _arrow.map_batches(stats, score, "doc_id long, score double, predicted int" + _arrow.carried(stats, more))


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of the rows that may be learned from: crc32 of doc_id as text is not 2 modulo 4."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold_column(F.col("doc_id")) != 2)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted of each document row; with carry also its columns, as a struct `row`."""
    scored = fit_and_score(statistics_table(docs, carry), training_labels(labels, "quality"), threshold)
    return scored.select("doc_id", (fold_column(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted", *(["row"] if carry else []))


def query(spark, sf_dir: str) -> DataFrame:
    return classify(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "labels"))
