"""Near-duplicate documents: improved consistent weighted sampling (ICWS) over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

Shingles are SHINGLE consecutive words (all words of a shorter text). A shingle's weight is its count in the text times the mean idf of its words;
idf = 1 + ln(min(N / df, RARE)) / ln(RARE), from exact document frequencies of words. (A shingle's own df would count its copies: in a group of
thousands of copies what they share would weigh next to nothing, and the group would fall apart. Words' df hardly depend on copies.) Words rarer than one
document in RARE weigh alike, whatever the corpus, so only the common words' df are sent to the tasks: MOST_WORDS at most, since their df sum to the words of the corpus.

1. Equal texts are one text. Each text gets BANDS * ROWS ICWS samples; texts that agree on all samples of a band share a bucket.
2. Every text of a bucket is paired with the bucket's first. Pairs are verified on whole texts; links (similarity of THRESHOLD or more) are joined to
   classes. Then the texts that are not in a bucket's largest class are paired with LEADERS of that class, and what is verified joins classes, too:
   so a large group of copies becomes one class by a number of pairs that grows with its texts. Buckets within one class are settled, however
   large; so are buckets of two texts.
3. The texts of all other buckets are joined exactly: in one global order of shingles (rarest first), texts of similarity THRESHOLD or more share
   a shingle in the heads of their lists, and what both weigh from there on reaches the overlap that the threshold asks for. So texts that have no more
   in common than one frequent passage don't meet. Long lists are cut in blocks; pairs of one class are never made. What meets is verified and joined to classes.

Defined results: equal texts (empty ones too; null is empty) are one class; a text without words is near to nothing else; rows are judged by their texts, so
rows that repeat a doc_id with another text may be of another class; a class is named by its smallest doc_id (null if it has none); an empty table gives
no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _graph, _words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 3
RARE, MOST_WORDS = 1000, 1 << 20
#: Texts of a bucket's largest class that its other texts are paired with in the second round.
LEADERS = 3
#: Bytes of text that are held as shingles at a time.
PIECE = 4 << 20
#: Columns of the sketch that orders shingles, and of its rows.
WIDTH, DEPTH = 1 << 18, 2
#: Entries of a shingle's list that are searched at once.
BLOCK = 1 << 15
_BITS = 14
_SEED = 5


class Weights:
    """idf of words by their hashes."""

    def __init__(self, hashes: np.ndarray, df: np.ndarray, n_docs: int, rare: float = RARE) -> None:
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.idf = self.value(df[order], n_docs, rare)
        self.other = float(self.value(np.zeros(1), n_docs, rare)[0])

    @staticmethod
    def value(df: np.ndarray, n_docs: int, rare: float) -> np.ndarray:
        return 1 + np.log(np.clip(max(n_docs, 1) / np.maximum(df, 1), 1, rare)) / np.log(RARE)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), self.other)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.idf[at], self.other)


def word_weights(docs: DataFrame) -> Weights:
    """Exact document frequencies of the words that more than one document in RARE has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches, most=PIECE):
            words = _words.split(batch.column("text"), "space")
            n = len(words.vocab)
            if not n:
                continue
            doc = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(words.bounds))
            key = np.sort(doc * n + words.codes)
            found = np.bincount(key[np.append(True, key[1:] != key[:-1])] % n, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(words.hashes().view(np.int64)), pa.array(found)], ["word", "n"])

    n_docs = docs.count()
    total = _arrow.map_batches(docs.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("df"))
    common = session.written(total.where(F.col("df") * RARE > n_docs), "common-words")
    kinds, incidences = common.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    rare = RARE
    if kinds > MOST_WORDS:  # texts of thousands of different words: fewer words than incidences / floor have a df above the floor
        floor = -(-int(incidences) // MOST_WORDS)
        rare, common = n_docs / floor, common.where(F.col("df") > floor)
    found = common.toArrow()  # MOST_WORDS rows at most
    return Weights(found["word"].to_numpy().view(np.uint64), found["df"].to_numpy(), n_docs, rare)


class Shingles:
    """Weighted shingles of texts: hashes[bounds[d]:bounds[d + 1]] (rising) with weights."""

    def __init__(self, texts: pa.Array, weights_of: Weights, width: int = SHINGLE) -> None:
        words = _words.split(texts, "space")
        hashes = words.hashes()
        idf = weights_of.of(hashes)
        h, w = hashes[words.codes] if len(hashes) else np.zeros(0, np.uint64), idf[words.codes] if len(hashes) else np.zeros(0)
        n = np.diff(words.bounds)
        run = _words.rolling(h, width)
        total = np.concatenate([[0], np.cumsum(w)])
        first = _words.ragged(words.bounds[:-1], np.maximum(n - width + 1, 0))
        ids, weights = run[first], (total[first + width] - total[first]) / width
        doc = np.repeat(np.arange(len(texts)), np.maximum(n - width + 1, 0))
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            whole = [np.uint64(hash_words(h[words.bounds[d] : words.bounds[d + 1]])) for d in short]
            ids = np.concatenate([ids, np.array(whole, np.uint64)])
            weights = np.concatenate([weights, [w[words.bounds[d] : words.bounds[d + 1]].mean() for d in short]])
            doc = np.concatenate([doc, short])
        order = np.lexsort((ids, doc))
        ids, weights, doc = ids[order], weights[order], doc[order]
        new = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (doc[1:] != doc[:-1]))) if len(ids) else np.zeros(0, np.int64)
        counts = np.diff(np.append(new, len(ids)))
        # all occurrences of a shingle weigh the same
        self.hashes, self.weights = ids[new], weights[new] * counts
        self.bounds = np.searchsorted(doc[new], np.arange(len(texts) + 1))

    def of(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[d], self.bounds[d + 1]
        return self.hashes[a:b], self.weights[a:b]


def hash_words(h: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "little")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Sampler:
    """ICWS with tables of 2**_BITS draws; an element's draws are picked by its hash."""

    def __init__(self, samples: int = BANDS * ROWS) -> None:
        rng = np.random.default_rng(_SEED)
        self.factors = (rng.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
        self.r = rng.gamma(2, 1, 1 << _BITS).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, 1 << _BITS)).astype(np.float32)
        self.samples = samples

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A 64-bit name of the sampled (element, level) for each sample."""
        log_w = np.log(weights).astype(np.float32)
        best = np.full(self.samples, np.inf, np.float32)
        name = np.zeros(self.samples, np.uint64)
        rows = np.arange(self.samples)
        for s in range(0, len(hashes), 4096):
            h, lw = hashes[s : s + 4096], log_w[s : s + 4096]
            x = h[None, :] * self.factors
            at = (x >> np.uint64(64 - _BITS)).astype(np.int64)
            r = self.r[at]
            beta = ((x >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            t = np.floor(lw * self.inverse[at] + beta)
            c = self.log_c[((x >> np.uint64(36)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)]
            a = c - r * (t - beta + 1)
            k = a.argmin(axis=1)
            value = a[rows, k]
            better = value < best
            best[better] = value[better]
            level = t[rows, k].astype(np.int64).astype(np.uint64)
            name[better] = _words.mix(h[k] ^ _words.mix(level + np.uint64(77)))[better]
        return name


SIGNED = "doc_id long, text_hash binary, bands array<bigint>"


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """Text hash and band keys of every document; texts without words have no bands."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        salt = _words.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(1))
        for batch in _words.pieces(batches, most=PIECE):
            texts = batch.column("text")
            shingles = Shingles(texts, sent.value)
            data, offsets = _words.buffers(texts)
            raw = data.tobytes()
            digest, bands = [], []
            for d in range(batch.num_rows):
                digest.append(hashlib.md5(raw[offsets[d] : offsets[d + 1]]).digest())
                hashes, weights = shingles.of(d)
                if not len(hashes):
                    bands.append([])
                    continue
                names = sampler(hashes, weights)
                key = salt
                for column in names.reshape(BANDS, ROWS).T:
                    key = _words.mix(key ^ column) + salt
                bands.append(key.view(np.int64))
            out = [batch.column("doc_id"), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "bands"])

    return session.written(_arrow.map_batches(docs, sign, SIGNED), "signatures")


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Of the pairs (a, b) those of similarity `threshold` or more, with it; texts: node and text of all that are paired."""
    sent = pairs.sparkSession.sparkContext.broadcast(weights)
    # a text with many partners is an a: its partners' texts come to it, in as many tasks as the join is split into
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(_words.pieces(batches, "text_a", PIECE // 2), "text_b", PIECE // 2):
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]).dictionary_encode()
            shingles = Shingles(both.dictionary, sent.value)
            code = both.indices.to_numpy()
            n = batch.num_rows
            value = np.array([weighted_jaccard(shingles.of(code[i]), shingles.of(code[n + i])) for i in range(n)])
            near = pa.array(value >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(near), batch.column("b").filter(near), pa.array(value).filter(near)], ["a", "b", "similarity"])

    return session.written(_arrow.map_batches(both, compare, "a long, b long, similarity double"), "near-links")


def shingle_sketch(texts: DataFrame, weights: Weights) -> np.ndarray:
    """Upper bounds of how many texts have a shingle, by its columns. It only orders shingles: any one order, the same in all tasks, gives the same links."""
    sent = texts.sparkSession.sparkContext.broadcast(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH * WIDTH, np.int32)
        for batch in _words.pieces(batches, most=PIECE):
            hashes = Shingles(batch.column("text"), sent.value).hashes
            for row in columns(hashes):
                total += np.bincount(row, minlength=DEPTH * WIDTH).astype(np.int32)
        yield _arrow.vector_row(total)

    return _arrow.sum_vectors(_arrow.map_batches(texts.select("text"), count, "vector binary"), "int32", DEPTH * WIDTH)


def columns(hashes: np.ndarray) -> np.ndarray:
    """A column of the sketch for each shingle and each row of the sketch."""
    return np.stack([(_words.mix(hashes ^ np.uint64(d * 0x9E3779B9 + 1)) % np.uint64(WIDTH)).astype(np.int64) + d * WIDTH for d in range(DEPTH)])


HEADS = "shingle long, node long, class_id long, total double, rest double"


def heads(texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The first shingles of each text, rarest first, with what the text weighs from there on (rest): as long as rest is threshold * total or more."""
    spark = texts.sparkSession
    sketch = spark.sparkContext.broadcast(shingle_sketch(texts, weights))
    sent = spark.sparkContext.broadcast(weights)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches, most=PIECE):
            shingles = Shingles(batch.column("text"), sent.value)
            often = sketch.value[columns(shingles.hashes)].min(axis=0) if len(shingles.hashes) else np.zeros(0, np.int32)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(shingles.bounds))
            order = np.lexsort((shingles.hashes, often, doc))
            sums = np.concatenate([[0], np.cumsum(shingles.weights[order])])
            total = sums[shingles.bounds[1:]] - sums[shingles.bounds[:-1]]
            rest = sums[shingles.bounds[1:]][doc] - sums[:-1]
            # a shingle that no other text has leads to none
            some = np.flatnonzero((rest >= (threshold - 1e-9) * total[doc]) & (often[order] > 1))
            own = pa.array(doc[some])
            out = [pa.array(shingles.hashes[order[some]].view(np.int64)), batch.column("node").take(own), batch.column("class_id").take(own), pa.array(total[doc[some]]), pa.array(rest[some])]
            yield pa.RecordBatch.from_arrays(out, ["shingle", "node", "class_id", "total", "rest"])

    return session.written(_arrow.map_batches(texts, emit, HEADS), "heads")


def indexed(total: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Entries at which the lighter text of a pair can have its first common shingle."""
    return rest >= (2 * threshold / (1 + threshold) - 1e-9) * total


def meetings(lists: np.ndarray, node: np.ndarray, classes: np.ndarray, total: np.ndarray, rest: np.ndarray, index: np.ndarray, asks: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs (rows a < b) of nodes of different classes that may reach the threshold: entries of one list, of which one is indexed and the other asks."""
    if not index.any() or not asks.any():
        return np.zeros((0, 2), np.int64)
    _, group = np.unique(lists, return_inverse=True)
    # of the class that a list has most of, entries needn't ask one another
    order = np.lexsort((classes, group))
    cut = np.append(True, (group[order][1:] != group[order][:-1]) | (classes[order][1:] != classes[order][:-1]))
    run = np.cumsum(cut) - 1
    sizes = np.bincount(run)
    at = np.flatnonzero(cut)
    best = np.lexsort((sizes, group[order][at]))
    last = np.append(group[order][at][best][1:] != group[order][at][best][:-1], True)
    pivot = np.zeros(group.max() + 1, np.int64)
    pivot[group[order][at][best][last]] = classes[order][at][best][last]
    common = classes == pivot[group]
    scale = 1 / (total.max() * 1.001 + 1)
    found = [np.zeros((0, 2), np.int64)]
    share = threshold / (1 + threshold)
    for ask, held in ((asks & common, index & ~common), (asks & ~common, index)):
        ask, held = np.flatnonzero(ask), np.flatnonzero(held)
        if not len(ask) or not len(held):
            continue
        key = group[held] + total[held] * scale
        held = held[np.argsort(key, kind="stable")]
        key = np.sort(key)
        most = np.minimum(total[ask], rest[ask] / share - total[ask])
        low = np.searchsorted(key, group[ask] + np.maximum(threshold * total[ask] * scale - 1e-9, 0))
        high = np.searchsorted(key, group[ask] + most * scale + 1e-9, side="right")
        n = np.maximum(high - low, 0)
        ends = np.cumsum(n)
        start = 0
        while start < len(ask):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + (1 << 20), side="right")))
            i = np.repeat(ask[start:stop], n[start:stop])
            j = held[_words.ragged(low[start:stop], n[start:stop])]
            need = (share - 1e-9) * (total[i] + total[j])
            good = (group[i] == group[j]) & (classes[i] != classes[j]) & (rest[i] >= need) & (rest[j] >= need)
            both = np.stack([node[i[good]], node[j[good]]], axis=1)
            both.sort(axis=1)
            found.append(np.unique(both, axis=0))
            start = stop
    return np.unique(np.concatenate(found), axis=0)


def cross_pairs(texts: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """All pairs (a, b) of different classes that may be similar; texts: node, class_id and text. Lists of shingles meet in tasks, in blocks of bounded size."""
    rows = heads(texts, weights, threshold)
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    met = rows.join(shared.select("shingle", blocks.alias("blocks")), "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = met.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    can = F.col("rest") >= F.lit(2 * threshold / (1 + threshold) - 1e-9) * F.col("total")
    met = met.withColumn("index", can & (F.col("own") == F.col("block"))).select("shingle", "block", "index", "node", "class_id", "total", "rest")
    # a block's indexed entries come first
    dealt = met.repartition("shingle", "block").sortWithinPartitions("shingle", "block", F.col("index").desc())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        kind = np.dtype([("shingle", "i8"), ("block", "i4"), ("index", "?"), ("node", "i8"), ("class_id", "i8"), ("total", "f8"), ("rest", "f8"), ("asks", "?")])

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            pairs = meetings(rows["shingle"], rows["node"], rows["class_id"], rows["total"], rows["rest"], rows["index"], rows["asks"], threshold)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            rows = np.zeros(batch.num_rows, kind)
            for name in batch.schema.names:
                rows[name] = batch.column(name).to_numpy(zero_copy_only=False)
            rows["asks"] = True
            held.append(rows)
            size += len(rows)
            if size < 4 * BLOCK:
                continue
            whole = np.concatenate(held)
            yield from flush(whole)
            # the last list may go on: what is indexed is asked by what follows
            tail = whole[(whole["shingle"] == whole["shingle"][-1]) & (whole["block"] == whole["block"][-1]) & whole["index"]]
            tail["asks"] = False
            held, size = [tail], len(tail) if len(tail) < 2 * BLOCK else 0
        if held:
            yield from flush(np.concatenate(held))

    return session.written(_arrow.map_batches(dealt, meet, "a long, b long").distinct(), "cross-pairs")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_hash, class_id (smallest doc_id of its class), text_id (smallest doc_id with the same text), class_texts and first of each document row.

    first: the row has the smallest (doc_id, text hash) of its class; more rows than one have it only if doc_id and text repeat.
    """
    spark = docs.sparkSession
    _arrow.prepare(spark)
    docs = _arrow.texts(docs)
    weights = word_weights(docs)
    signed = signatures(docs, weights)
    # one row for each different text, with a number; copies agree in everything else
    low = F.min(F.col("doc_id")).alias("doc_id")
    firsts = session.written(signed.groupBy("text_hash").agg(low, F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "texts")
    keys = firsts.select("node", F.explode("bands").alias("key"))
    buckets = session.written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1"), "buckets")
    members = session.written(keys.join(buckets, "key").select("key", "node", "leader", "n"), "members")
    paired = firsts.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("doc_id").alias("own_id"), "text_hash")
    hashed = docs.withColumn("own_hash", F.unhex(F.md5("text")))
    texts = hashed.join(paired, hashed["doc_id"].eqNullSafe(paired["own_id"]) & (F.col("own_hash") == F.col("text_hash")))
    texts = session.written(texts.groupBy("node").agg(F.first("text").alias("text")), "paired-texts")
    pairs = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    found = verify(pairs, texts, weights, threshold)
    classes = session.written(_graph.components(found.select("a", "b")), "classes")
    done = [found]
    session.let_go(spark)
    second = verify(leading_pairs(members, classes), texts, weights, threshold)
    classes = joined(classes, second)
    left = open_texts(members, classes, texts)
    if not left.isEmpty():
        done.append(verify(cross_pairs(left, weights, threshold), texts, weights, threshold))
        classes = joined(classes, done[-1])
    owned = firsts.select("node", "doc_id", "text_hash").join(classes, "node", "left").select("node", "doc_id", "text_hash", F.coalesce("class_id", "node").alias("class"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = owned.groupBy("class").agg(F.min(order).alias("low"), F.count(F.lit(1)).alias("class_texts"))
    named = owned.join(named, "class").select("text_hash", F.col("doc_id").alias("text_id"), F.col("low.doc_id").alias("class_id"), F.col("low.text_hash").alias("class_hash"), "class_texts")
    named = session.written(named, "named-texts")
    # what is done with goes, so that the shared folder holds no more than is needed
    session.drop(buckets, members, texts, second, left, firsts, classes, *done)
    head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    return signed.select("doc_id", "text_hash").join(named, "text_hash").select("doc_id", "text_hash", "class_id", "text_id", "class_texts", head.alias("first"))


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The classes after more links (columns a, b) between texts."""
    if links.isEmpty():
        return classes
    of = lambda c: classes.select(F.col("node").alias(c), F.col("class_id").alias(f"class_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("class_a", "a").alias("a"), F.coalesce("class_b", "b").alias("b"))
    between = session.written(_graph.components(ends), "classes-joined")
    nodes = classes.unionByName(between.select("node", F.col("node").alias("class_id"))).groupBy("node").agg(F.min("class_id").alias("own"))
    now = nodes.join(between.select(F.col("node").alias("own"), "class_id"), "own", "left").select("node", F.coalesce("class_id", "own").alias("class_id"))
    made = session.written(now, "classes")
    session.drop(classes, between)
    return made


def known_members(members: DataFrame, classes: DataFrame) -> DataFrame:
    """key, node and class of the texts of buckets of three and more."""
    return members.where("n > 2").join(classes, "node", "left").select("key", "node", F.coalesce("class_id", "node").alias("class_id"))


def leading_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b): texts of a bucket's largest class, and all its texts of other classes."""
    known = known_members(members, classes)
    leaders = [F.min_by("node", F.xxhash64("node", "key", F.lit(i))).alias(f"leader{i}") for i in range(LEADERS)]
    each = known.groupBy("key", "class_id").agg(F.count(F.lit(1)).alias("n"), *leaders)
    top = each.groupBy("key").agg(F.max(F.struct("n", "class_id", *(f"leader{i}" for i in range(LEADERS)))).alias("top"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    others = known.join(top, "key").where(F.col("class_id") != F.col("top.class_id"))
    return others.select(F.explode(F.array(*(f"top.leader{i}" for i in range(LEADERS)))).alias("a"), F.col("node").alias("b")).distinct()


def open_texts(members: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """node, class_id and text of the texts in buckets that hold several classes."""
    known = known_members(members, classes)
    open_ = known.groupBy("key").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low < high").select("key")
    left = known.join(open_, "key", "left_semi").select("node", "class_id").distinct()
    return session.written(texts.join(left, "node"), "open-texts")


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(session.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "text_id", "class_texts")
