"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: a shard holds the postings (term -> ascending places) of whole documents, up to SHARD_WORDS words, and is one row of
a table in the shared folder. Lookups go to all shards at once, so no posting list is shuffled and no term can be hot.
A phrase starts from its rarest term in the shard; its places, less the term's offset, are candidate starts, which are intersected with the
offset-adjusted lists of the next rarest terms until all terms agree. An item comes near a document if a share NEAR_SHARE of its different words (at least
near_terms of them, or all if it has fewer) stands in a run of as many words as the item has, and slop more. Of s different words, m of which must be met,
j of any s - m + j are met, so only places where j of the s - m + j rarest in the shard stand together have their surroundings read: which these are, and how
documents are dealt to shards, changes the work and not the result. A word that a shard lacks is one of those that need not be met.

Test items are sent to the tasks in blocks of at most ITEM_BYTES of text, as flat arrays; more items make more blocks, each a pass over the index. Phrases and
items are looked up batch by batch, with no Python object or call for each, so thousands of items cost what their rare words' places cost.

Defined results: a null text has no words; an item without words never occurs; item_ids that repeat count once; the windows of an item without item_id
hit words like any other's, but it is not among the items that are listed, counted and hashed; a document row is judged by itself,
so repeated doc_ids give a row each; a doc_id may be null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _words

WINDOW = 10
NEAR_SHARE = 0.7
SHARD_WORDS = 1 << 20
ITEM_BYTES = 32 << 20
#: Phrases, and places of their or an item's words, that are held at once; rare words of an item that must stand together before a place's surroundings are read.
PHRASES, PLACES, CLOSE = 1 << 15, 1 << 20, 3
INDEX = "doc_ids array<bigint>, digests array<binary>, bounds binary, terms array<binary>, lists binary, places binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard: its documents and their bounds, its terms, where each term's list starts, and all lists of places (differences)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            words = _words.split(batch.column("text"), "alnum")
            order = np.argsort(words.codes, kind="stable").astype(np.int32)
            lists = np.zeros(len(words.vocab) + 1, np.int64)
            np.cumsum(np.bincount(words.codes, minlength=len(words.vocab)), out=lists[1:])
            data, offsets = _words.buffers(batch.column("text"))
            raw = data.tobytes()
            digests = [hashlib.md5(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            cols = [[_arrow.ids_of(batch)], [digests], [words.bounds.astype("<i8").tobytes()], [words.vocab.to_pylist()], [lists.astype("<i8").tobytes()], [np.diff(order, prepend=np.int32(0)).astype("<i4").tobytes()]]
            types = [pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_ids", "digests", "bounds", "terms", "lists", "places"])

    return session.written(_arrow.map_batches(_arrow.texts(docs), post, INDEX), "postings")


class Shard:
    """One row of the index."""

    def __init__(self, row: dict) -> None:
        self.bounds = np.frombuffer(row["bounds"].as_buffer(), "<i8")
        self.terms = row["terms"].values
        self.lists = np.frombuffer(row["lists"].as_buffer(), "<i8")
        self.places = np.cumsum(np.frombuffer(row["places"].as_buffer(), "<i4"), dtype=np.int64)
        self.n = int(self.bounds[-1])
        self.count = np.diff(self.lists)
        self.codes = np.empty(self.n, np.int32)
        self.codes[self.places] = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The shard's number of each term, -1 where it has none."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def expand(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the given terms, and a place of it, for all places of each."""
        count = self.count[term]
        return np.repeat(np.arange(len(term)), count), self.places[_words.ragged(self.lists[term], count)]

    def has(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the list of term holds place."""
        inside = (place >= 0) & (place < self.n)
        return inside & (self.codes[np.where(inside, place, 0)] == term)

    def phrases(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Occurrences (phrase, start) of phrases: lengths[i] term numbers from words[starts[i]] on; a bounded number at a time."""
        lacks = np.concatenate([[0], np.cumsum(words < 0)])
        alive = np.flatnonzero(lacks[starts + lengths] == lacks[starts]) if self.n else np.zeros(0, np.int64)
        for low in range(0, len(alive), PHRASES):
            some = alive[low : low + PHRASES]
            size = lengths[some]
            inside = np.arange(int(size.max())) < size[:, None]
            terms = words[np.minimum(starts[some][:, None] + np.arange(inside.shape[1]), len(words) - 1)]
            order = np.argsort(np.where(inside, self.count[terms], np.iinfo(np.int64).max), axis=1, kind="stable")
            first = terms[np.arange(len(some)), order[:, 0]]
            for a, b in _groups(self.count[first], PLACES):
                phrase, place = self.expand(first[a:b])
                phrase += a
                start = place - order[phrase, 0]
                for k in range(1, inside.shape[1]):
                    offset = order[phrase, k]
                    keep = (k >= size[phrase]) | self.has(terms[phrase, offset], start + offset)
                    phrase, start = phrase[keep], start[keep]
                last = start + size[phrase] - 1
                doc = np.searchsorted(self.bounds, start, side="right")
                good = (start >= 0) & (last < self.n) & (doc == np.searchsorted(self.bounds, last, side="right"))
                yield some[phrase[good]], start[good]

    def near(self, items: Items, number: np.ndarray, terms: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(item, document) where enough of the item's different words stand in a run of len(item) + slop words of one document; number: the shard's number of
        each of the items' words, -1 where it lacks one.

        Of s different words that the shard has, m of which must be met, any run holds j of the s - m + j rarest. The places of these are compared for a batch
        of items at once, and only where j of them (CLOSE, or m if that is less) stand in a run's length are the surroundings read.
        """
        need = np.maximum(np.minimum(terms, items.different), np.ceil(NEAR_SHARE * items.different - 1e-9).astype(np.int64))
        code = number[items.each]
        item = np.repeat(np.arange(len(need)), items.different)[code >= 0]
        code = code[code >= 0]
        here = np.bincount(item, minlength=len(need))
        live = (here >= need) & (need > 0)
        kept = live[item]
        item, code = item[kept], code[kept]
        order = np.lexsort((self.count[code], item))
        code = code[order]
        here[~live] = 0
        first = np.cumsum(here) - here
        close = np.minimum(need, CLOSE)
        rare = np.arange(len(code)) - first[item] < (here - need + close)[item]
        span = items.sizes + slop
        pairs = [np.zeros((0, 2), np.int64)]
        own = np.zeros(len(self.count), bool)
        ends = np.concatenate([[0], np.cumsum(here)])
        reads = np.zeros(len(need), np.int64)
        np.add.at(reads, item[rare], self.count[code[rare]])
        for a, b in _groups(reads, PLACES):
            some = slice(ends[a], ends[b])
            kept = rare[some]
            k, place = self.expand(code[some][kept])
            key = np.sort(item[some][kept][k] * (self.n + 1) + place)
            k, place = np.divmod(key, self.n + 1)
            last = np.arange(len(key)) + close[k] - 1
            met = last < len(key)
            met[met] = key[last[met]] - key[met] < span[k[met]]  # of another item: farther than any run, or dropped when its surroundings are read
            for x, at in _parts(k[met], place[met]):
                found = self._surroundings(at, code[ends[x] : ends[x + 1]], int(need[x]), int(span[x]), own)
                pairs.append(np.stack([np.full(len(found), x), found], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return found[:, 0], found[:, 1]

    def _surroundings(self, place: np.ndarray, here: np.ndarray, need: int, span: int, own: np.ndarray) -> np.ndarray:
        """Documents where `need` different ones of the terms `here` stand in a run of span words that holds one of the rising places."""
        doc = np.searchsorted(self.bounds, place, side="right") - 1
        low = np.maximum(place - span + 1, self.bounds[doc])
        high = np.minimum(place + span, self.bounds[doc + 1])
        low[1:] = np.maximum(low[1:], np.maximum.accumulate(high)[:-1])  # a place is read once
        at = _words.ragged(low, np.maximum(high - low, 0))
        own[here] = True
        at = at[own[self.codes[at]]]
        own[here] = False
        if len(at) < need:
            return np.zeros(0, np.int64)
        where = np.searchsorted(self.bounds, at, side="right") - 1
        last = np.searchsorted(at, np.minimum(at + span, self.bounds[where + 1]))
        first = np.flatnonzero(last - np.arange(len(at)) >= need)
        # a hit counts in a run if the hit before it of the same word lies before the run
        order = np.argsort(self.codes[at], kind="stable")
        before = np.full(len(at), -1, np.int64)
        same = self.codes[at[order[1:]]] == self.codes[at[order[:-1]]]
        before[order[1:][same]] = order[:-1][same]
        step = max(1, (1 << 20) // span)
        met = [np.zeros(0, np.int64)]
        for i in range(0, len(first), step):
            some = first[i : i + step]
            size = last[some] - some
            new = before[_words.ragged(some, size)] < np.repeat(some, size)
            different = np.add.reduceat(new.astype(np.int64), np.cumsum(size) - size)
            met.append(np.unique(where[some[different >= need]]))
        return np.unique(np.concatenate(met))


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of rows whose sizes come to `most` or less (one row at least)."""
    total = np.cumsum(sizes)
    low = 0
    while low < len(sizes):
        high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, side="right")))
        yield low, high
        low = high


def _parts(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Values of each key, which lie together."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
        if a < b:
            yield int(keys[a]), values[a:b]


class Items:
    """Test items as phrases over a common vocabulary: items of the same words are one item with several names. All that grows with them is flat arrays."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int) -> None:
        words = _words.split(texts, "alnum")
        same: dict[bytes, int] = {}
        self.names: list[list[str]] = []
        kept, codes = [], words.codes.astype(np.int32)
        for k, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
            x = same.setdefault(codes[a:b].tobytes(), len(kept))
            if x == len(kept):
                kept.append(k)
                self.names.append([])
            if ids[k] is not None:  # an id may be None
                self.names[x].append(ids[k])
        kept = np.array(kept, np.int64)
        self.vocab = words.vocab
        self.sizes = np.diff(words.bounds)[kept].astype(np.int64)
        self.words = codes[_words.ragged(words.bounds[:-1][kept], self.sizes)]
        begin = np.cumsum(self.sizes) - self.sizes
        # windows of all items: a window's words are lengths[i] from words[starts[i]] on
        size = np.minimum(window, self.sizes)
        windows = np.where(size > 0, self.sizes - size + 1, 0)
        self.owner = np.repeat(np.arange(len(kept), dtype=np.int32), windows)
        self.starts = _words.ragged(begin, windows).astype(np.int32)
        self.lengths = size[self.owner].astype(np.int32)
        # different words of each item
        pair = np.unique(np.repeat(np.arange(len(kept), dtype=np.int64), self.sizes) * (len(self.vocab) + 1) + self.words)
        item, each = np.divmod(pair, len(self.vocab) + 1)
        self.each, self.different = each.astype(np.int32), np.bincount(item, minlength=len(kept))


FOUND = "doc_id long, text_hash binary, n_words long, hits binary, items array<string>, near array<string>"


def find(index: DataFrame, ids: list[str], texts: pa.Array, window: int, near_terms: int, slop: int) -> DataFrame:
    """For each document the hit words (pairs start, end of runs), the items that occur, and those that only come near."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(Items(ids, texts, window))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                shard = Shard(row)
                number = shard.numbers(items.vocab)
                n = len(shard.bounds) - 1
                cover = np.zeros(shard.n + 1, np.int32)
                pairs = np.zeros(0, np.int64)
                for phrase, start in shard.phrases(number[items.words], items.starts, items.lengths):
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + items.lengths[phrase], -1)
                    where = np.searchsorted(shard.bounds, start, side="right") - 1
                    pairs = np.union1d(pairs, items.owner[phrase].astype(np.int64) * n + where)
                hit = np.cumsum(cover)[:-1] > 0
                got: list[set[str]] = [set() for _ in range(n)]
                met = [False] * n
                for k, d in zip(*(x.tolist() for x in np.divmod(pairs, max(n, 1))), strict=True):
                    got[d].update(items.names[k])
                    met[d] = True
                close: list[set[str]] = [set() for _ in range(n)]
                for k, d in zip(*shard.near(items, number, near_terms, slop), strict=True) if near_terms else ():
                    close[d].update(items.names[k])
                runs = []
                for d in range(n):
                    a, b = shard.bounds[d], shard.bounds[d + 1]
                    own = np.zeros(b - a + 2, np.int8)
                    own[1:-1] = hit[a:b]
                    runs.append(np.flatnonzero(np.diff(own)).astype("<i8").tobytes() if met[d] else b"")
                out = [batch.column("doc_ids")[r].values, batch.column("digests")[r].values, pa.array(np.diff(shard.bounds)), pa.array(runs, pa.binary()), pa.array([sorted(x) for x in got], pa.list_(pa.string())), pa.array([sorted(x - y) for x, y in zip(close, got, strict=True)], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "n_words", "hits", "items", "near"])

    return _arrow.map_batches(index, look, FOUND)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, near_terms: int = 4, slop: int = 12) -> DataFrame:
    """doc_id, text_hash (md5), n_words, n_hit, spans (hit runs of words), items and near_items of each document."""
    spark = docs.sparkSession
    index = build_index(docs)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).cast("long").alias("n")).first()["n"]
    blocks = max(1, -(-int(size) // ITEM_BYTES))
    found = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # at most about ITEM_BYTES
        found.append(find(index, [r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string()), window, near_terms, slop))
    # with several blocks a document has a row for each, told apart by its place in the index
    if blocks > 1:
        numbered = [f.withColumn("at", F.monotonically_increasing_id()) for f in found]
        merged = reduce(DataFrame.unionByName, numbered).groupBy("at").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")).drop("at")
    else:
        merged = found[0].withColumn("hits", F.array("hits"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, total, sha, near = [], [], [], []
            for hits, got, close in zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), batch.column("near").to_pylist(), strict=True):
                runs: list[list[int]] = []
                for a, b in sorted(tuple(x) for raw in hits if raw for x in np.frombuffer(raw, "<i8").reshape(-1, 2).tolist()):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(b, runs[-1][1])
                    else:
                        runs.append([a, b])
                spans.append([{"start": a, "end": b} for a, b in runs])
                total.append(sum(b - a for a, b in runs))
                sha.append(hashlib.sha256(",".join(sorted(set(got))).encode()).hexdigest())
                near.append(sorted(set(close) - set(got)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = [batch.column("doc_id"), batch.column("text_hash"), batch.column("n_words"), pa.array(total, pa.int64()), pa.array(spans, kind), batch.column("items"), pa.array(near, pa.list_(pa.string())), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "n_words", "n_hit", "spans", "items", "near_items", "items_sha256"])

    return _arrow.map_batches(merged.select("doc_id", "text_hash", "n_words", "hits", "items", "near"), digest, "doc_id long, text_hash binary, n_words long, n_hit long, spans array<struct<start:bigint,end:bigint>>, items array<string>, near_items array<string>, items_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))
