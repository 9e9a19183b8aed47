"""Alignment of two tokenizers over a corpus: every distinct segment is tokenized and aligned once.

1. Texts (with a space in front) are cut before runs of white space, at characters where neither vocabulary can merge across: no entry of either holds such
   a character behind a character that isn't white space, the first tokenizer's own cutting begins anew there, and the second one changes nothing but
   spaces (`Vocabularies` verifies this from the files; where it doesn't hold, a text stays in one piece). So a text's tokens are its segments' tokens.
2. A batch of texts becomes numbers of its distinct segments. The segments go to tasks by their hash; each distinct one is tokenized by both vocabularies
   and cut at the byte offsets where tokens of both end. Alignments return to the batches that asked.
3. Each batch composes its documents: sums, the string of groups, and which id pairs a document links how often. Of a pair a batch sends out in how many
   of its documents it is. Sums over all batches are the pairs' counts; the highest one of an id of the first tokenizer is broadcast (as many rows as its
   vocabulary has ids). Counts return to the batches, and each document adds up its own.
A batch is at most BATCH_TEXT bytes of text (a longer text is a batch by itself); segments that all batches share travel once for each batch.

Defined results: null and empty texts, and texts that the joined tokens of either side do not give back byte by byte, have no tokens: zeros and an empty
string; they count in no pair's count. Strings of special tokens are plain text. Repeated rows are documents of their own; doc_id may be null; an empty
table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _tokens, _words, pieces

BATCH_TEXT = 14 << 20
#: Bytes of input for each part of the segments, and the most parts; segments that a task keeps at most (beyond them it begins anew and may tokenize one again).
PART_BYTES, MOST_PARTS, KEEP = 8 << 20, 1 << 20, 1_000_000
#: Token pairs of documents that are sorted at once.
LINKS_TOGETHER = 1 << 19
#: White space by any of the definitions in use.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\x85᠎​﻿"
CUTS = " \n\t"


def packed(values: np.ndarray) -> bytes:
    raw = values.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, dtype: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), dtype)


class Vocabularies:
    """Both tokenizers, the bytes of each of their tokens, and where texts may be cut."""

    _open: dict[tuple[str, str], Vocabularies] = {}

    @classmethod
    def of(cls, first: str, second: str) -> Vocabularies:
        if (first, second) not in cls._open:
            cls._open[first, second] = cls(first, second)
        return cls._open[first, second]

    def __init__(self, first: str, second: str) -> None:
        from tokenizers import Tokenizer

        with open(first, encoding="utf-8") as f:
            made = json.load(f)
        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        byte_of = {c: b for b, c in enumerate(_tokens._byte_letters())}
        entries = {i: t for t, i in made["model"]["vocab"].items()}
        self.bytes_a = [bytes(byte_of.get(c, 63) for c in entries.get(i, "")) for i in range(max(entries) + 1)]
        self.b = pieces.Pieces.of(second)
        self.bytes_b = [bytes([int(s[3:5], 16)]) if k == 6 else s.replace("▁".encode(), b" ") for s, k in zip(self.b.surfaces, self.b.kinds, strict=True)]
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        self.name_a, self.name_b = ([str(i) for i in range(len(x))] for x in (self.bytes_a, self.bytes_b))
        cutter = made.get("pre_tokenizer") or {}
        plain = cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space") and not made.get("normalizer")
        normal = self.b.normalizer
        plain = plain and normal.plain and normal.escape and not normal.suffix
        merging = [t for t, k in zip(self.bytes_b, self.b.kinds, strict=True) if k in (1, 4)]
        self.cuts = "".join(c for c in CUTS if plain and not self._merge_across(c, [*self.bytes_a, *merging]))

    @staticmethod
    def _merge_across(char: str, entries: list[bytes]) -> bool:
        """Whether an entry has char behind anything but white space (an entry that is no whole UTF-8 counts as one that may)."""
        behind = re.compile(f"[^{re.escape(WHITE)}]{re.escape(char)}")
        low = char.encode()
        for entry in entries:
            if low in entry[1:]:
                try:
                    if behind.search(entry.decode()):
                        return True
                except UnicodeDecodeError:
                    return True
        return False

    def pattern(self) -> re.Pattern:
        if not self.cuts:
            return re.compile(r"(?s).+")
        white, uncut = re.escape(WHITE), re.escape("".join(c for c in WHITE if c not in self.cuts))
        return re.compile(f"[{white}]*[^{white}]+(?:[{uncut}][{white}]*[^{white}]*)*|[{white}]+")

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """ids of both for each segment; both are empty where joined tokens aren't the segment."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        b = self.b.cut.encode([s.replace(" ", "▁") for s in segments], num_threads=1)
        for k, s in enumerate(segments):
            data = s.encode()
            if b"".join([self.bytes_a[i] for i in a[k]]) != data or b"".join([self.bytes_b[i] for i in b[k]]) != data:
                a[k], b[k] = [], []
        return a, b


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum())), sizes


def common_ends(ids_a: np.ndarray, ids_b: np.ndarray, v: Vocabularies) -> tuple[np.ndarray, np.ndarray]:
    """For tokens of both over the same bytes: the number of tokens of each in every group."""
    ends_a, ends_b = np.cumsum(v.len_a[ids_a]), np.cumsum(v.len_b[ids_b])
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return (np.diff(np.searchsorted(x, both, "right"), prepend=0) for x in (ends_a, ends_b))


def _split(batches: Iterator[pa.RecordBatch], first: str, second: str, parts: int) -> Iterator[pa.RecordBatch]:
    """For a batch of texts: a row with doc_ids, segments in each and their numbers (part -1), and rows with its distinct segments by part."""
    import uuid

    pattern = Vocabularies.of(first, second).pattern()
    names: list = []
    sizes: list[int] = []
    codes: list[np.ndarray] = []
    known: dict[str, int] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        batch = uuid.uuid4().int >> 65
        every = np.concatenate([*codes, np.zeros(0, np.int32)])
        yield _row(batch, -1, names, packed(np.array(sizes, np.int64)), packed(every), [])
        by_part: dict[int, list[str]] = {}
        for s in known:
            by_part.setdefault(zlib.crc32(s.encode()) % parts, []).append(s)
        for part, found in by_part.items():
            yield _row(batch, part, [], b"", packed(np.array([known[s] for s in found], np.int32)), found)

    for given in batches:
        for name, text in zip(given.column("doc_id").to_pylist(), given.column("text").cast(pa.binary()), strict=True):
            data = text.as_buffer().to_pybytes()
            if held and held + len(data) > BATCH_TEXT:
                yield from rows()
                names, sizes, codes, known, held = [], [], [], {}, 0
            try:
                found = pattern.findall(" " + data.decode()) if data else []
            except UnicodeDecodeError:
                found = []  # no token gives such bytes back
            names.append(name)
            sizes.append(len(found))
            codes.append(np.fromiter((known.setdefault(s, len(known)) for s in found), np.int32, len(found)))
            held += len(data)
    if names:
        yield from rows()


_SPLIT = "batch long, part int, doc_ids array<long>, sizes binary, codes binary, segments array<string>"


def _row(batch: int, part: int, names: list, sizes: bytes, codes: bytes, segments: list[str]) -> pa.RecordBatch:
    values = [pa.array([batch], pa.int64()), pa.array([part], pa.int32()), pa.array([names], pa.list_(pa.int64())), pa.array([sizes], pa.binary()), pa.array([codes], pa.binary()), pa.array([segments], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(values, ["batch", "part", "doc_ids", "sizes", "codes", "segments"])


_ALIGNED = "batch long, codes binary, sizes binary, ids_a binary, ids_b binary, groups binary"


def _align(batches: Iterator[pa.RecordBatch], first: str, second: str) -> Iterator[pa.RecordBatch]:
    """For each row of segments: numbers of tokens and groups in each (3 to a segment), the ids, and the tokens in each group."""
    v = Vocabularies.of(first, second)
    known: dict[str, tuple[np.ndarray, ...]] = {}
    for batch in batches:
        lists = batch.column("segments").to_pylist()
        if len(known) > KEEP:
            known.clear()
        fresh = list({s: None for x in lists for s in x if s not in known})
        for low in range(0, len(fresh), 20_000):
            some = fresh[low : low + 20_000]
            a, b = v.tokens(some)
            (flat_a, n_a), (flat_b, n_b) = _flat(a), _flat(b)
            in_a, in_b = common_ends(flat_a, flat_b, v)
            upto = np.cumsum(in_a)
            end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
            end_g = np.searchsorted(upto, end_a, "right")
            groups = np.stack([in_a, in_b], 1).astype(np.int32)
            at = [0, 0, 0]
            for s, *upto_here in zip(some, end_a.tolist(), end_b.tolist(), end_g.tolist(), strict=True):
                known[s] = tuple(x[i:j] for x, i, j in zip((flat_a, flat_b, groups), at, upto_here, strict=True))
                at = upto_here
        out: list[list] = [[], [], [], []]
        for x in lists:
            got = [known[s] for s in x]
            out[0].append(packed(np.array([[len(p) for p in t] for t in got], np.int32).ravel()))
            for k in range(3):
                out[k + 1].append(packed(np.concatenate([t[k].ravel() for t in got])))
        yield pa.RecordBatch.from_arrays([batch.column("batch"), batch.column("codes"), *(pa.array(x, pa.binary()) for x in out)], ["batch", "codes", "sizes", "ids_a", "ids_b", "groups"])


class Aligned:
    """Alignments of a batch's segments, by their numbers."""

    def __init__(self, rows: pa.Table, v: Vocabularies) -> None:
        read = lambda name, dtype: [unpacked(x.as_py(), dtype) for x in rows.column(name)]
        whole = lambda name, dtype=np.int32: np.concatenate([*read(name, dtype), np.zeros(0, dtype)])
        codes, sizes = whole("codes"), whole("sizes").reshape(-1, 3).astype(np.int64)
        ids = [whole("ids_a"), whole("ids_b"), whole("groups").reshape(-1, 2)]
        order = np.argsort(codes)
        begins = (np.cumsum(sizes, 0) - sizes)[order]
        self.sizes = sizes[order]
        self.a, self.b, groups = (x[_words.ragged(begins[:, k], self.sizes[:, k])] for k, x in enumerate(ids))
        self.in_a, self.in_b = groups[:, 0].astype(np.int64), groups[:, 1].astype(np.int64)
        group_end = np.cumsum(self.sizes[:, 2])
        self._strings(v, group_end)
        self._pairs(group_end)

    def _strings(self, v: Vocabularies, group_end: np.ndarray) -> None:
        self.strings = []
        tokens, groups = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(self.sizes[:, :2], 0)]), np.concatenate([[0], group_end])
        for low in range(0, len(group_end), 20_000):  # lists of few segments at once
            high = min(low + 20_000, len(group_end))
            a, b = ([name[i] for i in ids[at[low] : at[high]].tolist()] for name, ids, at in ((v.name_a, self.a, tokens[:, 0]), (v.name_b, self.b, tokens[:, 1])))
            made, at_a, at_b = [], 0, 0
            for n, m in zip(self.in_a[groups[low] : groups[high]].tolist(), self.in_b[groups[low] : groups[high]].tolist(), strict=True):
                made.append((a[at_a] if n == 1 else ",".join(a[at_a : at_a + n])) + "|" + (b[at_b] if m == 1 else ",".join(b[at_b : at_b + m])))
                at_a += n
                at_b += m
            bounds = (groups[low : high + 1] - groups[low]).tolist()
            self.strings += [";".join(made[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]

    def _pairs(self, group_end: np.ndarray) -> None:
        """Linked pairs of each segment: distinct ones as numbers into `pairs`, and how often each is linked."""
        n_links = self.in_a * self.in_b
        upto = np.cumsum(n_links)
        self.links = np.diff(np.concatenate([[0], np.concatenate([[0], upto])[group_end]]))
        segment_of_group = np.repeat(np.arange(len(group_end)), self.sizes[:, 2])
        begin_a, begin_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        found = []
        low = 0
        while low < len(n_links):  # so many groups at once that their links are few, one at least
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + LINKS_TOGETHER, "right")))
            if high == low + 1 and n_links[low] > LINKS_TOGETHER:
                parts = [np.unique(x[at : at + n], return_counts=True) for x, at, n in ((self.a, begin_a[low], self.in_a[low]), (self.b, begin_b[low], self.in_b[low]))]
                (ids_a, m_a), (ids_b, m_b) = parts
                pair = (ids_a.astype(np.int64)[:, None] << 32 | ids_b[None, :]).ravel()
                found.append((np.full(len(pair), segment_of_group[low]), pair, np.outer(m_a, m_b).ravel()))
            else:
                n, m = self.in_a[low:high], self.in_b[low:high]
                within = _words.ragged(np.zeros(high - low, np.int64), n * m)
                width = np.repeat(m, n * m)
                a = self.a[np.repeat(begin_a[low:high], n * m) + within // width].astype(np.int64)
                b = self.b[np.repeat(begin_b[low:high], n * m) + within % width]
                found.append((np.repeat(segment_of_group[low:high], n * m), a << 32 | b, np.ones(len(a), np.int64)))
            low = high
        segment, pair, often = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
        self.pairs, number = np.unique(pair, return_inverse=True)
        key, at = np.unique(segment * max(1, len(self.pairs)) + number, return_inverse=True)
        self.often = np.bincount(at, often, len(key)).astype(np.int64)
        segment, self.pair_of = np.divmod(key, max(1, len(self.pairs)))
        self.n_pairs = np.bincount(segment, minlength=len(group_end))
        self.pair_at = np.cumsum(self.n_pairs) - self.n_pairs


_COMPOSED = "batch long, doc_ids array<long>, stats binary, groups_sha256 array<string>, n_pairs binary, pair_of binary, often binary, pairs array<long>, docs array<long>"


def _compose(asked: pa.Table, given: pa.Table, first: str, second: str) -> pa.Table:
    """A batch's documents: n_a, n_b, n_groups, n_links (4 to a document), the digest, the pairs of each (differences of rising numbers) and how often it
    links them; and the batch's pairs with their numbers of documents."""
    v = Vocabularies.of(first, second)
    al = Aligned(given, v)
    names = asked.column("doc_ids")[0].as_py()
    sizes, codes = unpacked(asked.column("sizes")[0].as_py(), np.int64), unpacked(asked.column("codes")[0].as_py(), np.int32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    measures = np.concatenate([al.sizes, al.links[:, None]], 1) if len(al.sizes) else np.zeros((0, 4), np.int64)
    lost = np.concatenate([[0], np.cumsum(measures[codes, 0] == 0)]) if len(codes) else np.zeros(1, np.int64)
    whole = (lost[bounds[1:]] == lost[bounds[:-1]]) & (sizes > 0)
    stats, shas = np.zeros((len(names), 4), np.int64), []
    docs = np.zeros(len(al.pairs), np.int64)
    n_pairs, pair_of, often = np.zeros(len(names), np.int64), [], []
    low = 0
    while low < len(names):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + LINKS_TOGETHER // 4, "right")) - 1)
        width = max(1, len(al.pairs))
        doc, some = np.repeat(np.arange(high - low), sizes[low:high]), codes[bounds[low] : bounds[high]]
        kept = np.repeat(whole[low:high], sizes[low:high])
        doc, some = doc[kept], some[kept]
        for k in range(4):
            stats[low:high, k] = np.bincount(doc, measures[some, k], high - low)
        n = al.n_pairs[some]
        at = _words.ragged(al.pair_at[some], n)
        key, back = np.unique(np.repeat(doc, n) * width + al.pair_of[at], return_inverse=True)
        sums = np.bincount(back, al.often[at], len(key)).astype(np.int64)
        owner, pair = np.divmod(key, width)
        docs += np.bincount(pair, minlength=len(docs))[: len(docs)]
        n_pairs[low:high] = np.bincount(owner, minlength=high - low)
        pair_of.append(pair)
        often.append(sums)
        for k in range(low, high):
            text = ";".join([al.strings[c] for c in codes[bounds[k] : bounds[k + 1]].tolist()]) if whole[k] else ""
            shas.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        low = high
    whole_of = lambda x: np.concatenate([*x, np.zeros(0, np.int64)])
    blobs = [packed(n_pairs), packed(np.diff(whole_of(pair_of), prepend=0).astype(np.int32)), packed(whole_of(often))]
    values = [pa.array([asked.column("batch")[0].as_py()], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([packed(stats)], pa.binary()), pa.array([shas], pa.list_(pa.string())), *(pa.array([x], pa.binary()) for x in blobs)]
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (al.pairs, docs)]
    del al
    _arrow.trim()
    return pa.Table.from_arrays([*values, *lists], [x.split()[0] for x in _COMPOSED.split(", ")])


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _finish(composed: pa.Table, counted: pa.Table) -> pa.Table:
    """Rows of a batch's documents; counted: place, count and best (whether it is its first id's highest) of each pair of the batch."""
    one = lambda name: composed.column(name)[0].as_py()
    stats = unpacked(one("stats"), np.int64).reshape(-1, 4)
    n_pairs, often = unpacked(one("n_pairs"), np.int64), unpacked(one("often"), np.int64)
    pair_of = np.cumsum(unpacked(one("pair_of"), np.int32).astype(np.int64))
    order = np.argsort(counted.column("place").to_numpy())
    count, best = (counted.column(x).to_numpy().astype(np.int64)[order] for x in ("count", "best"))
    bounds = np.concatenate([[0], np.cumsum(n_pairs)])
    sums = [np.concatenate([[0], np.cumsum(often * x[pair_of] if len(pair_of) else often)]) for x in (best, count)]
    n_best, count_sum = (x[bounds[1:]] - x[bounds[:-1]] for x in sums)
    columns = [pa.array(one("doc_ids"), pa.int64()), *(pa.array(stats[:, k], pa.int64()) for k in range(4)), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), pa.array(one("groups_sha256"), pa.string())]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in _RESULT.split(", ")])


def pair_counts(composed: DataFrame) -> DataFrame:
    """pair, count (documents that link it, over all batches), best (whether no other pair of its first id has more)."""
    counts = composed.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy("x.pairs").agg(F.sum("x.docs").alias("count")).where("count > 0").select(F.col("pairs").alias("pair"), "count")
    counts = session.written(counts, "pair-counts")
    # as many rows as the first vocabulary has ids
    highest = counts.groupBy(F.shiftright("pair", 32).alias("id_a")).agg(F.max("count").alias("highest"))
    return counts.join(F.broadcast(highest), F.shiftright("pair", 32) == F.col("id_a")).select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))


def aligned(docs: DataFrame, first: str, second: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    parts = min(MOST_PARTS, max(8, _arrow.input_bytes(docs) // PART_BYTES))
    split = session.written(_arrow.map_batches(_arrow.texts(docs), lambda x: _split(x, first, second, parts), _SPLIT), "segments")
    asked = split.where("part < 0").select("batch", "doc_ids", "sizes", "codes")
    segments = split.where("part >= 0").select("batch", "part", "codes", "segments").repartition("part")
    given = _arrow.map_batches(segments, lambda x: _align(x, first, second), _ALIGNED)
    composed = asked.groupBy("batch").cogroup(given.groupBy("batch")).applyInArrow(lambda x, y: _compose(x, y, first, second), _COMPOSED)
    composed = session.written(composed, "composed")
    session.drop(split)
    pairs = composed.select(F.col("batch").alias("asker"), F.posexplode("pairs").alias("place", "pair"))
    # pairs that no whole document links have no count
    counted = pairs.join(pair_counts(composed), "pair", "left").select("asker", "place", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("best", F.lit(0)).alias("best"))
    return composed.drop("pairs", "docs").groupBy("batch").cogroup(counted.groupBy("asker")).applyInArrow(_finish, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(session.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
