"""Substring dedup by repeated-phrase automata.

Every window of WINDOW words picks an anchor: the run of ANCHOR words in it with the least hash (leftmost of equals). Equal windows pick equal
anchors, so a window can only recur if its anchor recurs. Anchors of all documents are counted; those met at two places or more are handed back to
the documents, in parts of the table. What recurs is then confirmed, compiled into Aho-Corasick automata over words and located at three levels:
1. A batch of documents: windows that the batch holds twice become phrases, and all its documents stream through the automata of these phrases.
   Every occurrence but the batch's earliest is removed. So a passage that a third of all documents share leaves a batch once.
2. The passages that are left (runs of windows that picked one anchor) are dealt out by anchor: in bounded groups, phrases that two places have are
   confirmed and compiled, and all passages of the group stream through the automata. An anchor met at more than SPLIT places is dealt out in parts.
3. Windows that are left of such anchors, once for each part, are dealt out by their words and go the same way.
An automaton holds AUTOMATON_WORDS words of phrases at most; what needs more is compiled into several, and streams through each. What is removed follows from
occurrences that automata have found, word by word; hashes only choose what is compiled (to miss a phrase, two of one group must share a 64-bit hash).
"Earlier" is by doc_id, then hash of the text (where a doc_id repeats with other texts), then start.

Defined results: a null text has no words; texts of fewer than WINDOW words keep all; rows that repeat a doc_id with the same text are one
document (each row gets that document's result), rows that repeat it with another text are documents in the order of their texts' hashes; rows
with a null doc_id are kept whole; an empty table gives no rows; extra columns are not read unless they are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _words

WINDOW, ANCHOR = 20, 8
#: Words of phrases in one automaton at most.
AUTOMATON_WORDS = 400_000
#: Bytes of documents in a batch, and of passages that are worked on together (whole anchors).
BATCH, GROUP = 4 << 20, 2 << 20
#: Places of an anchor in one part at most.
SPLIT = 8192
#: Bytes of the table for each of its parts (by the optimizer's estimate).
PART = 1 << 18
#: Bits of a word's place in a batch, below the bits of a hash.
_PLACE = np.uint64(36)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` values."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: _words.Words, window: int = WINDOW, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window (by its first word): that word, the first word of its anchor and the anchor's hash."""
    hashes = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    run = _words.rolling(hashes, width)
    span = window - width + 1
    if len(run) < span:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    # the same number of hash bits in every batch, so that equal windows pick alike
    key = (run >> _PLACE << _PLACE) | np.arange(len(run), dtype=np.uint64)
    best = (_sliding_min(key, span) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    first = _windows(words.bounds, window)
    return first, best[first], run[best[first]]


def _windows(bounds: np.ndarray, window: int) -> np.ndarray:
    """First words of all windows of texts with these bounds."""
    return _words.ragged(bounds[:-1], np.maximum(np.diff(bounds) - window + 1, 0))


def anchor_rows(docs: DataFrame, window: int, width: int) -> DataFrame:
    """(anchor, part, n): n places in documents of one batch and part have the anchor."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            words = _words.split(batch.column("text"), "space")
            first, place, anchor = anchors(words, window, width)
            if not len(first):
                continue
            new = np.append(True, (place[1:] != place[:-1]))
            anchor, first = anchor[new], first[new]
            part = batch.column("part").to_numpy()[np.searchsorted(words.bounds, first, side="right") - 1]
            order = np.lexsort((anchor, part))
            anchor, part = anchor[order], part[order]
            at = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])))
            n = np.diff(np.append(at, len(anchor))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[at].view(np.int64)), pa.array(part[at]), pa.array(n)], ["anchor", "part", "n"])

    return _arrow.map_batches(docs.select("part", "text"), emit, "anchor long, part long, n int")


def recurring(rows: DataFrame) -> DataFrame:
    """For each part lists of its anchors that are met at two places or more, and of those to be dealt out in several parts with how many."""
    # an anchor has a row for each batch and part at most, and no rows of an anchor are gathered
    dealt = rows.repartition("anchor")
    # both sides need all columns, so that their exchange is one and the texts are read once (no sum is less than its rows or terms)
    often = dealt.groupBy("anchor").agg(F.greatest(F.sum("n"), F.count("part")).alias("places")).where("places > 1")
    met = dealt.join(often.hint("shuffle_hash"), "anchor")
    places = F.greatest(F.col("places"), F.col("n").cast("long"))
    hot = places > SPLIT
    salts = F.ceil(places / F.lit(SPLIT)).cast("long")
    lists = [F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(hot, F.col("anchor"))).alias("hot"), F.collect_list(F.when(hot, salts)).alias("salts")]
    return met.groupBy("part").agg(*lists)


class Automata:
    """Phrases of a stream of word numbers, given by first word and length, in automata of bounded size."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.codes, self.starts, self.lengths = codes, starts, lengths

    def occurrences(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, first word) of every occurrence in the whole stream."""
        import ahocorasick

        found, first = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        before = np.concatenate([[0], np.cumsum(self.lengths)])
        a = 0
        while a < len(self.starts):
            b = max(a + 1, int(np.searchsorted(before, before[a] + AUTOMATON_WORDS, side="right")) - 1)
            at, size = self.starts[a:b], self.lengths[a:b]
            # each word of the shard's phrases is a character, all others are one more
            used = np.unique(self.codes[_words.ragged(at, size)])
            char = np.arange(1, len(used) + 1, dtype=np.uint32)
            table = np.zeros(int(self.codes.max()) + 1, "<u4")
            table[used] = char + np.uint32(0x800) * (char >= 0xD800)
            stream = table[self.codes].tobytes().decode("utf-32-le")
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, (s, n) in enumerate(zip(at.tolist(), size.tolist(), strict=True)):
                automaton.add_word(stream[s : s + n], k)
            automaton.make_automaton()
            got = np.fromiter((x for pair in automaton.iter(stream) for x in pair), np.int64).reshape(-1, 2)
            found.append(got[:, 1] + a)
            first.append(got[:, 0] - size[got[:, 1]] + 1)
            a = b
        return np.concatenate(found), np.concatenate(first)


def _groups(first: np.ndarray, codes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows by group of equal ones (an order, and where each group begins in it), and each window's group."""
    full = _words.rolling(_words.mix(codes.astype(np.uint64) + np.uint64(1)), window)[first]
    order = np.argsort(full, kind="stable")
    cut = np.flatnonzero(np.append(True, full[order][1:] != full[order][:-1]))
    group = np.empty(len(first), np.int64)
    group[order] = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
    return order, cut, group


def _phrases(first: np.ndarray, owner: np.ndarray, order: np.ndarray, cut: np.ndarray, group: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, number of windows) of runs that stand for the wanted groups: a run goes on as long as all windows of a group are followed by all of the next."""
    size = np.diff(np.append(cut, len(order)))
    follows = np.full(len(first), -1, np.int64)
    near = np.flatnonzero((first[1:] == first[:-1] + 1) & (owner[1:] == owner[:-1]))
    follows[near] = group[near + 1]
    low, high = np.minimum.reduceat(follows[order], cut), np.maximum.reduceat(follows[order], cut)
    linked = wanted & (low == high) & (low >= 0)
    linked[linked] &= size[low[linked]] == size[linked]
    goes_on = np.zeros(len(first) + 1, bool)
    goes_on[order[cut[linked]] + 1] = True  # the earliest window of the next group
    heads = wanted.copy()
    heads[low[linked]] = False
    start = np.sort(order[cut[heads]])
    stops = np.flatnonzero(~goes_on)
    return start, stops[np.searchsorted(stops, start, side="right")] - start


def _inside(bounds: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in which the runs of words begin, and whether they end there, too."""
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, start + length <= bounds[text + 1]


FOUND = "anchor long, salt long, doc_id long, sub long, start int, text binary, n int"


def passages(streams: DataFrame, window: int, width: int) -> DataFrame:
    """Level 1: runs of windows of documents (text null: they are removed), and where they are to be dealt out.

    streams: by part, first rows with anchors of the part, then documents.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[np.ndarray] = []
        hot: list[np.ndarray] = []
        docs: list[pa.RecordBatch] = []
        size, now = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            if docs and known:
                yield from _passages(pa.Table.from_batches(docs), np.unique(np.concatenate(known)), np.concatenate(hot), now, window, width)

        for batch in batches:
            part, lists = batch.column("part").to_numpy(), batch.column("anchors").is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if part[a] != now:
                    if size >= BATCH:
                        yield from flush()
                        known, hot, docs, size = [], [], [], 0
                    now = int(part[a])
                n = int(lists[a:b].sum())
                for r in range(a, a + n):
                    known.append(batch.column("anchors")[r].values.to_numpy().view(np.uint64))
                    hot.append(np.stack([batch.column(c)[r].values.to_numpy() for c in ("hot", "salts")], axis=1))
                if a + n < b:
                    own = batch.slice(a + n, b - a - n).select(["doc_id", "sub", "text"])
                    for piece in _words.pieces(iter([own]), most=2 * BATCH):
                        docs.append(piece)
                        size += pc.sum(pc.binary_length(piece.column("text"))).as_py() or 0
                        if size >= 2 * BATCH:  # a part of many bytes: its anchors stay for the rest
                            yield from flush()
                            docs, size = [], 0
        yield from flush()

    return _arrow.map_batches(streams, emit, FOUND)


def _passages(docs: pa.Table, known: np.ndarray, hot: np.ndarray, part: int, window: int, width: int) -> Iterator[pa.RecordBatch]:
    doc, sub = docs.column("doc_id").to_numpy(), docs.column("sub").to_numpy()
    order = np.lexsort((sub, doc))
    # rows that repeat are one document; from here on earlier words are earlier in the corpus
    order = order[np.append(True, (doc[order][1:] != doc[order][:-1]) | (sub[order][1:] != sub[order][:-1]))]
    doc, sub = doc[order], sub[order]
    words = _words.split(docs.column("text").take(pa.array(order)).combine_chunks(), "space")
    first, place, anchor = anchors(words, window, width)
    at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
    wanted = known[at] == anchor
    first, place, anchor = first[wanted], place[wanted], anchor[wanted]
    if not len(first):
        return
    later = np.zeros(len(words.codes) + 1, np.int32)
    owner = np.searchsorted(words.bounds, first, side="right") - 1
    order, cut, group = _groups(first, words.codes, window)
    lead, n = _phrases(first, owner, order, cut, group, np.diff(np.append(cut, len(order))) > 1)
    if len(lead):
        phrase, start = Automata(words.codes, first[lead], n + window - 1).occurrences()
        good = _inside(words.bounds, start, n[phrase] + window - 1)[1]
        phrase, start = phrase[good], start[good]
        order = np.lexsort((start, phrase))
        again = order[1:][phrase[order][1:] == phrase[order][:-1]]
        np.add.at(later, start[again], 1)
        np.add.at(later, start[again] + n[phrase[again]], -1)
    # runs of consecutive windows with the same anchor and the same fate
    gone = np.cumsum(later)[first] > 0
    cut = np.append(True, (place[1:] != place[:-1]) | (first[1:] != first[:-1] + 1) | (gone[1:] != gone[:-1]))
    at = np.flatnonzero(cut)
    stop = np.append(at[1:], len(first)) - 1
    raw, word_at = spaced(words)
    begin, end = word_at[first[at]], word_at[first[stop] + window] - 1
    texts = [None if g else raw[a:b] for g, a, b in zip(gone[at].tolist(), begin.tolist(), end.tolist(), strict=True)]
    owner = owner[at]
    salt = np.full(len(at), -1, np.int64)
    if len(hot):
        hot = hot[np.argsort(hot[:, 0])]
        k = np.minimum(np.searchsorted(hot[:, 0], anchor[at].view(np.int64)), len(hot) - 1)
        salt = np.where(hot[k, 0] == anchor[at].view(np.int64), int(_words.mix(np.array([part], np.int64).view(np.uint64))[0] >> np.uint64(1)) % hot[k, 1], -1)
    out = [anchor[at].view(np.int64), salt, doc[owner], sub[owner], (first[at] - words.bounds[owner]).astype(np.int32)]
    yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(texts, pa.binary()), pa.array((stop - at + 1).astype(np.int32))], ["anchor", "salt", "doc_id", "sub", "start", "text", "n"])


def spaced(words: _words.Words) -> tuple[bytes, np.ndarray]:
    """All words with one space behind each, and where each begins (and the end)."""
    raw, offsets = words.data.tobytes(), words.offsets.tolist()
    texts = [b" ".join(raw[a:b].split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return b" ".join([*filter(None, texts), b""]), np.concatenate([[0], np.cumsum(words.ends - words.starts + 1)])


SETTLED = "doc_id long, sub long, start int, n int, text binary"


def settle(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Of passages (by anchor) the windows that occur earlier in others; and, text in hand, what is left of anchors that are dealt out in parts."""
    column = rows.column("text").combine_chunks().dictionary_encode()
    text = column.indices.to_numpy().astype(np.int64)
    doc, sub, start, salt = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "sub", "start", "salt"))
    order = np.lexsort((start, sub, doc, text))
    order = order[np.append(True, (np.diff(text[order]) != 0) | (np.diff(doc[order]) != 0) | (np.diff(sub[order]) != 0) | (np.diff(start[order]) != 0))]
    text, doc, sub, start, salt = text[order], doc[order], sub[order], start[order], salt[order]
    words = _words.split(column.dictionary, "space")
    n_texts = len(column.dictionary)
    places = np.bincount(text, minlength=n_texts)
    from_place = np.cumsum(places) - places
    split = np.zeros(n_texts, bool)
    split[text[salt >= 0]] = True
    # windows that two places have, in one passage or two
    first = _windows(words.bounds, window)
    owner = np.searchsorted(words.bounds, first, side="right") - 1
    order, cut, group = _groups(first, words.codes, window)
    met = np.add.reduceat(places[owner[order]], cut)
    lead, n = _phrases(first, owner, order, cut, group, met > 1)
    starts, lengths = first[lead], n + window - 1
    phrase, at = Automata(words.codes, starts, lengths).occurrences() if len(starts) else (np.zeros(0, np.int64),) * 2
    inside, good = _inside(words.bounds, at, lengths[phrase]) if len(at) else (at, np.zeros(0, bool))
    phrase, at, inside = phrase[good], at[good], inside[good]
    # an occurrence in a passage is one at each of its places
    times = places[inside]
    which = _words.ragged(from_place[inside], times)
    phrase, shift = np.repeat(phrase, times), np.repeat(at - words.bounds[inside], times)
    where = np.stack([doc[which], sub[which], start[which] + shift], axis=1)
    order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], phrase))
    phrase, where = phrase[order], where[order]
    head = np.append(True, phrase[1:] != phrase[:-1]) if len(phrase) else np.zeros(0, bool)
    lowest = where[np.flatnonzero(head)][np.cumsum(head) - 1] if len(phrase) else where
    gone = (where != lowest).any(axis=1)
    out, n = where[gone], lengths[phrase[gone]] - window + 1
    if len(out):
        order = np.lexsort((out[:, 2], out[:, 1], out[:, 0]))
        out, n = out[order], n[order]
        # neighbouring runs are one
        joined = (out[1:, :2] == out[:-1, :2]).all(axis=1) & (out[1:, 2] == out[:-1, 2] + n[:-1])
        cut = np.flatnonzero(np.append(True, ~joined))
        n = np.add.reduceat(n, cut)
        out = out[cut]
        yield _settled(out, n, pa.nulls(len(out), pa.binary()))
    if not split.any():
        return
    # each window of a split anchor goes on once, from its earliest place here
    raw, word_at = spaced(words)
    some = np.flatnonzero(split[owner])
    times = places[owner[some]]
    which = _words.ragged(from_place[owner[some]], times)
    window_of = np.repeat(some, times)
    where = np.stack([doc[which], sub[which], start[which] + first[window_of] - words.bounds[owner[window_of]]], axis=1)
    order = np.lexsort((where[:, 2], where[:, 1], where[:, 0], group[window_of]))
    head = order[np.append(True, np.diff(group[window_of][order]) != 0)]
    begin, end = word_at[first[window_of[head]]], word_at[first[window_of[head]] + window] - 1
    texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
    yield _settled(where[head], np.ones(len(head), np.int64), texts)


def _settled(where: np.ndarray, n: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(where[:, 2].astype(np.int32)), pa.array(n.astype(np.int32)), texts], ["doc_id", "sub", "start", "n", "text"])


def located(found: DataFrame, window: int) -> DataFrame:
    """Levels 2 and 3: settles passages that are dealt out by anchor and salt."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.column("text").nbytes < GROUP:
                continue
            anchor, salt = held.column("anchor").to_numpy(), held.column("salt").to_numpy()
            last = int(np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])))[-1])
            if last:
                yield from settle(held.slice(0, last), window)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from settle(held, window)

    dealt = found.select("anchor", "salt", "doc_id", "sub", "start", "text").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")
    return session.written(_arrow.map_batches(dealt, locate, SETTLED), "settled")


def repeats(docs: DataFrame, window: int, width: int) -> DataFrame:
    """(doc_id, sub, start, n): n windows from start on occur earlier elsewhere; docs: doc_id (none null), sub and text."""
    parts = max(8, -(-_arrow.input_bytes(docs) // PART))
    docs = docs.select("doc_id", "sub", "text", F.pmod(F.xxhash64("doc_id", "sub"), F.lit(parts)).alias("part"))
    known = recurring(anchor_rows(docs, window, width))
    lists = "array<bigint>"
    rows = docs.select("part", "doc_id", "sub", "text", *(F.lit(None).cast(lists).alias(c) for c in ("anchors", "hot", "salts")))
    known = known.select("part", *(F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("sub", "long"), ("text", "string"))), "anchors", "hot", "salts")
    streams = known.unionByName(rows).repartition("part").sortWithinPartitions("part", F.col("anchors").isNull())
    found = session.written(passages(streams, window, width), "passages")
    second = located(found.where("text is not null"), window)
    spans = found.where("text is null").select("doc_id", "sub", "start", "n").unionByName(second.where("text is null").drop("text"))
    left = second.where("text is not null")
    if left.isEmpty():
        return spans
    third = located(left.select(F.xxhash64("text").alias("anchor"), F.lit(-1).cast("long").alias("salt"), "doc_id", "sub", "start", "text"), window)
    return spans.unionByName(third.drop("text"))


RESULTS = "n_words long, n_removed long, kept string, kept_sha256 string"


def dedup(docs: DataFrame, window: int = WINDOW, width: int = ANCHOR, with_text: bool = True, carry: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, one space between; null unless with_text) and kept_sha256 of each document row.

    carry: also a struct `row` of all columns as they were.
    """
    spark = docs.sparkSession
    _arrow.prepare(spark)
    names_of = docs.columns
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if carry:
        own.append(F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row"))
    docs = docs.select(*own)
    known, unknown = docs.where("doc_id is not null"), docs.where("doc_id is null")
    # texts of one doc_id are told apart by their hashes, if any doc_id repeats
    once = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    known = known.withColumn("sub", F.lit(0).cast("long") if once else F.xxhash64("text"))
    again = repeats(known.select("doc_id", "sub", F.coalesce("text", F.lit("")).alias("text")), window, width)
    spans = again.groupBy("doc_id").agg(F.collect_list(F.struct("sub", "start", "n")).alias("spans"))
    joined = known.join(spans.hint("shuffle_hash"), "doc_id", "left")
    unknown = unknown.withColumn("sub", F.lit(0).cast("long")).withColumn("spans", F.lit(None).cast("array<struct<sub:bigint,start:int,n:int>>"))
    columns = ["doc_id", "sub", "spans", "text", *(["row"] if carry else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            total, removed, sha, kept = [], [], [], []
            for text, spans, sub in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("sub").to_pylist(), strict=True):
                words = (text or b"").split()
                total.append(len(words))
                left, at = words, 0
                own = sorted((s["start"], s["n"]) for s in spans or () if s["sub"] == sub)
                if own:
                    left = []
                    for start, n in own:
                        if start > at:
                            left += words[at:start]
                        at = max(at, start + n + window - 1)
                    left += words[at:]
                out = b" ".join(left)
                removed.append(len(words) - len(left))
                sha.append(hashlib.sha256(out).hexdigest())
                kept.append(out.decode() if with_text else None)
            arrays = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept", "kept_sha256"]
            if carry:
                arrays += [batch.column("row"), batch.column("text")]
                names += ["row", "text"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id long, {RESULTS}" + (f", row {docs.schema['row'].dataType.simpleString()}, text string" if carry else "")
    done = _arrow.map_batches(joined.select(*columns).unionByName(unknown.select(*columns)), cut, schema)
    if carry:
        return done.select("doc_id", "n_words", "n_removed", "kept", "kept_sha256", F.struct(*(F.col("text" if c == "text" else f"row.{c}").alias(c) for c in names_of)).alias("row"))
    return done.withColumnRenamed("kept", "text")


def query(spark, sf_dir: str) -> DataFrame:
    return dedup(session.table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
