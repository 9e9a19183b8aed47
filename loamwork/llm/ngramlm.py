"""Language-model scores from an Elias-Fano n-gram trie, of order 3 with all n-grams if not said otherwise.

Level 1 of the trie holds the hashes of all training words in rising order; a word's id is its place (words of equal 64-bit hashes are one). Level k holds an n-gram as the number
(place of its context in level k - 1) * V + (id of its last word). These numbers rise, so each level is one Elias-Fano sequence: a context's pointer is where its
first number would stand, and its successors follow, relative to it. A level is cut in shards of about SHARD_TOKENS counts (more from MOST_SHARDS shards on), a file
each in the shared folder, which tasks map into memory; a very frequent context may lie in several shards. A lookup goes to its number's bucket of high bits and
searches the successors there. Every shard costs a visit for each lot of lookups, so shards grow up to MOST_TOKENS once there are GROWN of them. All that tasks are sent is where shards begin (16 bytes for each).

Texts are split twice: to count words, and to write the documents' words as ids of level 1 to the shared folder (4 bytes each); all that follows reads ids.

Counting is distributed: tasks send sorted runs of (number, count) to the shards, which merge them. Level k is counted by looking up contexts in level k - 1;
n-grams above words that are met fewer than min_count times are left out, and their mass goes to the back-off weight (all are kept by default).
P(w) = (c + 0.5) / (N + 0.5 (V + 1)); above, interpolated absolute discounting: P(w | h) = max(c - D, 0) / C(h) + b(h) P(w | h'), b(h) = 1 - sum of the kept discounted
shares. Probabilities above words and back-off weights (in the order of their contexts) are kept as one byte each, the number of one of the levels of their shard.

Tokens are words and an end for each document. Defined results: a null or empty text is its end alone; training rows that repeat count each; a null doc_id is
scored and not learned from (held_out is null); without training rows every probability is 1 (an empty vocabulary has but the unknown word); an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _eliasfano, _words

ORDER, MIN_COUNT, DISCOUNT = 3, 1, 0.75
#: Bytes of the table (by the optimizer's estimate) for each shard of the words, tokens for each shard above.
SHARD_BYTES, SHARD_TOKENS, LEAST_SHARDS, MOST_SHARDS = 4 << 20, 500_000, 8, 1 << 20
#: Shards above words grow to so many tokens rather than be more than GROWN.
MOST_TOKENS, GROWN = 1_000_000, 256
#: Tokens that are looked up at once: what a task does for each shard is spread over them.
LOOKUPS = 1 << 21
#: Shards that a worker holds mapped, and bytes of shards that it has read from a store whose files cannot be mapped.
MOST_MAPPED, MOST_READ = 16384, 128 << 20
END = np.uint64(0x5D1E0F2B9C3A7741)
#: Steps of a shard's counts that the bounds of the next level are placed by; fewer for each of many shards.
_POINTS = 64
#: Numbers that are worked on at once where a whole shard would take much memory.
_STEP = 1 << 18

RUNS = "shard int, keys binary, counts binary, suffixes binary"
FILES = "shard int, n long, total long, points binary"


def planes(x: np.ndarray, dtype: str) -> bytes:
    """Numbers byte plane by byte plane (high planes are mostly zero and compress away)."""
    x = np.ascontiguousarray(x.astype(dtype))
    bytes_ = x.view(np.uint8).reshape(len(x), x.itemsize)
    out = np.empty((x.itemsize, len(x)), np.uint8)
    for j in range(x.itemsize):  # a transposed copy in one go is five times as slow
        out[j] = bytes_[:, j]
    return out.tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    rows = np.frombuffer(raw, np.uint8).reshape(size, -1)
    out = np.empty((rows.shape[1], size), np.uint8)
    for j in range(size):
        out[:, j] = rows[j]
    return out.view(dtype).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Rising numbers as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8")


def unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, "<u8"), dtype=np.uint64)


def merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums the counts of equal keys; a key has the same suffix everywhere."""
    if sum(len(r[0]) for r in runs) <= _STEP:
        return _merge(runs)
    # runs rise, so they are merged range by range of their keys: only one range is held more than once
    cuts = np.sort(np.concatenate([r[0][32::64] for r in runs]))[:: _STEP // 64]
    places = [np.concatenate([[0], np.searchsorted(r[0], cuts), [len(r[0])]]) for r in runs]
    parts = [_merge([tuple(x[p[i] : p[i + 1]] for x in r) for r, p in zip(runs, places, strict=True)]) for i in range(len(cuts) + 1)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _merge(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = np.concatenate([r[0] for r in runs])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.concatenate([r[1] for r in runs])[order].astype(np.int64)
    suffix = np.concatenate([r[2] for r in runs])
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts, suffix[order][at] if len(suffix) else suffix


def _quantise(x: np.ndarray, levels: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes and the levels they stand for (means of equally filled bins)."""
    book = np.zeros(256, np.float32)
    if not len(x):
        return np.zeros(0, np.uint8), book
    edges = np.quantile(x, np.arange(1, levels) / levels)
    codes = np.searchsorted(edges, x, side="right").astype(np.uint8)
    n = np.bincount(codes, minlength=256)
    total = np.bincount(codes, weights=x, minlength=256)
    book[n > 0] = total[n > 0] / n[n > 0]
    return codes, book


class Level:
    """Shards of one level: shard s holds numbers from bounds[s] on, its places start at offsets[s]."""

    def __init__(self, folder: str, k: int, bounds: np.ndarray, sizes: np.ndarray) -> None:
        self.folder, self.k = folder, k
        self.bounds = bounds.astype(np.uint64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def shard(self, s: int) -> tuple[_eliasfano.Sequence, dict[str, np.ndarray]] | None:
        if self.offsets[s] == self.offsets[s + 1]:
            return None
        arrays = _opened(_path(self.folder, self.k, s))
        return _eliasfano.Sequence(arrays), arrays

    @staticmethod
    def _runs(starts: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Shards (-1: before the first) and their runs of rising values."""
        cut = np.concatenate([[0], np.searchsorted(values, starts), [len(values)]])
        for s in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            yield s - 1, slice(int(cut[s]), int(cut[s + 1]))

    def _by(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        if len(shard):
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True):
                yield int(shard[order[a]]), order[a:b]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of rising numbers, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        for s, at in self._runs(self.bounds, keys):
            if s >= 0 and (shard := self.shard(s)):
                got = shard[0].find(keys[at] - self.bounds[s])
                out[at] = np.where(got >= 0, got + self.offsets[s], -1)
        return out

    def take(self, name: str, places: np.ndarray, book: str = "") -> np.ndarray:
        """An array's values at places of this level; with book, the levels that its codes stand for."""
        out = np.zeros(len(places), np.float64 if book else np.int64)
        rising = not len(places) or bool((places[1:] >= places[:-1]).all())
        for s, at in self._runs(self.offsets, places) if rising else self._by(np.searchsorted(self.offsets, places, side="right") - 1):
            arrays = self.shard(s)[1]
            got = arrays[name][places[at] - self.offsets[s]]
            out[at] = arrays[book][got] if book else got
        return out

    def backoff(self, contexts: np.ndarray, vocabulary: int) -> np.ndarray:
        """Logarithms of the back-off weights of contexts (places of the level below); 0 for those without successors."""
        out = np.zeros(len(contexts))
        first = contexts.astype(np.uint64) * np.uint64(vocabulary)
        # a context's weight is kept in every shard that has one of its successors: the last shard that begins before its end, or one before
        last = np.searchsorted(self.bounds, first + np.uint64(max(vocabulary - 1, 0)), side="right") - 1
        start = np.maximum(np.searchsorted(self.bounds, first, side="right") - 1, 0)
        done = np.zeros(len(contexts), bool)
        while not done.all():
            for s, at in self._by(np.where(done, -1, last)):
                if s < 0 or not (shard := self.shard(s)):
                    continue
                arrays = shard[1]
                k = contexts[at] - arrays["from"][0]
                inside = (k >= 0) & (k < len(arrays["backoff"]))
                code = arrays["backoff"][np.where(inside, k, 0)]
                hit = inside & (code > 0)
                out[at[hit]] = arrays["backoff_book"][code[hit] - 1]
                done[at[hit]] = True
            last = last - 1
            done |= last < start
        return out


def _path(folder: str, k: int, s: int) -> str:
    return f"{folder}/level{k}-{s:07d}.trie"


_open: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()


def _opened(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a shard: mapped, or read where the folder's files cannot be mapped. The last used ones are kept."""
    if uri in _open:
        _open.move_to_end(uri)
        return _open[uri][0]
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        _open[uri] = _eliasfano.map_arrays(path), 0
    else:
        with system.open_input_file(path) as source:
            raw = np.frombuffer(source.read(), np.uint8)
        _open[uri] = _eliasfano.arrays_of(raw), len(raw)
    while len(_open) > 1 and (len(_open) > MOST_MAPPED or sum(n for _, n in _open.values()) > MOST_READ):
        _open.popitem(last=False)
    return _open[uri][0]


class Trie:
    def __init__(self, order: int) -> None:
        self.order, self.levels, self.tokens, self.vocabulary = order, [], 0, 0

    @property
    def id_type(self) -> np.dtype:
        """How ids are written."""
        return np.dtype("<i4" if self.vocabulary < 1 << 31 else "<i8")

    def log_word(self, count: np.ndarray) -> np.ndarray:
        """log10 P of words with these training counts."""
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1)))

    def ids(self, words: _words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and training counts of the different words of some documents; each token's place among them, and the documents' bounds."""
        hashes = np.append(words.hashes(), END)
        order = np.argsort(hashes)
        place = np.empty(len(hashes), np.int64)
        place[order] = self.levels[0].find(hashes[order])
        known = np.flatnonzero(place >= 0)
        count = np.zeros(len(hashes), np.int64)
        count[known] = self.levels[0].take("counts", place[known])
        n = len(words.bounds) - 1
        token = np.full(len(words.codes) + n, len(hashes) - 1, np.int64)
        token[np.arange(len(words.codes)) + np.repeat(np.arange(n), np.diff(words.bounds))] = words.codes
        return place, count, token, words.bounds + np.arange(n + 1)

    def alone(self, ids: np.ndarray) -> np.ndarray:
        """log10 P of words by themselves."""
        each, which = np.unique(ids, return_inverse=True)
        count = np.zeros(len(each), np.int64)
        known = each >= 0
        count[known] = self.levels[0].take("counts", each[known])
        return self.log_word(count)[which]

    def contexts(self, before: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        context = np.append(-1, before[:-1]) if len(before) else before
        context[bounds[:-1][bounds[:-1] < len(before)]] = -1
        return context

    def keys(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return context.astype(np.uint64) * np.uint64(self.vocabulary) + ids.astype(np.uint64)

    def step(self, k: int, context: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places in level k of (context, id), -1 where there is none; and which tokens were looked up, the different places and each one's of them."""
        out = np.full(len(ids), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (ids >= 0))
        key, at = np.unique(self.keys(context[some], ids[some]), return_inverse=True)
        found = self.levels[k - 1].find(key)
        out[some] = found[at]
        return out, (some, found, at)

    def score(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 P of each token after those before it in its document."""
        out = np.zeros(len(ids))
        place = ids
        for k in range(2, self.order + 1):
            context = self.contexts(place, bounds)
            place, (some, found, at) = self.step(k, context, ids)
            if k == 2:  # the others have their bigram's
                rest = np.flatnonzero(place < 0)
                out[rest] = self.alone(ids[rest])
            missed = np.flatnonzero((place < 0) & (context >= 0))
            level = self.levels[k - 1]
            each, which = np.unique(context[missed], return_inverse=True)
            out[missed] += level.backoff(each, self.vocabulary)[which]
            p = np.zeros(len(found))
            p[found >= 0] = level.take("p", found[found >= 0], "p_book")
            met = found[at] >= 0
            out[some[met]] = p[at[met]]
        return out


def _shards(size: int, each: int) -> int:
    return int(min(MOST_SHARDS, max(LEAST_SHARDS, -(-size // each))))


def _shards_above(tokens: int) -> int:
    return _shards(tokens, max(SHARD_TOKENS, min(MOST_TOKENS, tokens // GROWN)))


def _run_rows(keys: np.ndarray, counts: np.ndarray, suffix: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    cut = np.append(np.searchsorted(keys, bounds[1:]), len(keys))
    starts = np.append(0, cut[:-1])
    full = [s for s in range(len(bounds)) if cut[s] > starts[s]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([pack_keys(keys[starts[s] : cut[s]]) for s in full], pa.binary()),
            pa.array([planes(counts[starts[s] : cut[s]], "<u4") for s in full], pa.binary()),
            pa.array([planes(suffix[starts[s] : cut[s]], "<i8") if len(suffix) else b"" for s in full], pa.binary()),
        ],
        ["shard", "keys", "counts", "suffixes"],
    )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Shards, each with its merged runs (rows come by shard)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size, now = 0, None
    for batch in batches:
        for shard, keys, counts, suffix in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if shard != now and held:
                whole, held, size = merge(held), [], 0
                yield now, *whole
            now = shard
            held.append((unpack_keys(keys), from_planes(counts, "<u4"), from_planes(suffix, "<i8")))
            size += len(held[-1][0])
            if size > 1 << 21:  # what has come is merged, so that equal keys are held once
                held = [merge(held)]
                size = len(held[0][0]) // 2
    if held:
        yield now, *merge(held)


def _points(counts: np.ndarray, n_shards: int) -> bytes:
    """(place, count before it) at even steps of the count; both ends of each step's entry."""
    total = np.concatenate([[0], np.cumsum(counts)])
    at = np.searchsorted(total, np.linspace(0, total[-1], max(2, min(_POINTS, (1 << 20) // n_shards))), side="right") - 1
    at = np.unique(np.clip(np.concatenate([at, at + 1]), 0, len(counts)))
    return np.stack([at, total[at]]).astype("<i8").tobytes()


def _save(folder: str, k: int, s: int, arrays: dict[str, np.ndarray]) -> None:
    """Writes a shard's file under another name first: a task that runs again puts the same file in its place."""
    system, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{uuid.uuid4().hex}.part"
    with system.open_output_stream(path) as out:
        _eliasfano.write_arrays(out, arrays)
    system.move(path, _path(root, k, s))


def _file_row(shard: int, n: int, total: int, points: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64()), pa.array([points], pa.binary())], ["shard", "n", "total", "points"])


def _dealt(runs: DataFrame) -> DataFrame:
    return runs.repartition("shard").sortWithinPartitions("shard")


def _level(folder: str, k: int, rows: list, bounds: np.ndarray) -> Level:
    sizes = np.zeros(len(bounds), np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    return Level(folder, k, bounds, sizes)


def count_texts(docs: DataFrame, folder: str, order: int = ORDER) -> tuple[Trie, list]:
    """Counts the words of docs and writes the files of level 1 to folder: a trie without levels above, and what is known of its shards."""
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    n_shards = _shards(_arrow.input_bytes(docs), SHARD_BYTES)
    trie = Trie(order)
    bounds = np.array([(s << 64) // n_shards for s in range(n_shards)], np.uint64)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            words = _words.split(batch.column("text"), "space_lower")
            keys = np.append(words.hashes(), END)
            counts = np.append(np.bincount(words.codes, minlength=len(words.vocab)), batch.num_rows)
            at = np.argsort(keys)
            yield _run_rows(keys[at], counts[at], np.zeros(0, np.int64), bounds)

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, counts, _ in _merged(batches):
            low = int(bounds[shard])
            high = int(bounds[shard + 1]) if shard + 1 < n_shards else 1 << 64
            arrays = _eliasfano.encode(keys - np.uint64(low), high - low) | {"counts": counts.astype("<u4" if counts.max() < 1 << 32 else "<u8")}
            _save(folder, 1, shard, arrays)
            yield _file_row(shard, len(keys), int(counts.sum()), _points(counts, n_shards))

    made = _made(_arrow.map_batches(_dealt(_arrow.map_batches(docs, count_words, RUNS)), first_level, FILES))
    trie.levels.append(_level(folder, 1, made, bounds))
    trie.tokens, trie.vocabulary = sum(r["total"] for r in made), sum(r["n"] for r in made)
    return trie, made


CODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, ids binary"


def coded(docs: DataFrame, trie: Trie) -> DataFrame:
    """Each document's ids, and what words alone say of it."""
    sent = docs.sparkSession.sparkContext.broadcast(trie)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in _words.pieces(batches):
            ids, counts, token, at = own.ids(_words.split(batch.column("text"), "space_lower"))
            sums = [np.add.reduceat(x[token], at[:-1]) for x in ((counts > 0).astype(np.int64), own.log_word(counts))]
            ids = ids.astype(own.id_type)[token]
            # the cast refuses what does not fit a row (a text of 2**29 words)
            raw = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), *map(pa.array, sums), raw], [c.split()[0] for c in CODED.split(", ")])

    return session.written(_arrow.map_batches(docs, code, CODED), "trie-ids")


def _looked_up(batches: Iterator[pa.RecordBatch], trie: Trie) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of some documents with about LOOKUPS tokens together, their ids and the documents' bounds."""
    most, held, size = LOOKUPS * trie.id_type.itemsize, [], 0

    def whole() -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        rows = pa.concat_batches(held)
        data, offsets = _words.buffers(rows.column("ids"))
        return rows, data.view(trie.id_type).astype(np.int64), offsets // trie.id_type.itemsize

    for batch in _words.pieces(batches, "ids", most):
        n = batch.column("ids").nbytes
        if held and size + n > most:
            yield whole()
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield whole()


def build(docs: DataFrame, folder: str, trie: Trie, made: list, min_count: int = MIN_COUNT, discount: float = DISCOUNT) -> None:
    """Counts the ids of docs and adds the levels above words to the trie, their files to folder."""
    n_shards = _shards_above(trie.tokens)
    for k in range(2, trie.order + 1):
        made, bounds = _higher(docs, folder, trie, k, made, n_shards, min_count, discount)
        trie.levels.append(_level(folder, k, made, bounds))


def _made(rows: DataFrame) -> list:
    """What is known of each shard: MOST_SHARDS rows at most, with _POINTS points or fewer."""
    table = session.written(rows, "trie-files")
    found = table.orderBy("shard").collect()
    session.drop(table)
    return found


def _even_bounds(made: list, level: Level, vocabulary: int, n_shards: int) -> np.ndarray:
    """Numbers of the next level that cut it in parts of about equal counts; a context with much of the count is cut within."""
    keys, before, done = [0], [0], 0
    for r in made:
        at, total = np.frombuffer(bytes(r["points"]), "<i8").reshape(2, -1)
        keys += [(int(level.offsets[r["shard"]]) + int(a)) * vocabulary for a in at]
        before += [done + int(t) for t in total]
        done += r["total"]
    bounds = [0]
    x = np.array(before, np.float64)
    for s in range(1, n_shards):
        want = done * s / n_shards
        i = int(np.clip(np.searchsorted(x, want, side="right") - 1, 0, len(x) - 2)) if len(x) > 1 else 0
        if len(x) > 1 and x[i + 1] > x[i]:
            key = keys[i] + int((keys[i + 1] - keys[i]) * ((want - x[i]) / (x[i + 1] - x[i])))
        else:
            key = keys[i]
        bounds.append(max(key, bounds[-1] + 1))
    return np.array(bounds, np.uint64)


RAW = "shard int, keys binary, counts binary, suffixes binary, edges binary"


def _higher(docs: DataFrame, folder: str, trie: Trie, k: int, made: list, n_shards: int, min_count: int, discount: float) -> tuple[list, np.ndarray]:
    spark = docs.sparkSession
    bounds = _even_bounds(made, trie.levels[-1], max(trie.vocabulary, 1), n_shards)
    size = np.uint64(max(trie.vocabulary, 1))
    if int(trie.levels[-1].offsets[-1]) * int(size) >= 1 << 64:
        raise ValueError(f"numbers of level {k} do not fit 64 bits: too many n-grams for this vocabulary")
    sent = spark.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for _, ids, at in _looked_up(batches, own):
            place = ids
            for j in range(2, k):
                place = own.step(j, own.contexts(place, at), ids)[0]
            context = own.contexts(place, at)
            some = np.flatnonzero((context >= 0) & (ids >= 0) & ((place >= 0) | (k == 2)))
            if not len(some):
                continue
            if k == 2:
                keys, counts = np.unique(own.keys(context[some], ids[some]), return_counts=True)
                yield _run_rows(keys, counts, np.zeros(0, np.int64), bounds)
            else:
                keys = own.keys(context[some], ids[some])
                order = np.argsort(keys)  # equal keys have equal suffixes
                first = np.flatnonzero(np.append(True, np.diff(keys[order]) != 0))
                yield _run_rows(keys[order[first]], np.diff(np.append(first, len(keys))), place[some[order[first]]], bounds)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for shard, keys, counts, suffix in _merged(batches):
            if min_count > 1:
                keep = counts >= min_count
                keys, counts, suffix = keys[keep], counts[keep], suffix[keep] if len(suffix) else suffix
            if not len(keys):
                continue
            mass, ctx = _joined([_mass(own, k, (keys[i : i + _STEP] // size).astype(np.int64), counts[i : i + _STEP], discount) for i in range(0, len(keys), _STEP)])
            edges = np.array([ctx[0], mass[0], ctx[-1], mass[-1]], np.float64) if len(ctx) > 1 else np.array([ctx[0], mass[0], -1, 0], np.float64)
            cols = [pa.array([shard], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack_keys(keys), planes(counts, "<u4"), planes(suffix, "<i8") if len(suffix) else b"", edges.tobytes()))]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "keys", "counts", "suffixes", "edges"])

    raw = session.written(_arrow.map_batches(_dealt(_arrow.map_batches(docs, count, RUNS)), prune, RAW), "trie-counts")
    # contexts that lie in several shards: the first and last of each shard
    total: dict[int, list[float]] = {}
    for r in raw.select("edges").collect():
        a, x, b, y = np.frombuffer(bytes(r["edges"]))
        for c, m in ((a, x), (b, y)):
            if c >= 0:
                total.setdefault(int(c), []).append(m)
    several = sorted(c for c, m in total.items() if len(m) > 1)
    shared = spark.sparkContext.broadcast((np.array(several, np.int64), np.array([sum(total[c]) for c in several])))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for shard, packed, n, suffix, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, counts, below = unpack_keys(packed), from_planes(n, "<u4"), from_planes(suffix, "<i8")
                parts = [_mass(own, k, (keys[i : i + _STEP] // size).astype(np.int64), counts[i : i + _STEP], discount) for i in range(0, len(keys), _STEP)]
                mass, ctx = _joined(parts)
                if len(shared.value[0]):
                    at = np.minimum(np.searchsorted(shared.value[0], ctx), len(shared.value[0]) - 1)
                    mass = np.where(shared.value[0][at] == ctx, shared.value[1][at], mass)
                weight = np.maximum(1 - mass, 1e-9)
                log_p = np.zeros(len(keys), np.float32)
                for i in range(0, len(keys), _STEP):
                    some = slice(i, i + _STEP)
                    context = (keys[some] // size).astype(np.int64)
                    if k == 2:
                        lower = own.log_word(own.levels[0].take("counts", (keys[some] % size).astype(np.int64)))
                    else:
                        lower = own.levels[-1].take("p", below[some], "p_book")
                    share = np.maximum(counts[some] - discount, 0) / own.levels[-1].take("counts", context)
                    log_p[some] = np.log10(share + weight[np.searchsorted(ctx, context)] * 10**lower)
                p, p_book = _quantise(log_p)
                b, b_book = _quantise(np.log10(weight), 255)
                backoff = np.zeros(ctx[-1] - ctx[0] + 1, np.uint8)
                backoff[ctx - ctx[0]] = b + 1  # 0: no successor
                low = int(bounds[shard])
                arrays = _eliasfano.encode(keys - np.uint64(low), int(keys[-1]) - low + 1)
                arrays |= {"p": p, "p_book": p_book, "from": ctx[:1], "backoff": backoff, "backoff_book": b_book}
                if k < own.order:
                    arrays["counts"] = counts.astype("<u4")
                _save(folder, k, shard, arrays)
                yield _file_row(shard, len(keys), int(counts.sum()), _points(counts.astype(np.int64), n_shards))

    done = _made(_arrow.map_batches(raw, finish, FILES))
    session.drop(raw)
    return done, bounds


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Shares and contexts of consecutive parts; a context that goes on in the next part is summed."""
    mass, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
    return np.add.reduceat(mass, at), ctx[at]


def _mass(trie: Trie, k: int, context: np.ndarray, counts: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """Kept discounted share of each different context (contexts rise)."""
    at = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    ctx = context[at]
    kept = np.add.reduceat(np.maximum(counts - discount, 0), at)
    return kept / trie.levels[k - 2].take("counts", ctx), ctx


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """What `coded` gives, with the scores in place of the ids."""
    sent = docs.sparkSession.sparkContext.broadcast(trie)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for rows, ids, at in _looked_up(batches, own):
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(np.add.reduceat(own.score(ids, at), at[:-1]))], [c.split()[0] for c in SCORES.split(", ")])

    return _arrow.map_batches(docs, judge, SCORES)


def train_and_score(docs: DataFrame, order: int = ORDER, folder: str | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document row; learns from rows whose crc32(doc_id as text) is not 1 modulo 5."""
    spark = docs.sparkSession
    _arrow.prepare(spark)
    docs = _arrow.texts(docs)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    docs, folder = docs.withColumn("held_out", fold == 1), folder or session.fresh_path(spark, "trie")
    trie, made = count_texts(docs.where("not held_out").select("text"), folder, order)
    docs = coded(docs, trie)
    build(docs.where("not held_out").select("ids"), folder, trie, made, min_count)
    return score(docs, trie).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trie.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return train_and_score(session.table(spark, sf_dir, "documents"))
