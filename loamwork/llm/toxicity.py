"""Toxicity of obfuscated text by a noisy channel.

1. A character trigram model (with word ends) is counted over the words of all documents; its table has a fixed size.
2. Words that may be disguised (symbols or digits among letters or behind them, separators between letters, a letter twice or more, letters spaced out)
   become character lattices: each written character may stand for letters, for nothing, or for fewer of itself, at a cost. Viterbi decoding
   finds the likeliest letters under the model. All other words, of which a lattice would have one path, are restored by dropping the marks around them.
   What is longer than LONGEST characters, repeats folded, is decoded in overlapping stretches, in which signs are looked for anywhere.
3. Signs of toxicity are learned from at most TRAIN_ROWS labelled rows: words of restored texts and beginnings of words that texts with label 1 have
   far more often than others. The character model is told of those that are words.
4. Logistic regression over presence and frequency of the signs, fitted on the same bounded rows, gives the score; every whole text is restored and scored.

Defined results: a null or empty text has no signs and the base score; labels that are null are ignored; a null doc_id is scored and not learned from
(held_out is null); repeated rows are scored each; without labels the score is 0.5; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _words
from loamwork.llm.quality import fold_column, training_labels

TRAIN_ROWS = 10_000
#: Texts with label 1 that a sign must have, how many times likelier they must have it, and how many signs are used.
MIN_ROWS, MIN_LIFT, SIGNS = 5, 4.0, 150
#: Lengths of beginnings of words that may be signs.
STEMS = range(4, 9)
RIDGE = 1.0
#: Characters that are decoded together; of longer words, stretches that overlap by half. From JOINED letters on a reading may hold several words.
LONGEST, JOINED = 64, 24

# What written characters may stand for.
STANDS = {
    "0": "o",
    "1": "il",
    "2": "z",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "i",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
    "£": "l",
    "¡": "i",
    "*": "abcdefghijklmnopqrstuvwxyz",
    "#": "abcdefghijklmnopqrstuvwxyz",
    "%": "abcdefghijklmnopqrstuvwxyz",
    "á": "a",
    "à": "a",
    "â": "a",
    "ä": "a",
    "å": "a",
    "ã": "a",
    "é": "e",
    "è": "e",
    "ê": "e",
    "ë": "e",
    "í": "i",
    "ì": "i",
    "î": "i",
    "ï": "i",
    "ó": "o",
    "ò": "o",
    "ô": "o",
    "ö": "o",
    "õ": "o",
    "ú": "u",
    "ù": "u",
    "û": "u",
    "ü": "u",
    "ñ": "n",
    "ç": "c",
    "а": "a",
    "е": "e",
    "о": "o",
    "р": "p",
    "с": "c",
    "у": "y",
    "х": "x",
    "і": "i",
}
#: Costs in natural logarithms: a symbol for a letter, an accent or twin of another script, a wild card, a dropped mark, a dropped repeat.
SYMBOL, TWIN, WILD, DROP, REPEAT = 0.7, 0.7, 3.0, 1.0, 0.5

LETTERS = "abcdefghijklmnopqrstuvwxyz"
N = len(LETTERS) + 2  # 0: word end, 27: any other character
_CODE = np.full(256, N - 1, np.int64)
for _i, _c in enumerate(LETTERS):
    _CODE[ord(_c)] = _i + 1
_NUMBER = {c: i + 1 for i, c in enumerate(LETTERS)}

_MARKS = "\"'`.,;:!?()[]{}<>|/\\*#$%&@^~_+=-–—…“”‘’«»„¿¡"
#: Something other than letters among letters, symbols for first or last letters, or a letter written twice.
_DISGUISED = re.compile(r"[a-z].*[^a-zß-ɏ].*[a-z]|[0-9@$!|+(][a-z]|[a-z][0-9@$!|+(€£*#%]+$|([a-z])\1|[a-z]..*[а-ӿ]|[а-ӿ].*[a-z]")
_FOLD = {ord(c): x for c, x in STANDS.items() if c.isalpha()}
_TAIL = re.compile(r"([^\w\s])\1+$")
#: Marks that stand for no letter: at the ends of a word a lattice can but drop them.
_DEAD = "".join(c for c in _MARKS if c not in STANDS)
_TWICE = re.compile(r"([a-z])\1")
MOST_CACHED = 200_000
#: Three of a character say as much as more.
_RUN = re.compile(r"(.)\1{3,}")


def count_trigrams(words: _words.Words) -> np.ndarray:
    """Counts of (character, character, next character) over the words of some documents."""
    if not len(words.vocab):
        return np.zeros(N**3, np.int64)
    offsets = np.frombuffer(words.vocab.buffers()[1], np.int32)[words.vocab.offset : words.vocab.offset + len(words.vocab) + 1].astype(np.int64)
    raw = np.frombuffer(words.vocab.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    times = np.bincount(words.codes, minlength=len(words.vocab))
    # each word with two ends before it and one behind
    size = np.diff(offsets) + 3
    at = np.concatenate([[0], np.cumsum(size)])
    stream = np.zeros(at[-1], np.int64)
    stream[np.arange(len(raw)) + np.repeat(at[:-1] + 2 - offsets[:-1], np.diff(offsets))] = _CODE[raw]
    third = _words.ragged(at[:-1] + 2, size - 2)
    key = (stream[third - 2] * N + stream[third - 1]) * N + stream[third]
    return np.bincount(key, weights=np.repeat(times, size - 2), minlength=N**3).astype(np.int64)


class Channel:
    """Character model and Viterbi decoder."""

    def __init__(self, counts: np.ndarray, signs: list[str]) -> None:
        c = counts.reshape(N, N, N).astype(np.float64)
        for word in signs:  # known signs weigh as much as a common word
            path = [0, 0, *(_NUMBER.get(x, N - 1) for x in word), 0]
            for i in range(2, len(path)):
                c[path[i - 2], path[i - 1], path[i]] += max(1.0, counts.sum() * 1e-3)
        one = c.sum(axis=(0, 1)) + 1
        one /= one.sum()
        two = (c.sum(axis=0) + 4 * one) / (c.sum(axis=(0, 2))[:, None] + 4)
        three = (c + 4 * two[None]) / (c.sum(axis=2, keepdims=True) + 4)
        self.table = -np.log(three)
        self.cost = self.table.tolist()
        self.signs = set(signs)
        self.cache: dict[str, str] = {}

    def options(self, char: str, run: int, inner: bool) -> list[tuple[str, float]]:
        """What a run of one written character may stand for, and at what cost."""
        out: list[tuple[str, float]] = []
        if char in _NUMBER:
            out = [(char * k, REPEAT * (run - k)) for k in range(1, min(run, 2) + 1)]
        elif char in STANDS:
            price = WILD if len(STANDS[char]) > 2 else TWIN if char.isalpha() else SYMBOL
            out = [(x, price + REPEAT * (run - 1)) for x in STANDS[char]]
            if run > 1 and price != WILD:
                out += [(x * 2, price + SYMBOL) for x in STANDS[char]]
        if char not in _NUMBER and not char.isalnum():
            out.append(("", DROP if inner or char in STANDS else 0.1))
        return out or [("?", 0.0)]

    def decode(self, word: str) -> str:
        """The likeliest letters behind a word ('?' for characters that stand for no letter)."""
        found = self.cache.get(word)
        if found is not None:
            return found
        runs: list[tuple[str, int]] = []
        for ch in word:
            if runs and runs[-1][0] == ch:
                runs[-1] = (ch, runs[-1][1] + 1)
            else:
                runs.append((ch, 1))
        # state: the last two letters -> cost and letters so far
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for k, (ch, n) in enumerate(runs):
            fresh: dict[tuple[int, int], tuple[float, str]] = {}
            options = self.options(ch, n, 0 < k < len(runs) - 1)
            for (a, b), (cost, text) in states.items():
                for letters, price in options:
                    x, y, total = a, b, cost + price
                    for letter in letters:
                        z = _NUMBER.get(letter, N - 1)
                        total += self.cost[x][y][z]
                        x, y = y, z
                    if (x, y) not in fresh or total < fresh[x, y][0]:
                        fresh[x, y] = (total, text + letters)
            states = fresh
        best = min((cost + self.cost[a][b][0], text) for (a, b), (cost, text) in states.items())[1]
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        self.cache[word] = best
        return best

    def costs(self, words: list[str]) -> np.ndarray:
        """What each word of plain letters costs as it stands."""
        raw = np.frombuffer("".join(f"\0\0{w}\0" for w in words).encode(), np.uint8)
        stream = np.where(raw == 0, 0, _CODE[raw])
        size = np.fromiter(map(len, words), np.int64, len(words)) + 3
        at = np.cumsum(size) - size
        third = _words.ragged(at + 2, size - 2)
        return np.add.reduceat(self.table[stream[third - 2], stream[third - 1], stream[third]], np.cumsum(size - 2) - size + 2)

    def learn_twice(self, words: list[str]) -> None:
        """Decodes at once all words of plain letters of which one letter stands twice: their lattices have two paths."""
        fresh = {}
        for w in words:
            bare = w.strip(_MARKS)
            if bare not in self.cache and bare not in fresh and bare.isascii() and bare.isalpha() and len(bare) <= LONGEST and len(twice := _TWICE.findall(bare)) == 1 and twice[0] * 3 not in bare:
                fresh[bare] = bare.replace(twice[0] * 2, twice[0])
        if not fresh:
            return
        if len(self.cache) + len(fresh) > MOST_CACHED:
            self.cache.clear()
        once = self.costs(list(fresh.values())) + REPEAT < self.costs(list(fresh))
        self.cache.update({w: x if o else w for (w, x), o in zip(fresh.items(), once.tolist(), strict=True)})

    def restore(self, word: str) -> tuple[str, ...]:
        """Readings of a lower-case word: without the marks around it and, if it looks disguised, decoded."""
        if word.isalpha() and word.isascii() and not _TWICE.search(word):
            return (word,)
        whole = _RUN.sub(r"\1\1\1", word)
        word = _TAIL.sub("", whole)
        bare = word.strip(_MARKS)
        if not bare:
            return ()
        if bare.isalpha() and len(bare) == len(word):
            if not bare.isascii():
                return (bare, bare.translate(_FOLD))
        if not _DISGUISED.search(whole):
            return (bare,)
        forms = {whole.strip(_DEAD), word.strip(_DEAD), bare}
        return tuple({bare} | {x for w in forms for x in self.stretches(w)} - {""})

    def stretches(self, word: str) -> set[str]:
        """The word decoded, in overlapping stretches if it is long."""
        return {self.decode(word[i : i + LONGEST]) for i in range(0, max(1, len(word) - LONGEST // 2), LONGEST // 2)}


def spelled(words: _words.Words) -> list[tuple[int, str]]:
    """(document, letters) of runs of three or more single characters set apart by spaces (marks after them dropped)."""
    size = words.ends - words.starts
    first = words.data[words.starts] if len(words.starts) else np.zeros(0, np.uint8)
    lone = (size == 1) | ((size == 2) & np.isin(words.data[np.maximum(words.ends - 1, 0)], np.frombuffer(b".,-_!*", np.uint8))) if len(size) else np.zeros(0, bool)
    lone &= (first < 128) & ~np.isin(first, np.frombuffer(b".,;:?-_&=", np.uint8))
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    start = np.flatnonzero(lone & ~(np.append(False, lone[:-1] & (doc[1:] == doc[:-1])) if len(lone) else lone))
    stop = np.flatnonzero(lone & ~(np.append(lone[1:] & (doc[1:] == doc[:-1]), False) if len(lone) else lone)) + 1
    long = stop - start >= 3
    return [(int(doc[a]), bytes(first[a:b]).decode().lower()) for a, b in zip(start[long], stop[long], strict=True)]


def restored(words: _words.Words, channel: Channel) -> tuple[list[tuple[str, ...]], list[tuple[int, tuple[str, ...]]]]:
    """Readings of each word of vocab, and of each run of spaced letters with its document."""
    vocab = [w.decode() for w in words.vocab.to_pylist()]
    channel.learn_twice(vocab)
    readings = [channel.restore(w) for w in vocab]
    runs = []
    for doc, text in spelled(words):
        text = re.sub(r"(.)\1{2,}", r"\1\1", text)
        if any(c in _NUMBER for c in text):
            # a run may hold several words: every stretch that is no longer than any disguise is decoded as one
            runs.append((doc, tuple(channel.stretches(text))))
    return readings, runs


def character_counts(docs: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in _words.pieces(batches):
            total += count_trigrams(_words.split(batch.column("text"), "space_lower"))
        yield _arrow.vector_row(total)

    return _arrow.sum_vectors(_arrow.map_batches(docs, count, "vector binary"), "int64", N**3)


def signs_of(readings: tuple[str, ...]) -> set[str]:
    """Possible signs of a word: its readings, and their beginnings (marked by a final asterisk)."""
    return {x for r in readings for x in (r, *(r[:k] + "*" for k in STEMS if k < len(r)))}


class Model:
    """Signs, their weights and the decoder; matrix() gives a row of features for each document."""

    def __init__(self, counts: np.ndarray, signs: list[str]) -> None:
        self.signs = signs
        self.number = {s: k for k, s in enumerate(signs)}
        self.channel = Channel(counts, [s for s in signs if s.isascii() and s.isalpha()])
        self.weights = np.zeros(2 * len(signs) + 1)
        self.words = [(k, s) for k, s in enumerate(signs) if s.isalpha()]

    def known(self, readings: tuple[str, ...]) -> list[int]:
        number, out = self.number, []
        for r in readings:
            if r in number:
                out.append(number[r])
            for k in STEMS:
                if k < len(r) and (stem := r[:k] + "*") in number:
                    out.append(number[stem])
            if len(r) >= JOINED:
                out += [k for k, word in self.words if len(word) >= 4 and word in r and r != word]
        return out

    def matrix(self, texts: pa.Array) -> np.ndarray:
        words = _words.split(texts, "space_lower")
        readings, runs = restored(words, self.channel)
        found = [self.known(r) for r in readings]
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((k for f in found for k in f), np.int64, int(size.sum()))
        count = np.zeros((len(texts), len(self.signs)))
        if len(words.codes):
            at = np.flatnonzero(size[words.codes])
            code = words.codes[at]
            doc = np.searchsorted(words.bounds, at, side="right") - 1
            np.add.at(count, (np.repeat(doc, size[code]), flat[_words.ragged((np.cumsum(size) - size)[code], size[code])]), 1)
        for doc, texts_of_run in runs:
            for k, word in self.words:
                if len(word) >= 4 and any(word in t for t in texts_of_run):
                    count[doc, k] += 1
        rate = np.log1p(1000 * count / (np.diff(words.bounds)[:, None] + 30))
        return np.concatenate([count > 0, rate, np.ones((len(texts), 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight (intercept) is free."""
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, counts: np.ndarray, train_rows: int = TRAIN_ROWS) -> Model:
    """The model from at most train_rows labelled texts, chosen by a hash of doc_id and then, where a doc_id has several rows, of the text."""
    spark = docs.sparkSession
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(train_rows)
    sample = session.written(docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["text", "label"]).select("text", "label"), "toxicity-sample")
    hashed = F.xxhash64("text", "label")
    if sample.count() > train_rows:  # only where doc_ids repeat
        last = sample.select(hashed.alias("h")).orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
        sample = session.written(sample.where(hashed <= last), "toxicity-sample")
    rows, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    channel = spark.sparkContext.broadcast(Channel(counts, []))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            words = _words.split(batch.column("text"), "space_lower")
            readings, runs = restored(words, channel.value)
            signs = [signs_of(r) for r in readings]
            spoken: dict[int, set[str]] = {}
            for d, texts in runs:
                spoken.setdefault(d, set()).update(texts)
            seen: dict[str, list[int]] = {}
            for d, label in enumerate(batch.column("label").to_pylist()):
                bag = set().union(*(signs[c] for c in np.unique(words.codes[words.bounds[d] : words.bounds[d + 1]])), spoken.get(d, set()))
                for x in bag:
                    seen.setdefault(x, [0, 0])[label] += 1
            if seen:
                no, yes = zip(*seen.values(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(no, pa.int64()), pa.array(yes, pa.int64())], ["sign", "no", "yes"])

    total = _arrow.map_batches(sample, tally, "sign string, no long, yes long").groupBy("sign").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    odds = F.log(((F.col("yes") + 0.5) / (ones + 1)) / ((F.col("no") + 0.5) / (rows - ones + 1)))
    strength = odds / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    best = total.where((F.col("yes") >= MIN_ROWS) & (odds >= math.log(MIN_LIFT))).orderBy(strength.desc(), F.length("sign").desc(), "sign").limit(SIGNS)
    model = Model(counts, [r["sign"] for r in best.collect()])
    if not rows or ones in (0, rows):
        share = (ones + 1) / (rows + 2)
        model.weights[-1] = math.log(share / (1 - share))
        return model
    sent = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _words.pieces(batches):
            x = sent.value.matrix(batch.column("text")).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])

    got = _arrow.map_batches(sample, measure, "label int, x binary").collect()  # at most train_rows rows
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(len(got), -1).astype(np.float64)
    model.weights = _logistic(x, np.array([r["label"] for r in got], np.float64))
    return model


def score(docs: DataFrame, model: Model, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        n = len(own.signs)
        names = np.array([*own.signs, ""], object)
        for batch in _words.pieces(batches):
            x = own.matrix(batch.column("text"))
            value = 1 / (1 + np.exp(-np.clip(x @ own.weights, -30, 30)))
            signs = [names[np.flatnonzero(r)].tolist() for r in x[:, :n]]
            out = [batch.column("doc_id"), pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(signs, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "predicted", "signs"])

    return _arrow.map_batches(docs, judge, "doc_id long, score double, predicted int, signs array<string>")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted and signs of each document row."""
    docs = _arrow.texts(docs)
    _arrow.prepare(docs.sparkSession)
    counts = character_counts(docs)
    scored = score(docs, learn(docs, training_labels(labels, "toxic"), counts, train_rows), threshold)
    return scored.select("doc_id", (fold_column(F.col("doc_id")) == 2).alias("held_out"), "score", "predicted", "signs")


def query(spark, sf_dir: str) -> DataFrame:
    found = classify(session.table(spark, sf_dir, "documents"), session.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("signs").alias("n_signs"))
