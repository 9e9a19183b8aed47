"""License scans by an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a document; a line of more than BLOCK words is cut into blocks that overlap by half, so that any run of up to BLOCK / 2 words lies
whole in one. A block meets a template if it holds at least `threshold` of the template's different words.
1. Blocks' document frequencies of all template words are counted over all documents: the global order, rarest first.
2. Each block keeps its template words in that order. Prefix filter: of a template with s words, t = ceil(threshold * s) must be found, so one of its
   s - t + 1 rarest words is in the block. Length filter: a block with fewer than t template words can't reach t. Positional filter: with a first
   common word at place i of the block's list and place j of the template's, at most 1 + min(what is left of either) can be common.
3. What is left is verified by counting. No pair is lost, whatever the frequencies.
A text that is wrapped over several lines is met by windows that reach across line ends: of a template with n words, a window of ceil(n / threshold) words
begins at each of the template's words, so that any run of that length or less lies in one; the same filters and the same verification follow.
Templates are a parameter; they are checked to be at most TEMPLATE_WORDS words in all, which bounds what is sent to the tasks.

Base labels come from phrases whose words stand consecutively anywhere in the text.

Defined results: a null or empty text has no words, no labels and score 0; repeated rows are scanned each; a doc_id may be null; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamwork import session
from loamwork.llm import _arrow, _words

BLOCK, THRESHOLD, TEMPLATE_WORDS = 256, 0.8, 100_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label -> sentences that state the license.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "the software is provided as is without warranty of any kind express or implied",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
    ],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by": ["licensed under cc by 4 0 international", "this work is licensed under a creative commons attribution 4 0 international license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "proprietary": ["all rights reserved no part of this publication may be reproduced without prior written permission"],
}


class Templates:
    """Templates as sets of word numbers in the global order."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str]) -> None:
        self.labels, sets = [], []
        for label in sorted(templates):
            for text in templates[label]:
                self.labels.append(label)
                sets.append(text.split())
        self.phrases = [(tuple(p.split()), label) for p, label in phrases.items()]
        self.words = sorted({w for s in sets for w in s} | {w for p, _ in self.phrases for w in p})
        if sum(map(len, sets)) > TEMPLATE_WORDS:
            raise ValueError("too many template words to send to tasks")
        self.vocab = pa.array([w.encode() for w in self.words], pa.binary())
        number = {w: k for k, w in enumerate(self.words)}
        self.sets = [np.array(sorted({number[w] for w in s}), np.int64) for s in sets]
        self.lengths = [len(s) for s in sets]
        self.runs = [(np.array([number[w] for w in p], np.int64), label) for p, label in self.phrases]

    def order(self, frequency: np.ndarray, threshold: float) -> None:
        """Fixes the global order: by rising frequency, then by word."""
        self.rank = np.empty(len(self.words), np.int64)
        self.rank[np.lexsort((np.arange(len(self.words)), frequency))] = np.arange(len(self.words))
        self.sorted = [np.sort(self.rank[s]) for s in self.sets]
        self.need = [math.ceil(threshold * len(s) - 1e-9) for s in self.sets]
        #: rank of a word -> (template, place) where it stands in a prefix
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sorted):
            for place, r in enumerate(s[: len(s) - self.need[k] + 1].tolist()):
                self.prefix.setdefault(r, []).append((k, place))
        self.in_prefix = np.zeros(len(self.words) + 1, bool)
        self.in_prefix[list(self.prefix)] = True
        self.least = min(self.need, default=0)
        self.spans = [math.ceil(n / threshold - 1e-9) for n in self.lengths]

    def match(self, block: np.ndarray) -> list[tuple[int, float]]:
        """(template, containment) of a block's different template words, given as rising ranks."""
        tried, out = set(), []
        for i, r in enumerate(block.tolist()):
            for k, j in self.prefix.get(r, ()):
                if k in tried:
                    continue
                tried.add(k)  # i and j are the first common places: prefixes are met in rising order
                share = self.share(k, block, i, j)
                if share:
                    out.append((k, share))
        return out

    def share(self, k: int, block: np.ndarray, i: int, j: int) -> float:
        """Containment of template k in a block whose place i and the template's place j are the first in common; 0 below the threshold."""
        size = len(self.sorted[k])
        if 1 + min(len(block) - i - 1, size - j - 1) < self.need[k]:
            return 0.0
        common = len(np.intersect1d(block, self.sorted[k], assume_unique=True))
        return common / size if common >= self.need[k] else 0.0

    def windows(self, at: np.ndarray, ranks: np.ndarray, stop: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, end, containment) of matching windows across line ends, given the places and ranks of template words, and where each one's document ends."""
        present = np.bincount(ranks, minlength=len(self.words)) > 0
        for k in sorted({k for r in np.flatnonzero(present & self.in_prefix[:-1]).tolist() for k, _ in self.prefix[r]}):
            need, own = self.need[k], self.sorted[k]
            some = np.flatnonzero(np.isin(ranks, own))
            place, rank = at[some], ranks[some]
            end = np.minimum(place + self.spans[k], stop[some])
            # length filter: the need-th word from the first still lies in the window
            j = np.flatnonzero(place[need - 1 :] < end[: len(place) - need + 1])
            rare = np.concatenate([[0], np.cumsum(rank <= own[len(own) - need])])
            last = np.searchsorted(place, end[j])
            for a, b in zip(j[rare[last] > rare[j]].tolist(), last[rare[last] > rare[j]].tolist(), strict=True):
                block = np.unique(rank[a:b])
                share = self.share(k, block, 0, int(np.searchsorted(own, block[0])))
                if share:
                    yield k, int(place[a]), int(place[b - 1]) + 1, share


def _blocks(words: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each block; blocks lie within documents."""
    if not len(words.codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.concatenate([[0], np.cumsum(words.data == 10)])
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    line = breaks[words.starts]
    at = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])))
    stop = np.append(at[1:], len(words.codes))
    long = stop - at > BLOCK
    if not long.any():
        return at, stop
    starts, stops = [at[~long]], [stop[~long]]
    for a, b in zip(at[long], stop[long], strict=True):
        s = np.arange(a, b - BLOCK // 2, BLOCK // 2)
        starts.append(s)
        stops.append(np.minimum(s + BLOCK, b))
    return np.concatenate(starts), np.concatenate(stops)


def _template_words(words: _words.Words, templates: Templates) -> tuple[np.ndarray, np.ndarray]:
    """Places of template words, and their numbers."""
    import pyarrow.compute as pc

    number = pc.fill_null(pc.index_in(words.vocab, value_set=templates.vocab), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    of = number[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    at = np.flatnonzero(of >= 0)
    return at, of[at]


def frequencies(docs: DataFrame, templates: Templates) -> np.ndarray:
    """In how many blocks of all documents each template word stands (once for each occurrence's block)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(templates.words), np.int64)
        for batch in _words.pieces(batches):
            words = _words.split(batch.column("text"), "alnum")
            at, number = _template_words(words, templates)
            first, _ = _blocks(words)
            block = np.searchsorted(np.sort(first), at, side="right")
            pair = np.unique(block * len(templates.words) + number)
            total += np.bincount(pair % len(templates.words), minlength=len(templates.words))
        yield _arrow.vector_row(total)

    return _arrow.sum_vectors(_arrow.map_batches(docs, count, "vector binary"), "int64", len(templates.words))


FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:bigint,end:bigint,label:string,containment:double>>"


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """Phrases, labels and matching blocks of each document row; score is the best containment (1 with a phrase)."""
    docs = _arrow.texts(docs)
    _arrow.prepare(docs.sparkSession)
    known = Templates(templates, phrases)
    known.order(frequencies(docs, known), threshold)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))
        for batch in _words.pieces(batches):
            n = batch.num_rows
            words = _words.split(batch.column("text"), "alnum")
            at, number = _template_words(words, own)
            total = len(words.codes)
            coded = np.full(total + 1, -1, np.int64)
            coded[at] = number
            doc_of = lambda place: np.searchsorted(words.bounds, place, side="right") - 1
            n_base, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for run, label in own.runs:
                start = at[number == run[0]]
                start = start[start + len(run) <= total]
                for k in range(1, len(run)):
                    start = start[coded[start + k] == run[k]]
                doc = doc_of(start)
                same = doc == doc_of(start + len(run) - 1)
                start, doc = start[same], doc[same]
                np.add.at(n_base, doc, 1)
                np.minimum.at(low, doc, start - words.bounds[doc])
                np.maximum.at(high, doc, start - words.bounds[doc])
                for d in np.unique(doc):
                    base[d].add(label)
            labels = [set(b) for b in base]
            best = np.where(n_base > 0, 1.0, 0.0)
            blocks: list[list[dict]] = [[] for _ in range(n)]
            first, stop = _blocks(words)
            # prefix and length filters over all blocks at once; overlapping blocks are counted by prefix sums
            ranks = own.rank[number]
            sums = np.concatenate([[0], np.cumsum(own.in_prefix[ranks])])
            a, b = np.searchsorted(at, first), np.searchsorted(at, stop)
            for k in np.flatnonzero((sums[b] > sums[a]) & (b - a >= own.least)):
                d = int(doc_of(first[k]))
                for t, share in own.match(np.unique(ranks[a[k] : b[k]])):
                    labels[d].add(own.labels[t])
                    best[d] = max(best[d], share)
                    blocks[d].append({"start": int(first[k] - words.bounds[d]), "end": int(stop[k] - words.bounds[d]), "label": own.labels[t], "containment": share})
            # of windows that overlap, the one with the largest containment becomes a block, unless it adds nothing to a block of the same label around it
            held: dict[tuple[int, int], list[list]] = {}
            for t, begin, end, share in own.windows(at, ranks, words.bounds[doc_of(at) + 1]):
                found = held.setdefault((int(doc_of(begin)), t), [])
                if found and begin < found[-1][3]:
                    found[-1][3] = end
                    if share > found[-1][2]:
                        found[-1][:3] = begin, end, share
                else:
                    found.append([begin, end, share, end])
            for (d, t), found in held.items():
                label, low_d = own.labels[t], int(words.bounds[d])
                labels[d].add(label)
                for begin, end, share, _ in found:
                    best[d] = max(best[d], share)
                    begin, end = begin - low_d, end - low_d
                    if not any(x["label"] == label and x["start"] <= begin and end <= x["end"] and x["containment"] >= share for x in blocks[d]):
                        blocks[d].append({"start": begin, "end": end, "label": label, "containment": share})
            none = n_base == 0
            out = [
                batch.column("doc_id"),
                pa.array(np.diff(words.bounds)),
                pa.array(n_base),
                pa.array(low, pa.int64(), mask=none),
                pa.array(high, pa.int64(), mask=none),
                pa.array([",".join(sorted(x)) for x in base], pa.string()),
                pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                pa.array(best),
                pa.array(blocks, kind),
            ]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    return _arrow.map_batches(docs, look, FOUND)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(session.table(spark, sf_dir, "documents")).drop("blocks")
