"""Vectorised word splitting over Arrow text columns.

All functions work on UTF-8 bytes of whole texts; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_BYTES = np.arange(256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 97) & (_BYTES < 123)) | ((_BYTES >= 65) & (_BYTES < 91))
_VISIBLE = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
_PUNCT = _VISIBLE & (_BYTES > 32) & (_BYTES < 127) & ~_ALNUM & (_BYTES != 39)
_PLAIN = _ALNUM & (_BYTES < 128)
#: kind: (bytes that belong to words, what each byte becomes)
KINDS = {"alnum": (_ALNUM, _LOWER), "space": (_VISIBLE, _SAME), "space_lower": (_VISIBLE, _LOWER), "pretoken": (_VISIBLE, _LOWER)}


@dataclass
class Words:
    """Words of some documents: word i has the code codes[i], the bytes vocab[codes[i]] and lies at starts[i]:ends[i] of data."""

    codes: np.ndarray
    vocab: pa.Array
    bounds: np.ndarray  # words of document d: bounds[d]:bounds[d + 1]
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    offsets: np.ndarray  # bytes of document d: offsets[d]:offsets[d + 1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word of vocab."""
        return hash_terms(self.vocab)


def hash_terms(terms: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(terms))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the bounds of each."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def split(texts: pa.Array, kind: str) -> Words:
    if not len(texts):
        texts = pa.array([""])[:0]
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.int32), pa.array([], pa.binary()), np.zeros(1, np.int64), empty, empty, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    inside, becomes = KINDS[kind]
    data, offsets = buffers(texts)
    member = inside[data]
    first, last = member.copy(), member.copy()
    first[1:] &= ~member[:-1]
    last[:-1] &= ~member[1:]
    full = offsets[:-1] < offsets[1:]
    edge = offsets[:-1][full]
    first[edge] = member[edge]
    edge = offsets[1:][full] - 1
    last[edge] = member[edge]
    if kind == "pretoken":
        cut = _between_letters_and_marks(data, member)
        first[cut + 1] = True
        last[cut] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    packed = becomes[data[member]]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(packed)])
    coded = words.dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets), starts, ends, data, offsets)


def _between_letters_and_marks(data: np.ndarray, member: np.ndarray) -> np.ndarray:
    """Bytes i after which ASCII punctuation (but the apostrophe) meets an ASCII letter or digit or a Latin-1 letter, or the other way round."""
    mark = _PUNCT[data]
    at = np.flatnonzero((mark[1:] != mark[:-1]) & member[1:] & member[:-1])
    left, right = data[at], data[at + 1]
    latin = lambda lead, trail: (lead == 0xC3) & (trail >= 0x80) & (trail != 0x97) & (trail != 0xB7)
    before = _PLAIN[left] | latin(data[np.maximum(at - 1, 0)], left)
    after = _PLAIN[right] | latin(right, data[np.minimum(at + 2, len(data) - 1)])
    return at[np.where(_PUNCT[left], after, before)]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` consecutive words (runs across documents included; callers mask them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base, out = np.uint64(0x9E3779B97F4A7C15), np.zeros(n, np.uint64)
    for j in range(width):
        out = out * base + hashes[j : j + n]
    return mix(out)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, .. (counts[0] numbers), then the same for the next."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - (ends - counts), counts)
