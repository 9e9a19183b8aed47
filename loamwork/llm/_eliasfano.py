"""Elias-Fano sequences in files that are mapped into memory, with vectorised successor search."""

from __future__ import annotations

import mmap

import numpy as np

_ONES, _HIGHS = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the k-th set bit of a byte.
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Values below 2**bits, one after the other, in words of 64 bits."""
    n = len(values)
    out = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    if not bits:
        return out
    values = values.astype(np.uint64)
    for j in range(min(64, n)):
        v = values[j::64]
        at = np.arange(len(v), dtype=np.int64) * bits + (j * bits >> 6)
        shift = np.uint64(j * bits & 63)
        out[at] |= v << shift
        if (j * bits & 63) + bits > 64:
            out[at + 1] |= v >> (np.uint64(64) - shift)
    return out


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    """The values at the given places."""
    if not bits:
        return np.zeros(len(at), np.uint64)
    place = at.astype(np.int64, copy=False) * bits
    word, shift = place >> 6, (place & 63).astype(np.uint64)
    out = words[word] >> shift
    # two shifts, as one by 64 is none
    out |= (words.take(word + 1, mode="clip") << np.uint64(1)) << (np.uint64(63) - shift)
    out &= np.uint64((1 << bits) - 1)
    return out


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """A rising sequence of 64-bit numbers below universe (up to 2**64) as arrays: parameters, low bits, high bits, zeros before each block."""
    n = len(values)
    bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
    values = values.astype(np.uint64)
    high = (values >> np.uint64(bits)).astype(np.int64)
    length = n + ((universe - 1) >> bits) + 2
    length += -length % 64
    marks = np.zeros(length, np.uint8)
    marks[high + np.arange(n)] = 1
    words = np.packbits(marks, bitorder="little").view(np.uint64)
    zeros = np.zeros(len(words) + 1, np.int64)
    np.cumsum(64 - np.bitwise_count(words).astype(np.int64), out=zeros[1:])
    return {"shape": np.array([n, bits], np.int64), "low": pack(values & np.uint64((1 << bits) - 1), bits), "high": words, "zeros": zeros.astype("<u4" if length < 1 << 32 else "<i8")}


def select_bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the rank-th set bit (from 0) of each word, which has more than rank."""
    u = np.uint64
    s = words - ((words >> u(1)) & u(0x5555555555555555))
    s = (s & u(0x3333333333333333)) + ((s >> u(2)) & u(0x3333333333333333))
    s = ((s + (s >> u(4))) & u(0x0F0F0F0F0F0F0F0F)) * _ONES  # set bits up to each byte
    rank = rank.astype(np.uint64)
    byte = np.bitwise_count(((rank * _ONES | _HIGHS) - s) & _HIGHS).astype(np.uint64) << u(3)
    before = ((s << u(8)) >> byte) & u(255)
    return byte.astype(np.int64) + _IN_BYTE[((words >> byte) & u(255)).astype(np.int64), (rank - before).astype(np.int64)]


class Sequence:
    """An encoded sequence (its arrays may be memory-mapped)."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = "") -> None:
        n, bits = arrays[prefix + "shape"]
        self.n, self.bits = int(n), int(bits)
        self.low, self.high, self.zeros = (arrays[prefix + k] for k in ("low", "high", "zeros"))

    def _select_zero(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), side="right") - 1
        return word * 64 + select_bit(~self.high[word], k - self.zeros[word])

    def _zero_after(self, place: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Places of the k-th zeros, of which the one before is at place: mostly in the same word."""
        word = place >> 6
        rest = ~self.high[word] & ~((np.uint64(2) << (place & 63).astype(np.uint64)) - np.uint64(1))
        out = word * 64 + np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1))
        far = np.flatnonzero(rest == 0)
        if len(far):
            out[far] = self._select_zero(k[far])
        return out

    def find(self, values: np.ndarray) -> np.ndarray:
        """The index of each value, -1 where the sequence does not hold it: its successor is searched in the value's bucket of high bits."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        live = np.flatnonzero(high < int(self.zeros[-1]))
        high, want = high[live], values[live] & np.uint64((1 << self.bits) - 1)
        # values of the bucket: those between two zeros
        before = np.full(len(live), -1, np.int64)
        some, none = np.flatnonzero(high > 0), np.flatnonzero(high == 0)
        before[some] = self._select_zero(high[some] - 1)
        low = before + 1 - high
        stop = np.empty(len(live), np.int64)
        stop[some] = self._zero_after(before[some], high[some]) - high[some]
        stop[none] = self._select_zero(high[none])
        some = np.flatnonzero(low < stop)
        live, want, low, stop = live[some], want[some], low[some], stop[some]
        # the last entry that is not above: in a bucket of one there is nothing to search
        open_ = np.flatnonzero(stop - low > 1)
        a, b, asked = low[open_], stop[open_], want[open_]
        while len(open_):
            mid = (a + b) >> 1
            above = unpack(self.low, self.bits, mid) > asked
            a, b = np.where(above, a, mid), np.where(above, mid, b)
            low[open_] = a
            on = np.flatnonzero(b - a > 1)
            if len(on) < len(open_):
                open_, a, b, asked = open_[on], a[on], b[on], asked[on]
        hit = np.flatnonzero(unpack(self.low, self.bits, low) == want)
        out[live[hit]] = low[hit]
        return out

    def values(self) -> np.ndarray:
        """All values."""
        marks = np.unpackbits(np.ascontiguousarray(self.high).view(np.uint8), bitorder="little")
        at = np.flatnonzero(marks)[: self.n]
        k = np.arange(self.n)
        return ((at - k).astype(np.uint64) << np.uint64(self.bits)) | unpack(self.low, self.bits, k)


MAGIC = b"LWEFT001"


def write_arrays(stream, arrays: dict[str, np.ndarray]) -> None:
    """Named arrays, each at a multiple of 64 bytes, then their directory."""
    import json

    stream.write(MAGIC + b"\0" * 56)
    at, names = 64, {}
    for name, x in arrays.items():
        raw = np.ascontiguousarray(x)
        names[name] = [raw.dtype.str, list(raw.shape), at]
        data = raw.tobytes()
        pad = -len(data) % 64
        stream.write(data + b"\0" * pad)
        at += len(data) + pad
    raw = json.dumps(names).encode()
    stream.write(raw + len(raw).to_bytes(8, "little"))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a local file, mapped; no file stays open for it, as a process may have few."""
    with open(path, "rb") as source:
        return arrays_of(np.frombuffer(mmap.mmap(source.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False), np.uint8))


def arrays_of(whole: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a file's bytes."""
    import json

    if bytes(whole[:8]) != MAGIC:
        raise ValueError("not a file of arrays")
    size = int.from_bytes(bytes(whole[-8:]), "little")
    names = json.loads(bytes(whole[-8 - size : -8]))
    out = {}
    for name, (dtype, shape, at) in names.items():
        n = int(np.prod(shape)) * np.dtype(dtype).itemsize
        out[name] = whole[at : at + n].view(dtype).reshape(shape)
    return out
