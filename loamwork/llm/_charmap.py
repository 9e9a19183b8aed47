"""Text normalisation of a SentencePiece model, with the source of every byte.

A model file says how text becomes what pieces are cut from: user-defined symbols stay as they are; else the longest prefix that the compiled character map
knows is replaced; else one character is taken over. Spaces become U+2581, a first one may be put in front, and runs of them may shrink. Each normalised byte
keeps the span of source bytes it comes from: its own byte where text is taken over, the whole replaced prefix otherwise, nothing for a space put in front.

The compiled map is a double-array trie of 32-bit units (fixed format): bit 8 says that a value hangs below, bits 10-30 (shifted by 8 more if bit 9 is set)
give the place of the children, the low byte and the highest bit are the label; a value is the place of a replacement, ended by a zero byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = "▁".encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized protocol message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


def field(number: int, value: bytes | int) -> bytes:
    def digits(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return digits(number << 3) + digits(value) if isinstance(value, int) else digits(number << 3 | 2) + digits(len(value)) + value


class Trie:
    """Longest-prefix lookups in a compiled character map."""

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]

    @staticmethod
    def _below(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Length of the longest known prefix of data[at:] (0: none) and its replacement."""
        units = self.units
        found = value = 0
        if not units:
            return 0, b""
        node = self._below(units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or units[node] & 0x800000FF != data[k]:
                break
            has_value = units[node] >> 8 & 1
            node ^= self._below(units[node])
            if has_value:
                found, value = k + 1 - at, units[node] & 0x7FFFFFFF
        return (found, self.values[value : self.values.index(b"\0", value)]) if found else (0, b"")


class Normalizer:
    """normalise() gives normalised bytes and, for each, where its source begins and ends."""

    def __init__(self, spec: bytes, suffix: bool, symbols: list[bytes]) -> None:
        said = dict(fields(spec))
        self.trie = Trie(said.get(2, b""))
        self.dummy, self.shrink, self.escape = (bool(said.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.symbols = sorted(symbols, key=len, reverse=True)
        self.plain = not self.trie.units and not self.shrink and not self.symbols

    def normalise(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        return self._fast(data) if self.plain else self._whole(data)

    def _fast(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Nothing but spaces changes."""
        n = len(data)
        if not n:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64)
        space = SPACE if self.escape else b" "
        at = np.arange(n)
        if self.escape:
            at = np.repeat(at, np.where(np.frombuffer(data, np.uint8) == 32, len(space), 1))
        begins, ends = at, at + 1
        out = data.replace(b" ", space) if self.escape else data
        if self.dummy:
            edge = np.full(len(space), n if self.suffix else 0)
            parts = (lambda x: [x, edge]) if self.suffix else (lambda x: [edge, x])
            out, begins, ends = (out + space if self.suffix else space + out), np.concatenate(parts(begins)), np.concatenate(parts(ends))
        return out, begins, ends

    def _units(self, data: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
        """Begin and end of each prefix, what stands for it, and whether it is taken over as it is."""
        at = 0
        while at < len(data):
            symbol = next((s for s in self.symbols if data.startswith(s, at)), None)
            if symbol is not None:
                yield at, at + len(symbol), symbol, True
                at += len(symbol)
                continue
            size, value = self.trie.longest(data, at)
            if not size:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                yield at, at + size, data[at : at + size], True
            else:
                yield at, at + size, value, False
            at += size

    def _whole(self, data: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        space = SPACE if self.escape else b" "
        out, begins, ends = bytearray(), [], []
        after_space, started, last = self.shrink, False, 0

        def edge(at: int) -> None:
            out.extend(space)
            begins.extend([at] * len(space))
            ends.extend([at] * len(space))

        for begin, end, value, same in self._units(data):
            if not started:
                if self.shrink and value == b" ":
                    last = end
                    continue
                started = True
                if self.dummy and not self.suffix:
                    edge(begin)
            kept = value.lstrip(b" ") if after_space else value
            gone = len(value) - len(kept)
            for k, byte in enumerate(kept):
                low, high = (begin + gone + k, begin + gone + k + 1) if same else (begin, end)
                put = space if byte == 32 else bytes([byte])
                out.extend(put)
                begins.extend([low] * len(put))
                ends.extend([high] * len(put))
            if kept:
                after_space = kept.endswith(b" ")
            if not self.shrink:
                after_space = False
            last = end
        if self.shrink:
            while out.endswith(space):
                last = begins[len(out) - len(space)]
                del out[-len(space) :], begins[-len(space) :], ends[-len(space) :]
        if started and self.dummy and self.suffix:
            edge(last)
        return bytes(out), np.array(begins, np.int64), np.array(ends, np.int64)
