"""Tokenizing whole texts with a public tokenizer, each distinct word once for a worker.

White space always ends a pre-token of the tokenizer, and so does a change between letters and ASCII punctuation; so a text's ids are the ids of
such runs, one after the other. Runs (in lower case where the tokenizer lowers it) are looked up in a bounded cache; what is missing goes to the library. Texts that hold
the string of a special token, which the library turns into that token wherever it stands, go to the library as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from loamwork.llm import _words

CACHE_WORDS = 1_000_000

#: Letters whose normal form and lower case are single characters; a run of them is one pre-token.
_LETTERS = re.compile(r"[A-Za-zß-öø-ÿÀ-ÖØ-Þ]+")
#: ASCII punctuation but the apostrophe; a run of it is one pre-token.
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Encoder:
    """encode() gives ids of texts; one Encoder serves a Python worker."""

    _open: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        stands = _byte_letters()
        self.table = {b: stands[b] for b in range(256)}
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        kinds = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.simple = kinds == ["NFC", "Replace", "Lowercase"] and made["model"].get("end_of_word_suffix") == "</w>"
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(CACHE_WORDS + 1, np.int64)

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode()
        if self.simple and (_LETTERS.fullmatch(text) or _MARKS.fullmatch(text)):
            if not word.isascii():
                text = text.lower().encode().decode("latin-1").translate(self.table)
            return [t.id for t in self.model.tokenize(text)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts (uint32), and the bounds of each text's ids."""
        marked = np.zeros(len(texts), bool)
        for content in self.special:
            marked |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        ids, bounds = self._plain(pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts))
        parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in np.flatnonzero(marked):
            parts[k] = np.array(self.tokenizer.encode(texts[int(k)].as_py(), add_special_tokens=False).ids, np.uint32)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)

    def _plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = _words.split(texts, "pretoken" if self.simple else "space")
        vocab = words.vocab.to_pylist()
        if len(self.known) + len(vocab) > CACHE_WORDS:
            self._clear()
        if len(vocab) > CACHE_WORDS:
            ids = [self._ids(w) for w in vocab]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            begins = np.cumsum(sizes) - sizes
        else:
            known = self.known
            slots = np.empty(len(vocab), np.int64)
            fresh: list[int] = []
            n, used = len(known), int(self.at[len(known)])
            for k, w in enumerate(vocab):
                slot = known.get(w)
                if slot is None:
                    slot = known[w] = n
                    got = self._ids(w)
                    fresh.extend(got)
                    n += 1
                    used += len(got)
                    self.at[n] = used
                slots[k] = slot
            if fresh:
                done = used - len(fresh)
                if used > len(self.flat):
                    self.flat = np.concatenate([self.flat[:done], np.zeros(max(used, len(self.flat)), np.uint32)])
                self.flat[done:used] = fresh
            flat, begins, sizes = self.flat, self.at[slots], self.at[slots + 1] - self.at[slots]
        counts = sizes[words.codes]
        ids_at = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=ids_at[1:])
        return flat[_words.ragged(begins[words.codes], counts)], ids_at[words.bounds]


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    place = np.arange(len(ids), dtype=np.int64) + np.repeat(np.arange(n), np.diff(bounds))
    out[place] = ids
    return out, bounds + np.arange(n + 1)
