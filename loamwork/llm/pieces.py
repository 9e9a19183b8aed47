"""SentencePiece encoding that knows where each piece comes from, and decoding.

A text is normalised here, by longest prefixes through the model's compiled character map, and each normalised byte keeps its source bytes (`_charmap`).
The library cuts the normalised text into pieces with the same model, told to leave its input as it is; a piece's normalised bytes then give its span in the
original text: from the first byte that any of them comes from to the last. The space that the model puts in front of a text comes from no byte: its span
is empty. Ids are turned back into text by the library with the unchanged model.

Defined results: a null text is an empty one, which has begin and end ids only; repeated rows are encoded each; doc_id may be null; an empty table gives no
rows; extra columns are not read. Bytes that are no UTF-8 are read as U+FFFD. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loamwork import session
from loamwork.llm import _arrow, _charmap

#: Characters of text that are encoded together.
TOGETHER = 2 << 20


class Pieces:
    """One model in a worker."""

    _open: dict[str, Pieces] = {}

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        spec, suffix, surfaces, symbols, rest = b"", False, [], [], []
        kinds = []
        for number, value in _charmap.fields(data):
            if number == 1:
                said = dict(_charmap.fields(value))
                surfaces.append(said[1])
                kinds.append(said.get(3, 1))
                symbols += [said[1]] * (kinds[-1] == 4)
            elif number == 2:
                suffix = bool(dict(_charmap.fields(value)).get(24, 0))
            if number == 3:
                spec = value
            else:
                rest.append(_charmap.field(number, value))
        self.normalizer = _charmap.Normalizer(spec, suffix, symbols)
        #: bytes of normalised text that an id stands for; -1: only the library knows
        self.sizes = np.array([1 if k == 6 else -1 if k in (2, 3) else len(s) for s, k in zip(surfaces, kinds, strict=True)], np.int64)
        self.surfaces, self.kinds = surfaces, kinds
        as_it_is = b"".join(_charmap.field(k, v) for k, v in ((1, b"identity"), (3, 0), (4, 0), (5, 0)))
        self.cut = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + _charmap.field(3, as_it_is))
        self.whole = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """ids of each text (without begin and end), and the source spans of its pieces in bytes."""
        made = [self.normalizer.normalise(t) for t in texts]
        given = [out.decode(errors="replace") for out, _, _ in made]
        for (out, begins, ends), text, ids in zip(made, given, self.cut.encode(given, num_threads=1), strict=True):
            sizes = self.sizes[ids] if ids else np.zeros(0, np.int64)
            if ids and (sizes.min() < 0 or sizes.sum() != len(out)):
                ids, sizes = self._by_library(text)
            last = np.cumsum(sizes)
            if not len(last):
                yield ids, last, last
                continue
            first = last - sizes
            yield ids, begins[np.minimum(first, len(begins) - 1)], np.maximum.accumulate(ends)[np.maximum(last - 1, 0)]

    def _by_library(self, text: str) -> tuple[list[int], np.ndarray]:
        """Where unknown characters stand in a text, only the library can say how many bytes a piece has."""
        pieces = self.cut.encode(text, out_type="immutable_proto").pieces
        return [p.id for p in pieces], np.array([len(p.surface.encode()) for p in pieces], np.int64)


def _encode(batches: Iterator[pa.RecordBatch], path: str, special: bool) -> Iterator[pa.RecordBatch]:
    model = Pieces.of(path)
    bos, eos = ([model.whole.bos_id()], [model.whole.eos_id()]) if special else ([], [])
    head = np.zeros(len(bos), np.int64)
    for batch in batches:
        names, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary()).to_pylist()
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size + len(texts[high]) <= TOGETHER):
                size += len(texts[high])
                high += 1
            ids, begins, ends = [], [], []
            for (found, b, e), text in zip(model.encode([_utf8(t) for t in texts[low:high]]), texts[low:high], strict=True):
                ids.append(bos + found + eos)
                tail = np.full(len(eos), len(text))
                begins.append(np.concatenate([head, b, tail]))
                ends.append(np.concatenate([head, e, tail]))
            decoded = model.whole.decode(ids, num_threads=1)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(bounds[-1].as_py()))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (flat, np.concatenate(begins), np.concatenate(ends))]
            yield pa.RecordBatch.from_arrays([names.slice(low, high - low), *lists, pa.array(decoded, pa.string())], ["doc_id", "ids", "begins", "ends", "decoded"])
            low = high


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [batch.column(k) for k in ("ids", "begins", "ends")]
        at = lists[0].offsets.to_numpy()
        ids, begins, ends = ([x.values.to_numpy()[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x in lists)
        sha = lambda values: pa.array([hashlib.sha256(x).hexdigest() for x in values], pa.string())
        decoded = (x.as_buffer() for x in batch.column("decoded").cast(pa.binary()))
        spans = (b + e for b, e in zip(begins, ends, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at), pa.int64()), sha(ids), sha(decoded), sha(spans)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])


def encoded(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, ids (with begin and end ids if special), begins and ends (source bytes of each id), decoded (the text that the library makes of the ids)."""
    return _arrow.map_batches(_arrow.texts(docs), lambda batches: _encode(batches, path, special), "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(docs: DataFrame, path: str, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256 (begins, then ends, as little-endian 32-bit integers) of encoded()'s rows, without moving them."""
    return _arrow.map_batches(_arrow.texts(docs), lambda batches: _digest(_encode(batches, path, special)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")


def _utf8(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(session.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
