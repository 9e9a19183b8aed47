"""Token-ID output in patched frame-of-reference (PFOR) blocks.

A shard file holds the ids of consecutive documents as one stream, in blocks of BLOCK ids:
  magic | blocks | block starts (u64) | doc ids (i64) | ids per document (u64) | null flags of doc ids (u8) | footer
A block: minimum (u32), width (u8), number of exceptions (u16), the values less the minimum in `width` bits each
(lanes of 32 values, each lane bit-packed into `width` words of 32 bits), then places (u16) and full values (u32) of exceptions.
The width is chosen so that the given percentile of a block's values fits; larger ones are exceptions.
Documents are found by the prefix sums of the document index, their blocks by the block starts.

Defined results: a null or empty text has the end id alone; a null doc_id comes first and is read back as null; repeated doc_ids stand next to each other, each with its own ids; an empty table
writes no shard; extra columns are not read. A lost task writes its shard again under another name; only shards of the manifest count.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _tokens, _words

MAGIC = b"LWPFOR02"
BLOCK = 1024
#: Bytes of text from which a shard is closed, so that files and what a task holds stay small.
SHARD_TEXT = 64 << 20
_HEAD = struct.Struct("<IBH")
_FOOT = struct.Struct("<QQQQQ8s")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Blocks (rows) of values below 2**width, as rows of 32-bit words."""
    rows = values.shape[0]
    lanes = values.reshape(rows, BLOCK // 32, 32).astype(np.uint64)
    out = np.zeros((rows, BLOCK // 32, width + 1), np.uint64)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        moved = lanes[:, :, j] << np.uint64(shift)
        out[:, :, word] |= moved & np.uint64(0xFFFFFFFF)
        out[:, :, word + 1] |= moved >> np.uint64(32)
    return out[:, :, :width].astype("<u4").reshape(rows, -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = words.shape[0]
    if not width:
        return np.zeros((rows, BLOCK), np.uint32)
    lanes = np.zeros((rows, BLOCK // 32, width + 1), np.uint64)
    lanes[:, :, :width] = words.reshape(rows, BLOCK // 32, width)
    out = np.empty((rows, BLOCK // 32, 32), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(32):
        word, shift = divmod(j * width, 32)
        both = lanes[:, :, word] | (lanes[:, :, word + 1] << np.uint64(32))
        out[:, :, j] = (both >> np.uint64(shift)) & mask
    return out.reshape(rows, BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = 0.9) -> list[bytes]:
    """The blocks of a stream of ids; the last is filled up with its minimum."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    values = np.empty(n * BLOCK, np.uint32)
    values[: len(ids)] = ids
    tail = ids[(n - 1) * BLOCK :]
    values[len(ids) :] = tail.min()
    values = values.reshape(n, BLOCK)
    low = values.min(axis=1)
    rest = values - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    limit = np.partition(rest, rank, axis=1)[:, rank]
    widths = np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.int64)
    over = rest >> np.minimum(widths, 31)[:, None].astype(np.uint32) > 0
    over[widths >= 32] = False
    out: list[bytes] = [b""] * n
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        kept = np.where(over[rows], 0, rest[rows])
        packed = _pack(kept, int(width)) if width else np.zeros((len(rows), 0), "<u4")
        for k, row in enumerate(rows):
            places = np.flatnonzero(over[row])
            out[row] = _HEAD.pack(int(low[row]), int(width), len(places)) + packed[k].tobytes() + places.astype("<u2").tobytes() + rest[row][places].astype("<u4").tobytes()
    return out


def decode_blocks(raw: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of blocks that begin at starts in raw."""
    n = len(starts)
    heads = [_HEAD.unpack_from(raw, int(s)) for s in starts]
    widths = np.array([h[1] for h in heads], np.int64)
    out = np.empty((n, BLOCK), np.uint32)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        words = np.empty((len(rows), BLOCK // 32 * int(width)), "<u4")
        for k, row in enumerate(rows):
            words[k] = np.frombuffer(raw, "<u4", BLOCK // 32 * int(width), int(starts[row]) + _HEAD.size)
        out[rows] = _unpack(words, int(width))
    for row, (low, width, extra) in enumerate(heads):
        if extra:
            at = int(starts[row]) + _HEAD.size + BLOCK // 8 * width
            out[row][np.frombuffer(raw, "<u2", extra, at)] = np.frombuffer(raw, "<u4", extra, at + 2 * extra)
        out[row] += np.uint32(low)
    return out.reshape(-1)


def write_shard(stream, doc_ids: np.ndarray, counts: np.ndarray, parts: Iterator[np.ndarray], nulls: np.ndarray | None = None) -> int:
    """Writes one shard to a file object and returns its number of ids; nulls: which doc_ids are null."""
    stream.write(MAGIC)
    at, starts, total, rest = len(MAGIC), [], 0, np.zeros(0, np.uint32)
    for last, ids in _with_last(parts):
        rest = np.concatenate([rest, ids])
        cut = len(rest) if last else len(rest) // BLOCK * BLOCK
        for block in encode_blocks(rest[:cut]):
            starts.append(at)
            stream.write(block)
            at += len(block)
        total, rest = total + cut, rest[cut:]
    index = at
    stream.write(np.array(starts, "<u8").tobytes() + doc_ids.astype("<i8").tobytes() + counts.astype("<u8").tobytes() + (np.zeros(len(doc_ids)) if nulls is None else nulls).astype(np.uint8).tobytes())
    stream.write(_FOOT.pack(index, len(starts), len(doc_ids), total, BLOCK, MAGIC))
    return total


def _with_last(parts: Iterator[np.ndarray]) -> Iterator[tuple[bool, np.ndarray]]:
    held = np.zeros(0, np.uint32)
    for ids in parts:
        yield False, held
        held = ids
    yield True, held


class Shard:
    """Random access to a shard file: ids(d) are those of its d-th document."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        index, blocks, docs, self.total, _, magic = _FOOT.unpack(self._at(size - _FOOT.size, _FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        tables = self._at(index, 8 * blocks + 17 * docs)
        self.starts = np.append(np.frombuffer(tables, "<u8", blocks), index).astype(np.int64)
        self.doc_ids = np.frombuffer(tables, "<i8", docs, 8 * blocks)
        counts = np.frombuffer(tables, "<u8", docs, 8 * (blocks + docs)).astype(np.int64)
        self.nulls = np.frombuffer(tables, np.uint8, docs, 8 * (blocks + 2 * docs)) > 0
        self.bounds = np.concatenate([[0], np.cumsum(counts)])

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def span(self, first: int, stop: int) -> np.ndarray:
        """ids first:stop of the stream."""
        if stop <= first:
            return np.zeros(0, np.uint32)
        a, b = first // BLOCK, -(-stop // BLOCK)
        raw = self._at(int(self.starts[a]), int(self.starts[b] - self.starts[a]))
        return decode_blocks(raw, self.starts[a:b] - self.starts[a])[first - a * BLOCK : stop - a * BLOCK]

    def ids(self, doc: int) -> np.ndarray:
        return self.span(int(self.bounds[doc]), int(self.bounds[doc + 1]))

    def documents(self, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Runs of documents: number of the first, their bounds from 0 on, their ids."""
        first = 0
        while first < len(self.doc_ids):
            stop = max(first + 1, int(np.searchsorted(self.bounds, self.bounds[first] + most, side="right")) - 1)
            bounds = self.bounds[first : stop + 1]
            yield first, bounds - bounds[0], self.span(int(bounds[0]), int(bounds[-1]))
            first = stop


MANIFEST = "path string, part int, number int, first_doc long, n_docs long, n_ids long, bytes long"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order to shard files in folder; returns the manifest (a row for each shard)."""
    spark = docs.sparkSession

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = _tokens.Encoder.of(tokenizer)
        system, root = fs.FileSystem.from_uri(folder)
        rows: list[tuple] = []
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        seen = 0

        def close() -> None:
            if not held:
                return
            names = [d for x in held for d in x[0]]
            doc_ids, nulls = np.array([d or 0 for d in names], np.int64), np.array([d is None for d in names])
            counts = np.concatenate([np.diff(x[2]) for x in held])
            path = f"{root}/part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.pfor"
            with system.open_output_stream(path) as out:
                total = write_shard(out, doc_ids, counts, (x[1] for x in held), nulls)
                size = out.tell()
            rows.append((path, part, len(rows), names[0], len(doc_ids), total, size))
            held.clear()

        for batch in _words.pieces(batches):
            ids, bounds = _tokens.with_end(*encoder.encode(batch.column("text")), end_id)
            held.append((_arrow.ids_of(batch), ids, bounds))
            seen += batch.nbytes
            if seen >= SHARD_TEXT:
                close()
                seen = 0
        close()
        if rows:
            names = ["path", "part", "number", "first_doc", "n_docs", "n_ids", "bytes"]
            types = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    _arrow.prepare(spark)
    ordered = _arrow.texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return session.written(_arrow.map_batches(ordered, save, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the shard files of a manifest."""
    spark = manifest.sparkSession
    # tokens before each part (a row for each task that wrote), then before each shard of it
    parts = sorted((r["part"], r["n"]) for r in manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    shards = manifest.count()
    before = np.cumsum([0, *(n for _, n in parts)])
    first = spark.createDataFrame([(p, int(n)) for (p, _), n in zip(parts, before, strict=False)], "part int, before long")
    within = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(path) as source:
                    shard = Shard(source)
                    for first, bounds, ids in shard.documents():
                        n = len(bounds) - 1
                        raw = ids.astype("<u4").tobytes()
                        crc = [zlib.crc32(raw[4 * int(a) : 4 * int(b)]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                        before = start + shard.bounds[first]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.doc_ids[first : first + n], mask=shard.nulls[first : first + n]), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    if not shards:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    listing = manifest.withColumn("within", within).join(first, "part").select("path", (F.col("before") + F.col("within")).alias("start")).repartition(min(shards, 10_000))
    return _arrow.map_batches(listing, load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = session.fresh_path(spark, "tokens")
    manifest = write(session.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
