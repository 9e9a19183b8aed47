"""Lexical retrieval packing: documents that share rare terms are packed into the same training sequences.

1. Every document is tokenized once; ids and each split's document frequencies are written to the shared folder.
2. Document frequencies of all documents are summed (one number for each id of the vocabulary) and sent to all tasks.
3. Documents are dealt out by content: each goes where its term of the largest BM25 weight is gathered (a term that very many documents have has as many
   places as its documents fill shards), whatever split of the table it came from. There they are cut in shards of SHARD_TOKENS ids.
4. A shard has a BM25 inverted index. A seed document asks it with all its terms for unused neighbours, best first, which fill the seed's window greedily
   until it is full; the neighbour that does not fit is cut, and its rest is the next seed. When no unused document shares a term with the
   seed, the next unused ones follow. So every sequence but a shard's last is full.

Defined results: a null or empty text is its end id alone; a document longer than a window fills whole windows, its rest is packed;
repeated rows are packed each by itself; a doc_id may be null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import _arrow, _tokens, _words

WINDOW = 2048
SHARD_TOKENS = 1 << 19
#: Neighbours that are put in order at a time.
STEP = 32
K1, B = 1.2, 0.75


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int) -> DataFrame:
    """doc_id, n and ids (binary) of each document; and a row for each split with its document frequencies (vector)."""
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokens.Encoder.of(tokenizer)
        found = np.zeros(vocabulary + 2, np.int64)  # then documents and tokens
        names = ["doc_id", "n", "ids", "vector"]
        for batch in _words.pieces(batches):
            ids, bounds = _tokens.with_end(*encoder.encode(batch.column("text")), end_id)
            small = ids.astype(dtype)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                found[np.unique(small[a:b])] += 1
            found[-2:] += len(bounds) - 1, len(ids)
            raw = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((bounds * small.itemsize).astype(np.int32)), pa.py_buffer(small)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(bounds)), raw, pa.nulls(batch.num_rows, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([found.tobytes()], pa.binary())], names)

    return session.written(_arrow.map_batches(_arrow.texts(docs), encode, "doc_id long, n long, ids binary, vector binary"), "packing-tokens")


def weighted_terms(ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, BM25 weight) of the different terms of documents, by document."""
    sizes = np.diff(bounds)
    key = np.sort(np.repeat(np.arange(len(sizes), dtype=np.int64), sizes) * len(idf) + ids)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(at, len(key)))
    doc, term = np.divmod(key[at], len(idf))
    return doc, term, (idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean)))).astype(np.float32)


class Index:
    """BM25 over the documents of a shard; idf comes from all documents."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        doc, term, weight = weighted_terms(np.concatenate(docs) if docs else np.zeros(0, np.int64), bounds, idf, mean)
        order = np.argsort(term.astype(np.uint16) if len(idf) <= 1 << 16 else term, kind="stable")
        self.docs, self.weights = doc[order], weight[order].astype(np.float64)
        self.at = np.searchsorted(term[order], np.arange(len(idf) + 1))
        self.terms, self.own = term, np.searchsorted(doc, np.arange(len(docs) + 1))
        self.unused = np.ones(len(docs), bool)

    def neighbours(self, doc: int) -> Iterator[int]:
        """Unused documents that share terms with doc, by falling score, ties by place."""
        terms = self.terms[self.own[doc] : self.own[doc + 1]]
        at = _words.ragged(self.at[terms], self.at[terms + 1] - self.at[terms])
        score = np.bincount(self.docs[at], weights=self.weights[at], minlength=len(self.unused)) * self.unused
        left = np.flatnonzero(score > 0)
        while len(left):
            if len(left) > STEP:
                least = np.partition(score[left], len(left) - STEP)[len(left) - STEP]
                best = left[score[left] >= least]
            else:
                best = left
            yield from best[np.argsort(-score[best], kind="stable")].tolist()
            left = left[score[left] < score[best].min()]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    index = Index(docs, idf, mean)
    sequence = 0
    begin = [0] * len(docs)  # what is left of a document starts here
    for k, ids in enumerate(docs):
        for start in range(0, len(ids) - window + 1, window):
            yield k, start, window, sequence, 0
            sequence += 1
            begin[k] = start + window
        if begin[k] == len(ids):
            index.unused[k] = False
    order, seed = 0, -1
    while True:
        if seed < 0:
            while order < len(docs) and not index.unused[order]:
                order += 1
            if order == len(docs):
                return
            seed = order
        index.unused[seed] = False
        near, filled, k, seed = index.neighbours(seed), 0, seed, -1
        while k >= 0:
            length = min(window - filled, len(docs[k]) - begin[k])
            yield k, begin[k], length, sequence, filled
            filled += length
            begin[k] += length
            index.unused[k] = False
            if begin[k] < len(docs[k]):
                seed = k
            if filled == window:
                break
            k = next(near, -1)
            if k < 0:
                while order < len(docs) and not index.unused[order]:
                    order += 1
                k = order if order < len(docs) else -1
        sequence += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents; with_ids adds their ids (little-endian, two bytes for vocabularies of up to 65,536 ids, else four)."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"
    tokens = tokenized(docs, tokenizer, end_id, vocabulary)
    counts = _arrow.sum_vectors(tokens.where(F.col("vector").isNotNull()), "int64", vocabulary + 2)
    n, total = int(counts[-2]), int(counts[-1])
    found = counts[:-2]
    idf = spark.sparkContext.broadcast(np.log1p((n - found + 0.5) / (found + 0.5)).astype(np.float32))
    often = spark.sparkContext.broadcast(found)
    mean = total / max(n, 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, have = idf.value, often.value
        for batch in _words.pieces(batches, "ids"):
            docs = [np.frombuffer(x.as_buffer(), dtype) for x in batch.column("ids")]
            bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
            doc, term, weight = weighted_terms(np.concatenate(docs), bounds, weights, mean)
            most = np.maximum.reduceat(weight, np.searchsorted(doc, np.arange(len(docs))))  # a document has its end id at least
            at = np.flatnonzero(weight == most[doc])
            best = term[at[np.append(True, doc[at][1:] != doc[at][:-1])]]
            # a term's documents fill so many shards at most
            places = np.maximum(1, have[best] * mean / SHARD_TOKENS).astype(np.int64)
            names = batch.column("doc_id").fill_null(0).to_numpy().astype(np.uint64)
            salt = (_words.mix(names) >> np.uint64(1)).astype(np.int64) % places
            yield pa.RecordBatch.from_arrays([pa.array(best * (1 << 31) + salt), batch.column("doc_id"), batch.column("ids")], ["place", "doc_id", "ids"])

    routed = _arrow.map_batches(tokens.where(F.col("vector").isNull()).select("doc_id", "ids"), route, "place long, doc_id long, ids binary")
    dealt = routed.repartition("place").sortWithinPartitions("place", "doc_id").select("doc_id", "ids")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        weights, held, names, size, sequences = idf.value, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal sequences
            pieces = list(pack_shard(held, weights, mean, window))
            cols = [np.array(c, np.int64) for c in zip(*pieces, strict=True)]
            crc, raw = [], []
            for k, start, length, _, _ in pieces:
                ids = held[k][start : start + length]
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                if with_ids:
                    raw.append(ids.tobytes())
            rows = cols[0]
            lengths = np.array([len(x) for x in held], np.int64)
            out = [pa.array([names[k] for k in rows], pa.int64()), pa.array(cols[1]), pa.array(cols[2]), pa.array(crc, pa.int64()), pa.array(lengths[rows]), pa.array((part << 32) + sequences + cols[3]), pa.array(cols[4])]
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                out.append(pa.array(raw, pa.binary()))
                labels.append("ids")
            sequences += int(cols[3].max()) + 1
            return pa.RecordBatch.from_arrays(out, labels)

        for batch in batches:
            for name, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                doc = np.frombuffer(ids.as_buffer(), dtype)
                names.append(name)
                held.append(doc)
                size += len(doc)
                if size >= SHARD_TOKENS:
                    yield flush()
                    names, held, size = [], [], 0
        if held:
            yield flush()

    return _arrow.map_batches(dealt, fill, PIECES + (", ids binary" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(session.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
