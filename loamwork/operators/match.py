"""Which of many short strings stand in which texts: a block of strings becomes an Aho-Corasick automaton, and every text runs through it once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork import session

#: Strings in an automaton; more strings make more passes.
BLOCK = 100_000


def _automaton(strings: list[str]):
    import ahocorasick

    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, s in enumerate(strings):
        found.add_word(s, k)
    found.make_automaton()
    return found


def contained(strings: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, string): the different strings (column `string`, not empty) that each text (column `text`) contains."""
    spark = texts.sparkSession
    session.ship(spark)
    strings = strings.select("string").where("string <> ''").distinct()
    blocks = max(1, -(-strings.count() // BLOCK))
    kinds = ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + ", string string"
    out = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(sorted(r[0] for r in strings.where(F.pmod(F.xxhash64("string"), F.lit(blocks)) == b).collect()))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            if not sent.value:
                return
            automaton, names = _automaton(sent.value), pa.array(sent.value, pa.string())
            for batch in batches:
                row, which = [], []
                for k, value in enumerate(batch.column("text").to_pylist()):
                    own = {x for _, x in automaton.iter(value or "")}
                    row += [k] * len(own)
                    which += sorted(own)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), names.take(pa.array(which, pa.int64()))], [*keys, "string"])
            del automaton
            session.trim()

        found = texts.select(*keys, "text").mapInArrow(find, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def query_words(query: Column) -> Column:
    """Different words of two characters or more of a lower-case query; hyphens part words."""
    return F.array_distinct(F.filter(F.split(F.replace(query, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 1))


def containing(queries: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """(qid, keys, score) over 0: 1 where the query (qid, query) stands in the text, else the share of its words that do; a text is read once for a block."""
    spark = texts.sparkSession
    session.ship(spark)
    low = queries.select("qid", F.lower(F.trim("query")).alias("q"))
    low = low.where("q <> ''").select("qid", "q", query_words(F.col("q")).alias("words"))
    blocks = max(1, -(-low.count() // 2048))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, " + ", ".join(f"{k} {texts.schema[k].dataType.simpleString()}" for k in keys) + ", score double"
    rows = texts.select(*keys, F.lower(F.trim("text")).alias("text"))
    out = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast([tuple(r) for r in low.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()])

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = sent.value
            if not asked:
                return
            number: dict[str, int] = {}
            ask = [number.setdefault(s, len(number)) for _, q, words in asked for s in (q, *words)]
            automaton = _automaton(list(number))
            sizes = np.array([len(words) for _, _, words in asked])
            at = np.cumsum(sizes + 1) - sizes - 1
            ask = np.array(ask)
            owner = np.repeat(np.arange(len(asked)), sizes + 1)
            word = np.ones(len(ask), bool)
            word[at] = False
            names = pa.array([q for q, _, _ in asked])
            for batch in batches:
                row, which, score = [], [], []
                for k, value in enumerate(batch.column("text").to_pylist()):
                    here = np.zeros(len(number), bool)
                    here[[x for _, x in automaton.iter(value or "")]] = True
                    share = np.bincount(owner[word], weights=here[ask[word]], minlength=len(asked)) / np.maximum(sizes, 1)
                    share[here[ask[at]]] = 1.0
                    own = np.flatnonzero(share > 0)
                    row.append(np.full(len(own), k))
                    which.append(own)
                    score.append(share[own])
                if row:
                    place = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(which))), *(batch.column(c).take(place) for c in keys), pa.array(np.concatenate(score))], ["qid", *keys, "score"])
            del automaton
            session.trim()

        found = rows.mapInArrow(find, kinds)
        out = found if out is None else out.unionByName(found)
    return out
