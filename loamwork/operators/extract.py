"""Entities and relations of texts as table functions, for DataFrames and SQL: a text is walked once, and each row that it gives has its offsets.

    extract.register(spark)
    spark.sql("SELECT d.doc_id, r.* FROM documents d, LATERAL kb_relations(d.text) r")

Defined results: a null or empty text gives no rows; a relation that a text states several times is given once, where it is stated first.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.operators.entities import NEAR_DISTANCE, SIDE_DISTANCE, TRIGGERS, Extraction, columns, find

ENTITY = "start int, end int, uri string, alias string"
RELATION = "start int, end int, src string, rel string, dst string"

#: The same phrases for Python, where words are Unicode anyway.
_TRIGGERS = {rel: re.compile(pattern.replace("(?iuU)", "(?i)")) for rel, pattern in TRIGGERS.items()}


class Found:
    """The entities of a text, to be asked for those near a place."""

    def __init__(self, text: str, cfg: Extraction) -> None:
        self.rows = find(text, cfg)
        self.starts = [r[0] for r in self.rows]
        self.by_end = sorted(range(len(self.rows)), key=lambda i: (self.rows[i][1], i))
        self.ends = [self.rows[i][1] for i in self.by_end]

    def left(self, at: int) -> str | None:
        """The nearest one that ends before `at`: of those that end at the same place the first."""
        k = bisect_right(self.ends, at) - 1
        if k < 0 or at - self.ends[k] > SIDE_DISTANCE:
            return None
        return self.rows[self.by_end[bisect_left(self.ends, self.ends[k])]][2]

    def right(self, at: int) -> str | None:
        k = bisect_left(self.starts, at)
        return self.rows[k][2] if k < len(self.rows) and self.starts[k] - at <= SIDE_DISTANCE else None

    def nearest(self, at: int) -> tuple[str | None, str | None]:
        """The nearest one to either side of `at`, by its nearer end, and the nearest of another name."""
        low, high = at - NEAR_DISTANCE, at + NEAR_DISTANCE
        some = {*range(bisect_left(self.starts, low), bisect_right(self.starts, high)), *(self.by_end[k] for k in range(bisect_left(self.ends, low), bisect_right(self.ends, high)))}
        order = sorted((min(abs(self.rows[i][0] - at), abs(self.rows[i][1] - at)), i) for i in some)
        names = list(dict.fromkeys(self.rows[i][2] for _, i in order))[:2]
        return (*names, None, None)[:2]


def relations(text: str, cfg: Extraction = Extraction()) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, src, rel, dst) of each relation that a text states: the nearest entities left and right of a trigger, else the two nearest of different names."""
    stated = [(m.start(), m.end(), rel) for rel, pattern in _TRIGGERS.items() for m in pattern.finditer(text)]
    if not stated:
        return
    found, seen = Found(text, cfg), set()
    for start, end, rel in sorted(stated):
        src, dst = found.left(start), found.right(end)
        if src is None or dst is None or src == dst:
            src, dst = found.nearest(start)
        if src is not None and dst is not None and (src, rel, dst) not in seen:
            seen.add((src, rel, dst))
            yield start, end, src, rel, dst


def _functions(cfg: Extraction) -> tuple[type, type]:
    class Entities:
        def eval(self, text: str):
            yield from find(text or "", cfg)

        def cleanup(self):
            session.trim()

    class Relations:
        def eval(self, text: str):
            yield from relations(text or "", cfg)

        def cleanup(self):
            session.trim()

    return Entities, Relations


def register(spark: SparkSession, extraction: Extraction = Extraction(), prefix: str = "kb") -> None:
    """Lets SQL of this session call kb_entities(text) and kb_relations(text); with another prefix for another idea of what entities are."""
    session.ship(spark)
    for name, function, kind in zip(("entities", "relations"), _functions(extraction), (ENTITY, RELATION), strict=True):
        spark.udtf.register(f"{prefix}_{name}", F.udtf(function, returnType=kind, useArrow=True))


def entities_of(df: DataFrame, column: str = "text", extraction: Extraction = Extraction(), carry: list[str] | None = None) -> DataFrame:
    """Columns of df (carry; all if None) with start, end, uri and alias of each entity of its rows' texts."""
    return _each(df, column, ENTITY, lambda text: find(text, extraction), carry)


def relations_of(df: DataFrame, column: str = "text", extraction: Extraction = Extraction(), carry: list[str] | None = None) -> DataFrame:
    """Columns of df (carry; all if None) with start, end, src, rel and dst of each relation that its rows' texts state."""
    return _each(df, column, RELATION, lambda text: relations(text, extraction), carry)


#: Rows, and characters of carried texts, that leave a task at a time.
ROWS, CHARS = 8192, 4 << 20


def _each(df: DataFrame, column: str, kinds: str, walk: Callable[[str], Iterable[tuple]], carry: list[str] | None) -> DataFrame:
    """What the table functions give, over whole batches: a call for each text costs more than most texts do. A bounded number of rows leaves at a time."""
    session.ship(df.sparkSession)
    own = df.columns if carry is None else carry
    names = [f"_{i}" for i in range(len(own))]
    heavy, schema = column in own, ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, own, strict=True)), kinds])
    found = pa.schema([(n, pa.int32() if kind == "int" else pa.string()) for n, kind in (x.split() for x in kinds.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, chars = [], [], 0

            def full() -> pa.RecordBatch:
                place = pa.array(at, pa.int64())
                return pa.RecordBatch.from_arrays([*(batch.column(n).take(place) for n in names), *columns(rows, found)], [*names, *found.names])

            for low in range(0, batch.num_rows, 256):
                for k, value in enumerate(batch.column("_text").slice(low, 256).to_pylist(), low):
                    for row in walk(value or ""):
                        at.append(k)
                        rows.append(row)
                        chars += len(value) if heavy else 0
                        if len(rows) >= ROWS or chars >= CHARS:
                            yield full()
                            at, rows, chars = [], [], 0
            if rows:
                yield full()
        session.trim()

    out = df.select(*(F.col(c).alias(n) for c, n in zip(own, names, strict=True)), F.col(column).alias("_text")).mapInArrow(run, schema)
    return out.toDF(*own, *found.names)
