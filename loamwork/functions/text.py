"""Column functions over text: tokens, lexical scores, redaction, chunk spans, entity matches with offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 800, 120

# Patterns of secrets (the key is kept, its value masked), then of personal data.
SECRETS = [r"(?i)(api[_-]?key\s*[:=]\s*)([A-Za-z0-9_\-]{8,})", r"(?i)(secret\s*[:=]\s*)([A-Za-z0-9_\-]{8,})", r"(?i)(password\s*[:=]\s*)([^\s]{4,})"]
PERSONAL = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\+?\d[\d\-\s]{7,}\d"]

# A sentence with what parts it from the next.
SENTENCE = r"(?s).+?(?:[.!?](?:\s+|$)|\n+|$)"

# Words that queries over the graph leave out.
QUERY_STOPWORDS = ["the", "and", "with", "from", "that", "this", "for", "are", "как", "или", "для", "это", "что", "при", "mode", "query", "graph"]


def tokens(text: Column) -> Column:
    """Different lower-case words, in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def overlap(query: Column, text: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for a query without tokens."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(F.lit(0.0))


def memory_score(query: Column, text: Column) -> Column:
    """1 if the query stands in the text, else the share of its words (of two characters or more) that do."""
    q, t = F.lower(F.trim(query)), F.lower(F.trim(text))
    words = F.array_distinct(F.filter(F.split(F.replace(q, F.lit("-"), F.lit(" ")), r"\s+"), lambda w: F.length(w) > 1))
    share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: F.contains(t, w))) / F.size(words)).otherwise(F.lit(0.0))
    return F.when((q == "") | (t == ""), F.lit(0.0)).when(F.contains(t, q), F.lit(1.0)).otherwise(share)


def redact(text: Column) -> Column:
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, "$1***")
    for pattern in PERSONAL:
        text = F.regexp_replace(text, pattern, "***")
    return text


def query_tokens(query: Column) -> Column:
    """Tokens by which a query finds entities: three characters or more, without stopwords."""
    found = F.regexp_extract_all(F.lower(query), F.lit("[A-Za-zА-Яа-яЁё0-9_]{3,}"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(QUERY_STOPWORDS)))


def char_spans(length: Column, base: Column | None = None, most: int = MAX_CHARS, overlap_chars: int = OVERLAP) -> Column:
    """Windows of `most` characters, each `overlap_chars` into the one before: array of (start, end), ends exclusive."""
    if overlap_chars >= most:
        raise ValueError("overlap must be smaller than a chunk")
    base = F.lit(0) if base is None else base
    step = most - overlap_chars
    last = F.greatest(F.lit(0), F.ceil((length - most) / F.lit(step))).cast("int")
    spans = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct((base + i * step).cast("int").alias("start"), (base + F.least(length, i * step + most)).cast("int").alias("end")))
    return F.when(length > 0, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def tiles(pieces: Column) -> Column:
    """Array of strings that tile a text -> array of their (start, end)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        end = (acc["at"] + F.length(piece)).cast("int")
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["out"])


def pack_spans(spans: Column, most: int = MAX_CHARS) -> Column:
    """Joins neighbouring spans as long as a block is no longer than `most` (a longer single span is a block alone)."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), empty.alias("out"))

    def step(acc: Column, span: Column) -> Column:
        first, fits = acc["start"] < 0, (span["start"] == acc["end"]) & (span["end"] - acc["start"] <= most)
        return F.struct(
            F.when(~first & fits, acc["start"]).otherwise(span["start"]).alias("start"),
            span["end"].alias("end"),
            F.when(first | fits, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))).alias("out"),
        )

    return F.aggregate(spans, zero, step, lambda acc: F.when(acc["start"] < 0, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["start"].alias("start"), acc["end"].alias("end"))))))


def cut_long(spans: Column, most: int = MAX_CHARS, overlap_chars: int = OVERLAP) -> Column:
    """Replaces spans longer than `most` by overlapping windows."""
    return F.flatten(F.transform(spans, lambda s: F.when(s["end"] - s["start"] <= most, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(char_spans(s["end"] - s["start"], s["start"], most, overlap_chars))))


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))


def span_text(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def csv_list(value: Column) -> Column:
    """Trimmed, non-blank parts of a comma-separated text."""
    return F.filter(F.transform(F.split(value, ","), lambda s: F.trim(s)), lambda x: x != "")


def as_count(value: Column) -> Column:
    """An integer from loose text, 0 where there is none."""
    return F.coalesce(F.expr("try_cast(NULL AS BIGINT)"), value.try_cast("bigint"), F.lit(0))


def utc(value: Column) -> Column:
    """ISO-8601 text as a timestamp (zone-less: UTC), null where it is none; the session's zone must be UTC."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), "Z$", "+00:00"))
