"""The knowledge base over a table of documents: documents and chunks with tenancy, tags and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamwork.functions import text


def doc_id_of(workspace: Column, path: Column) -> Column:
    """First 16 hex digits of sha1(workspace:path)."""
    return F.substring(F.sha1(F.concat_ws(":", workspace, path)), 1, 16)


def documents(docs: DataFrame) -> DataFrame:
    """kb_documents over (doc_id, text, lang, source): tenancy and time are functions of doc_id, so they can be recomputed anywhere."""
    n = F.col("doc_id")
    ws = F.concat(F.lit("w"), (n % 3).cast("string"))
    path = F.concat(F.lit("doc/"), n.cast("string"))
    reader = F.when(n % 2 == 0, F.array(F.lit("role:reader"))).otherwise(F.array().cast("array<string>"))
    return docs.select(
        n,
        F.concat(F.lit("kb://doc/"), doc_id_of(ws, path)).alias("doc_uri"),
        doc_id_of(ws, path).alias("doc_key"),
        ws.alias("workspace_id"),
        F.concat(F.lit("doc "), n.cast("string")).alias("title"),
        "source",
        path.alias("source_path"),
        F.concat(F.array(F.concat(F.lit("u"), (n % 5).cast("string"))), reader).alias("acl_allow"),
        F.array(F.concat(F.lit("lang:"), F.col("lang"))).alias("tags"),
        F.timestamp_add("HOUR", n.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("updated_at"),
        "text",
    )


def chunks(kb_docs: DataFrame, spans: Column | None = None) -> DataFrame:
    """One row for each chunk; char windows unless spans (array of start, end) are given."""
    spans = text.char_spans(F.length("text")) if spans is None else spans
    rows = kb_docs.select("*", F.posexplode(spans).alias("chunk_idx", "span"))
    return rows.select(
        F.concat(F.lit("kb://chunk/"), "doc_key", F.lit("_"), F.col("chunk_idx").cast("string")).alias("uri"),
        *[c for c in kb_docs.columns if c != "text"],
        "chunk_idx",
        "span",
        text.span_text(F.col("text"), F.col("span")).alias("text"),
    )
