"""Query routing: intent, mode, reason, tools and plan steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Intent, its markers and its tools, in the order in which they are tried.
INTENTS = [
    ("memory_delete", ["удали память", "forget everything", "delete memory", "remove memory", "удали все что помнишь", "forget what you know"], ["kb_memory_delete"]),
    ("explainability", ["почему так ответил", "почему релевант", "explain relevance", "why this result", "объясни ответ"], ["kb_search", "kb_explain"]),
    ("relation_impact", ["завис", "dependency", "кто использует", "цепоч", "impact", "влия", "связ", "path"], ["kb_search", "kb_graph_expand"]),
    ("memory_context", ["прошл", "раньше", "what did we decide", "my context", "remember", "что мы решили", "мой контекст"], ["kb_memory_search", "kb_search"]),
    ("fact_lookup", [], ["kb_search"]),
]

# Markers of structural queries.
STRUCTURAL = ["завис", "dependency", "кто использует", "связ", "влия", "path", "impact"]

# Steps for which something must have been selected first.
CONDITIONS = {"kb_graph_expand": "seeds", "kb_explain": "uris", "kb_memory_delete": "allowed"}


def _holds(query: Column, markers: list[str]) -> Column:
    low = F.lower(query)
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in markers], F.lit(False))


def intent(query: Column, include_memory: Column) -> Column:
    out = F.lit("fact_lookup")
    for name, markers, _ in reversed(INTENTS[:-1]):
        test = _holds(query, markers)
        out = F.when(test | include_memory if name == "memory_context" else test, F.lit(name)).otherwise(out)
    return out


def reason(query: Column, mode: Column) -> Column:
    return F.when(mode != "hybrid", "requested_mode").when(_holds(query, STRUCTURAL), "structural_query").otherwise("default_hybrid")


def plans(spark: SparkSession) -> DataFrame:
    """(intent, step, tool, needs): a fixed table of a few rows."""
    return spark.createDataFrame([(name, i + 1, tool, CONDITIONS.get(tool, "")) for name, _, tools in INTENTS for i, tool in enumerate(tools)], "intent string, step int, tool string, needs string")


def route(queries: DataFrame) -> DataFrame:
    """queries (qid, query, mode, include_memory) with intent, reason and their plan steps."""
    known = queries.withColumn("intent", intent(F.col("query"), F.col("include_memory"))).withColumn("reason", reason(F.col("query"), F.col("mode")))
    return known.join(F.broadcast(plans(queries.sparkSession)), "intent")


def executed(steps: DataFrame, available: DataFrame) -> DataFrame:
    """steps (qid, step, tool, needs) with `skipped`: a step runs if what it needs is there (qid, seeds, uris, allowed: counts or flags)."""
    have = F.when(F.col("needs") == "seeds", F.col("seeds") > 0).when(F.col("needs") == "uris", F.col("uris") > 0).when(F.col("needs") == "allowed", F.col("allowed")).otherwise(True)
    return steps.join(available, "qid", "left").select("qid", "step", "tool", (~F.coalesce(have, F.lit(False))).alias("skipped"))
