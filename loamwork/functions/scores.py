"""Column functions for scores: fusion, blending, reranking, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of vector, graph and memory scores; the constant of reciprocal ranks.
VECTOR, GRAPH, MEMORY, RRF_K = 0.70, 0.20, 0.10, 60


def linear(vector: Column, graph: Column, memory: Column, weights: tuple[float, float, float] = (VECTOR, GRAPH, MEMORY)) -> Column:
    return weights[0] * vector + weights[1] * graph + weights[2] * memory


def blend(base: Column, lexical: Column, mode: str) -> Column:
    """Fused score with the lexical share: 0.6/0.4 after linear fusion, 0.8/0.2 after reciprocal ranks."""
    return 0.8 * base + 0.2 * lexical if mode == "rrf" else 0.6 * base + 0.4 * lexical


def reranked(score: Column, rerank: Column) -> Column:
    return 0.7 * score + 0.3 * rerank


def unit_interval(raw: Column) -> Column:
    """Scores from 0 to 1 stay; others go through the logistic function."""
    return F.when(raw.between(0, 1), raw).otherwise(1 / (1 + F.exp(-raw)))


def rounded(x: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles: the scaled value goes to the nearest whole number (halves away from zero). F.round goes by the decimals that the
    value is printed with, which lie on the other side of some halves."""
    scale = 10.0**digits
    return F.round(x * scale) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def fit_dimensions(vector: Column, n: int) -> Column:
    """Cut or filled with zeros to n components."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), n)), 1, n)
