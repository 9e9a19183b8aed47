"""Registered queries of this subpackage: name -> callable(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: name of the query: module whose query() it is
MODULES = {
    "op1_near_duplicates": "neardup",
    "op2_toxicity": "toxicity",
    "op3_decontamination": "decontam",
    "op4_token_files": "tokenfile",
    "op5_license_scan": "licenses",
    "op6_substring_dedup": "substrings",
    "op7_retrieval_packing": "packing",
    "op8_ngram_scores": "ngramlm",
    "op9_quality": "quality",
    "op10_nearest_neighbours": "ann",
    "op11_interval_overlaps": "intervals",
    "op12_piece_encoding": "pieces",
    "op13_token_alignment": "alignment",
}


def _of(module: str) -> Callable[[SparkSession, str], DataFrame]:
    return import_module(f"loamwork.llm.{module}").query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _of(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"loamwork.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
