"""Training-corpus pipeline: quality filter, near-duplicate removal, substring dedup, benchmark decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder and reads
again as the next stage's docs. All but the last stage return the columns of documents.

- quality: rows that the classifier rejects go (it learns from the labelled documents of this input).
- near_duplicates: of each class of near-duplicates the row with the smallest (doc_id, hash of the text) stays; null doc_ids come last.
- substring_dedup: words covered by passages that stand earlier in the corpus go; n_chars follows the text. Texts that lose nothing keep their white
  space; documents of which nothing is left go.
- decontamination: rows in which a test item occurs, or near which one comes, go.
- packing: all that is left is tokenized and packed.

Every row is judged by itself. Defined results: a null text counts as an empty one and stays null where its row is kept; rows with a null doc_id are judged
like others (the substring stage keeps them whole); rows that repeat a doc_id with other texts are other documents; rows that repeat both doc_id and text
leave the near-duplicate stage once; an empty table gives no rows; further columns are kept up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork import session
from loamwork.llm import decontam, neardup, packing, quality, substrings

#: SQL can express neither the classifier nor the sampling.
ORACLE_SQL = None
TOKENIZER = "word_bpe_49k.json"


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdict = quality.classify(docs, session.table(spark, sf_dir, "labels"), carry=True)
    return verdict.where("predicted = 1").select("row.*")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs).where("first")
    name = lambda text_hash, doc_id: F.concat_ws("/", text_hash, F.coalesce(doc_id.cast("string"), F.lit("null")))
    kept = found.select(name(F.lower(F.hex("text_hash")), F.col("doc_id")).alias("kept")).distinct()
    named = docs.withColumn("__name", name(F.md5(F.coalesce(docs["text"], F.lit(""))), docs["doc_id"]))
    return named.join(kept, named["__name"] == kept["kept"], "left_semi").dropDuplicates(["__name"]).drop("__name")


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substrings.dedup(docs, carry=True)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)}
    return cut.where(~changed | (F.col("kept") != "")).select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontam.contamination(docs, session.table(spark, sf_dir, "benchmark")).where("n_hit > 0 or size(near_items) > 0")
    found = session.written(found.select("text_hash").distinct(), "contaminated-texts")
    return docs.join(found, F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))) == found["text_hash"], "left_anti")


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", stage_quality),
    ("near_duplicates", stage_near_duplicates),
    ("substring_dedup", stage_substrings),
    ("decontamination", stage_decontamination),
    ("packing", stage_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed corpus."""
    docs = session.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = session.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        session.let_go(spark)
    return docs
