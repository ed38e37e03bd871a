"""A corpus pipeline over ``documents`` in five stages, each of which calls one operator of ``sparkscope.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.

1. quality: documents that the quality classifier rejects (toxic or of low quality) go.
2. near_duplicates: one document of each group of near-duplicates stays, the one with the smallest doc_id; texts link
   at a similarity of 0.80 (op6: 0.85).
3. decontamination: documents that hold a window of a benchmark item go.
4. secrets: each secret is masked in the text, and n_chars is counted anew where that changed it.
5. tokens: the text's piece ids (token_ids) are added, with n_tokens and the text that decoding them gives (decoded);
   columns of the input that have one of these three names are replaced.

All stages but the last keep every column's values, whatever the columns are called, but for text and n_chars where a
secret was masked. Null texts count as empty and stay null. Of repeated rows, rows of one doc_id are one document to the
second stage: they stay or go together. Null ids are documents of their own there. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm import common, near_duplicates, phrase_index, quality, secrets, unigram
from sparkscope.llm.vocabulary import default_path

ORACLE_SQL = None
#: Similarity, in percent, from which the stage links texts.
NEAR = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    p = common.free_prefix(docs)
    aside = {c: f"{p}{i}" for i, c in enumerate(docs.columns) if c.lower() == "_quality"}
    scored = quality.classify(docs.withColumnsRenamed(aside), common.table(spark, sf_dir, "labels"))
    return scored.filter("_quality.kept").drop("_quality").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(docs, percent=NEAR)
    gone = common.materialise(found.filter("component_id <> doc_id").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrase_index.clean(docs, common.table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    before = f"{common.free_prefix(docs)}before"
    clean = secrets.redact(docs.withColumn(before, F.length("text")))
    n_chars = F.when(F.length("text") != F.col(before), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = unigram.encode(docs, default_path(), decoded_col="decoded")
    return coded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("tokens", tokens_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
