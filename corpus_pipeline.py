"""The corpus pipeline: quality, lines, near-duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of `documents`. run() writes each
stage's result to the cluster's shared folder and reads it again as the next
one's documents, so a lost executor costs a stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import decontaminate, lines, minhash, packing, quality
from reportlake.llm.common import drop_since, save, saved, table
from reportlake.llm.queries import fold, tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from labelled documents outside the held-out fold."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda k: fold(k, 5) != 0)
    return quality.keep_good(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from all of its documents; n_chars follows the text."""
    cleaned = lines.clean(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("__n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return minhash.keep_one(docs)


def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in windows of 4096 ids."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_duplicates", duplicate_stage),
    ("contamination", contamination_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), saved()
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        drop_since(spark, before, docs)  # what no later stage reads
    return docs
