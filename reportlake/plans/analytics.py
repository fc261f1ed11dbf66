"""Summaries of result rows (doc_id, code, value, unit, confidence, source as text)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 10


def completeness(results: DataFrame) -> DataFrame:
    """Values found in each report."""
    return results.groupBy("doc_id").agg(F.count("value").alias("kpis_found"), F.count(F.lit(1)).alias("kpis"))


def source_usage(results: DataFrame) -> DataFrame:
    source = F.when(F.coalesce("source", F.lit("")) == "", "none").otherwise(F.col("source"))
    return results.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(results: DataFrame, bins: int = BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest confidence; the last holds its upper end. Bins without rows are left out."""
    counts = results.groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
    # n is read on both sides, so that they are one plan and the results are made once
    pair = F.when(F.col("confidence").isNotNull(), F.struct("confidence", "n"))
    ends = counts.agg(F.min(pair)["confidence"].alias("lo"), F.max(pair)["confidence"].alias("hi"))
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.width_bucket("confidence", "lo", "hi", F.lit(bins)), F.lit(bins)))
    return counts.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))  # one row of ends


def summary(results: DataFrame) -> DataFrame:
    lost = F.when(F.col("value").isNull(), 1.0).otherwise(0.0)
    return results.agg(
        F.countDistinct("doc_id").alias("files"),
        F.count(F.lit(1)).alias("results"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
        F.sum(lost).cast("long").alias("missing_values"),
        F.round(F.avg(lost) * 100, 2).alias("pct_missing"),
    )


def confidence_by_kpi(results: DataFrame) -> DataFrame:
    return results.groupBy("code").agg(F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count("value").alias("found"))


def head(results: DataFrame, n: int = 5) -> DataFrame:
    return results.orderBy("doc_id", "code").limit(n)
