"""Sinks and readers of result rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.plans.catalogue import RESULTS_CSV

FIELDS = ("code", "value", "unit", "confidence", "source")


def flat(results: DataFrame) -> DataFrame:
    """Result rows with the sources as text, in the order of the catalogue."""
    return results.select("doc_id", "ord", "code", "value", "unit", "confidence", F.concat_ws(",", "source").alias("source"))


def write_csv(results: DataFrame, path: str) -> None:
    """A folder of CSV files a report (doc_id=...), with a header and without the status; nulls are empty fields."""
    rows = flat(results).select("doc_id", *FIELDS)
    rows.repartition("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").partitionBy("doc_id").option("header", True).option("emptyValue", "").csv(path)


def write_csv_flat(results: DataFrame, path: str) -> None:
    """One CSV data set with the report as a column: for many reports, where a folder each is too much."""
    flat(results).select("doc_id", *FIELDS).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What either of the writers wrote, with an explicit schema; an empty source is null."""
    return spark.read.schema("doc_id string, " + RESULTS_CSV).option("header", True).csv(path)


def read_csv_by_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, " + RESULTS_CSV).option("header", True).csv(path).select("doc_id", *FIELDS)


def as_json(results: DataFrame) -> DataFrame:
    """doc_id and a JSON text: the report's path and its indicators, without status."""
    item = F.struct("ord", *FIELDS)
    rows = results.select("doc_id", "ord", "code", "value", "unit", "confidence", "source")
    grouped = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("kpis"))
    items = F.transform("kpis", lambda k: F.struct(*[k[f].alias(f) for f in FIELDS]))
    return grouped.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("pdf_path"), items.alias("kpis")), {"ignoreNullFields": "false"}).alias("json"))


def write_json(results: DataFrame, path: str) -> None:
    as_json(results).select("json").write.mode("overwrite").text(path)


def console(results: DataFrame) -> DataFrame:
    """Lines of fixed width: code, value, unit, confidence, source, status."""
    text = F.format_string("%-24s %18s %-8s %5s %-14s %s", "code", F.when(F.col("value").isNull(), "None").otherwise(F.format_string("%.3f", "value")), F.coalesce("unit", F.lit("None")), F.format_number("confidence", 2), F.concat_ws(",", "source"), "status")
    return results.select("doc_id", "ord", text.alias("line"))
