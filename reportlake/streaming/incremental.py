"""Extraction from a stream of reports.

Indicators of a report depend on that report alone, so each micro-batch is
extracted by the batch plan and no state is kept between batches. Batches are
written under their number: one that is repeated after a failure replaces
itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportlake.plans.catalogue import DEFAULT, Kpi
from reportlake.plans.pipeline import extract_kpis
from reportlake.sources.results import flat

REPORT = "doc_id string, text string, tables array<array<array<string>>>"


def read_stream(spark: SparkSession, path: str, *, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(REPORT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start(reports: DataFrame, out: str, checkpoint: str, kpis: tuple[Kpi, ...] = DEFAULT, *, once: bool = True):
    """A query that appends result rows below `out`; with `once` it ends when nothing is left."""

    def write(batch: DataFrame, number: int) -> None:
        flat(extract_kpis(batch, kpis)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
