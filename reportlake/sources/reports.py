"""Readers that give reports (doc_id, name, text, tables, error).

A report's id is its whole path, so files of one name in several folders stay
apart; its name is the file's, without folder and ending. Each reader opens a
file once and isolates its failures: an unreadable report has empty text, no
tables, and the error. PDF needs the optional pdfplumber.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id string, name string, text string, tables array<array<array<string>>>, error string"
ROW = "doc_id string, name string, text string, tables array<array<array<string>>>, broken string"


def _files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Paths, names and contents of files; the paths as they are on disk, not encoded as in a URL."""
    reader = spark.read.format("binaryFile")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return found.select(F.col("path").alias("doc_id"), name_of(F.col("path")).alias("name"), "content")


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_pdf(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """All pages of PDF files: text by pages with a blank line between, and their tables."""
    files = _files(spark, path, "*.pdf")
    return (files.repartition(partitions) if partitions else files).mapInPandas(parse_pdf, SCHEMA)


def parse_pdf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(doc_id, name, *pdf_content(content)) for doc_id, name, content in zip(frame["doc_id"], frame["name"], frame["content"])]
        yield pd.DataFrame(rows, columns=["doc_id", "name", "text", "tables", "error"])


def pdf_content(content: bytes) -> tuple[str, list, str | None]:
    """Text, tables and error of a PDF file. A page without readable text leaves the others; tables that fail leave the text."""
    try:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(content)) as pdf:
            pages, failed = [], None
            for page in pdf.pages:
                try:
                    pages.append(page.extract_text() or "")
                except Exception as e:
                    pages.append("")
                    failed = f"page: {e}"
            try:
                tables = [t for page in pdf.pages for t in page.extract_tables() or [] if t]
            except Exception as e:
                tables, failed = [], f"tables: {e}"
        return "\n\n".join(pages), tables, failed
    except Exception as e:
        return "", [], f"{type(e).__name__}: {e}"


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Text files in UTF-8, one report each; their tables are lines only."""
    whole = F.col("content").cast("string")
    good = F.is_valid_utf8(whole)
    text = F.when(good, F.regexp_replace(whole, "^\ufeff", "")).otherwise("")
    return _files(spark, path).select("doc_id", "name", text.alias("text"), F.array().cast("array<array<array<string>>>").alias("tables"), F.when(~good, "not UTF-8").alias("error"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or JSON lines with doc_id, text and optionally tables. A line that is no such object keeps its place, with an error and without an id."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        df = spark.read.schema(ROW).option("columnNameOfCorruptRecord", "broken").json(path)
    else:
        df = spark.read.parquet(path)
    tables = F.col("tables").cast("array<array<array<string>>>") if "tables" in df.columns else F.array().cast("array<array<array<string>>>")
    error = F.when(F.col("broken").isNotNull(), F.concat(F.lit("not a report: "), F.substring("broken", 1, 200))) if "broken" in df.columns else F.lit(None).cast("string")
    key = F.col("doc_id").cast("string")
    return df.select(key.alias("doc_id"), name_of(key).alias("name"), F.col("text").cast("string").alias("text"), tables.alias("tables"), error.alias("error"))
