"""From reports to result rows.

Reports are rows (doc_id, text, tables): the text with its line breaks, and the
tables as arrays of rows of cells, the first a header. One scan gives all hits
of a report and picks the best of them; one shuffle, by report, compares those
of rows with the same id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import collapse
from reportlake.operators import fuse, hits
from reportlake.plans.catalogue import DEFAULT, Kpi
from reportlake.sources.storage import stored


@dataclass(frozen=True)
class Extractor:
    """A source of hits, which carry its name: an expression over text, flat text and tables. More can be registered beside these."""

    name: str
    of: Callable[[tuple[Kpi, ...]], Column]


EXTRACTORS = (
    Extractor("table_grid", lambda kpis: hits.cell_hits(F.col("tables"), kpis)),
    Extractor("table_plain", lambda kpis: hits.line_hits(F.col("text"), kpis)),
    Extractor("regex", lambda kpis: hits.pattern_hits(F.col("flat"), kpis)),
    Extractor("nlp", lambda kpis: hits.sentence_hits(F.col("flat"), kpis)),
)


def prepared(reports: DataFrame) -> DataFrame:
    """Reports with the flat text; nulls read as empty."""
    text = F.coalesce("text", F.lit(""))
    return reports.select("doc_id", text.alias("text"), F.coalesce("tables", F.array().cast("array<array<array<string>>>")).alias("tables"), collapse(text).alias("flat"))


def raw_hits(reports: DataFrame, kpis: tuple[Kpi, ...] = DEFAULT, extractors: tuple[Extractor, ...] = EXTRACTORS) -> DataFrame:
    """doc_id and the hits of the extractors, one row each."""
    return hits.rows(prepared(reports), F.concat(*[e.of(kpis) for e in extractors]))


def chosen(reports: DataFrame, kpis: tuple[Kpi, ...] = DEFAULT, extractors: tuple[Extractor, ...] = EXTRACTORS) -> DataFrame:
    """The best hit of each report and indicator, with its score; without a source where there is none."""
    return fuse.best_by_report(prepared(reports).select("doc_id", *[e.of(kpis).alias(e.name) for e in extractors]), kpis)


def extract_kpis(reports: DataFrame, kpis: tuple[Kpi, ...] = DEFAULT, *, llm: fuse.Client | None = None, extractors: tuple[Extractor, ...] = EXTRACTORS) -> DataFrame:
    """One row for each report and indicator.

    A language model is asked only where a client is passed, once a report that
    misses something, and for what it misses. Results and answers are stored
    then, so that no action extracts or asks again; the reports are read twice.
    """
    results = fuse.shaped(chosen(reports, kpis, extractors))
    if llm is None:
        return results
    results = stored(results, "results")
    answers = stored(fuse.ask(reports.join(fuse.open_codes(results), "doc_id"), llm, kpis), "answers")
    return fuse.backfill(results, fuse.answered(answers, kpis))
