"""Selection of one candidate for each report and indicator, completion and back-fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportlake.functions.scores import priority, quality_among, total
from reportlake.functions.text import unfenced
from reportlake.operators.normalise import candidates, valued
from reportlake.plans.catalogue import NOT_REPORTED, SOURCES, Kpi

CHOSEN = ("value", "unit", "confidence", "source", "score")


def best(cands: DataFrame) -> DataFrame:
    """The candidate of each (doc_id, ord, code) with the highest score, then priority."""
    rank = F.struct(F.when(F.col("source").isNull(), -1.0).otherwise(F.coalesce(F.col("score.score"), F.lit(0.0))), priority(F.col("source")))
    picked = cands.groupBy("doc_id", "ord", "code").agg(F.max_by(F.struct(*CHOSEN), rank).alias("b"))
    return picked.select("doc_id", "ord", "code", *[F.col(f"b.{c}").alias(c) for c in CHOSEN])


def best_by_window(cands: DataFrame) -> DataFrame:
    """The same by a window; for cross-checks."""
    w = Window.partitionBy("doc_id", "code").orderBy(F.coalesce(F.col("score.score"), F.lit(0.0)).desc(), priority(F.col("source")).desc())
    return cands.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("doc_id", "ord", "code", *CHOSEN)


BEST = "struct<rank:struct<score:double,priority:int>,value:double,unit:string,confidence:double,source:string>"


def best_of(name: str, hits: Column, k: Kpi) -> Column:
    """The best of an extractor's hits for an indicator, as BEST, from an array of hits that carry the extractor's name; null where there is none."""
    source = F.lit(name)

    def best(h: Column) -> Column:
        def of(v: Column) -> Column:
            rank = F.struct(F.coalesce(total(v["value"], quality_among(v["unit"], k.units), h["confidence"], source), F.lit(0.0)).alias("score"), priority(source).alias("priority"))
            return F.struct(rank.alias("rank"), v["value"].alias("value"), v["unit"].alias("unit"), h["confidence"].alias("confidence"), source.alias("source")).cast(BEST)

        return valued(name, h, (k,), of)

    return F.array_max(F.transform(F.filter(hits, lambda h: h["code"] == k.code), best))


def best_by_report(hits: DataFrame, kpis: tuple[Kpi, ...]) -> DataFrame:
    """doc_id, ord, code, value, unit, confidence, source and score: a row for every report and indicator.

    hits: doc_id and, by the name of each extractor, an array of its hits in
    the report. The best hit is chosen within the report, so one narrow row of
    each is sorted and shuffled, not all its hits; rows of one doc_id are then
    compared alike. Where nothing was found, source is null: completion without
    a join or a second scan.
    """
    if not kpis:
        return hits.where("false").select("doc_id", F.inline(F.array().cast("array<struct<ord:int,code:string,value:double,unit:string,confidence:double,source:string,score:double>>")))
    names = [c for c in hits.columns if c != "doc_id"]
    none = F.lit(None).cast(BEST)
    each = hits.select("doc_id", *[F.greatest(none, none, *[best_of(n, F.col(n), k) for n in names]).alias(f"b{i}") for i, k in enumerate(kpis)])
    merged = each.groupBy("doc_id").agg(*[F.max(f"b{i}").alias(f"b{i}") for i, _ in enumerate(kpis)])
    fields = ("value", "unit", "confidence", "source")
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(k.code).alias("code"), *[F.col(f"b{i}.{c}").alias(c) for c in fields], F.col(f"b{i}.rank.score").alias("score")) for i, k in enumerate(kpis)]
    return merged.select("doc_id", F.inline(F.array(*rows)))


def complete(chosen: DataFrame, docs: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every report with every indicator; for cross-checks of best_by_report."""
    every = docs.select("doc_id").crossJoin(F.broadcast(dimension.select("ord", "code")))
    return every.join(chosen, ["doc_id", "ord", "code"], "left")


def shaped(chosen: DataFrame) -> DataFrame:
    """Result rows: doc_id, ord, code, value, unit, confidence, source, status, reported."""
    none = F.array().cast("array<string>")
    return chosen.select(
        "doc_id",
        "ord",
        "code",
        "value",
        F.when(F.col("source").isNotNull(), F.col("unit")).alias("unit"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(F.col("source").isNull(), none).otherwise(F.array("source")).alias("source"),
        F.lit(NOT_REPORTED).alias("status"),
        F.col("value").isNotNull().alias("reported"),
    )


def missing(results: DataFrame) -> DataFrame:
    return results.where(F.col("value").isNull())


Client = Callable[[list[dict]], str | None]


def prompt(kpis: list[Kpi]) -> str:
    """What a model is asked for: these indicators and no others."""
    asked = "\n".join(f"- {k.code}" + (f", in {k.units[0]}" if k.units else "") for k in kpis)
    shape = ", ".join(f'"{k.code}": {{"raw_value": ..., "raw_unit": ...}}' for k in kpis)
    return f"""Find these figures in the report that follows:
{asked}
Take the first place that states a figure. Copy its number and its unit letter by letter, without converting them; both are text.
What the report does not state is null in both fields. Answer with this JSON object and nothing else: {{{shape}}}"""


def ask(docs: DataFrame, client: Client, kpis: tuple[Kpi, ...], *, tries: int = 2) -> DataFrame:
    """doc_id and content: a client's answer to each report's text and missing indicators (codes); an error is no answer.

    The client is shipped to the executors and called once a report, and again
    after an error, `tries` times in all. Reports without text are not asked about.
    """
    known = {k.code: k for k in kpis}

    @F.pandas_udf("string")
    def answer(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, codes in parts:
            answers = []
            for text, missing_ in zip(texts, codes):
                content = None
                if isinstance(text, str) and text and len(missing_):
                    messages = [{"role": "system", "content": prompt([known[c] for c in missing_])}, {"role": "user", "content": text}]
                    for _ in range(tries):
                        try:
                            content = client(messages)
                            break
                        except Exception:  # one failed call must not cost the others
                            continue
                answers.append(content)
            yield pd.Series(answers, dtype=object)

    return docs.select("doc_id", answer.asNondeterministic()("text", "codes").alias("content"))


def open_codes(results: DataFrame) -> DataFrame:
    """doc_id and codes: the indicators that each report misses, in the order of the catalogue; no row for others."""
    each = missing(results).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "code"))).alias("open"))
    return each.select("doc_id", F.col("open.code").alias("codes"))


def answered(responses: DataFrame, kpis: tuple[Kpi, ...]) -> DataFrame:
    """Candidates from answers in JSON, {code: {raw_value, raw_unit}}; what cannot be read is left out, indicator by indicator."""
    fields = ", ".join(f"`{k.code}` string" for k in kpis)
    read = responses.select("doc_id", F.from_json(unfenced(F.col("content")), fields).alias("j"))
    one = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k.code).alias("code"), F.from_json(F.col("j")[k.code], "raw_value string, raw_unit string").alias("h")) for i, k in enumerate(kpis)])
    rows = read.where("j is not null").select("doc_id", F.inline(one)).where("h.raw_value is not null")
    hits = rows.select("doc_id", "ord", "code", F.lit("llm").alias("source"), F.col("h.raw_value").alias("raw_value"), F.col("h.raw_unit").alias("raw_unit"), F.lit(None).cast("string").alias("reported_unit"), F.lit(SOURCES["llm"][2]).alias("confidence"))
    return candidates(hits, kpis)


def backfill(results: DataFrame, answers: DataFrame) -> DataFrame:
    """Results whose missing values are replaced by answers, even by those without a readable value."""
    new = answers.select("doc_id", "code", F.struct("value", "unit", "confidence").alias("a"))
    joined = results.join(new, ["doc_id", "code"], "left")
    use = F.col("value").isNull() & F.col("a").isNotNull()
    return joined.select(
        "doc_id",
        "ord",
        "code",
        *[F.when(use, F.col(f"a.{c}")).otherwise(F.col(c)).alias(c) for c in ("value", "unit", "confidence")],
        F.when(use, F.array(F.lit("llm"))).otherwise(F.col("source")).alias("source"),
        "status",
        F.when(use, F.col("a.value").isNotNull()).otherwise(F.col("reported")).alias("reported"),
    )
