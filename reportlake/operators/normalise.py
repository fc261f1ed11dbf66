"""From raw hits to candidates: value, unit and score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions import units
from reportlake.functions.numbers import locale_number, scaled_number
from reportlake.functions.scores import score
from reportlake.functions.text import let, unit_token, unit_token_wide
from reportlake.plans.catalogue import SOURCES, Kpi, by_code, strings

SCALED = ("regex", "nlp", "llm")


def matched(raw: Column, k: Kpi, wide: bool = False) -> Column:
    """The indicator's unit that reads the same; its only one where nothing does."""
    norm = unit_token_wide if wide else unit_token
    same = F.when(raw != "", let(norm(raw), lambda token: units.same_unit(token, k.units, wide)))
    return F.coalesce(same, F.lit(k.units[0])) if len(k.units) == 1 else same


def _of(source: str, k: Kpi, h: Column, x: Column) -> Column:
    """value and unit of a source's hit for an indicator, from its number: chosen when the plan is made, not by row."""
    raw, canonical = h["raw_unit"], F.lit(k.units[0] if k.units else None).cast("string")
    value = x
    if source == "regex":
        value = x * units.factor(raw, k.units[0]) if k.units else x
        unit = canonical if k.units else F.when(x.isNotNull(), raw)
    elif source == "table_grid":
        reported = F.when(h["reported_unit"].isin(*k.units), h["reported_unit"]) if k.units else F.lit(None).cast("string")
        unit = F.coalesce(reported, matched(raw, k), F.when(x.isNotNull(), canonical))
    else:
        unit = matched(raw, k, wide=source == "table_plain")
    return F.struct(value.alias("value"), unit.alias("unit"))


def valued(source: str, h: Column, kpis: tuple[Kpi, ...], of) -> Column:
    """of(value and unit) of a source's hit.

    Only hits of unit patterns are converted to the canonical unit, whatever
    unit they name; the others keep the allowed unit that reads the same.
    """
    number = scaled_number(h["raw_value"]) if source in SCALED else locale_number(h["raw_value"])
    each = lambda x: F.coalesce(by_code(kpis, h["code"], lambda k: _of(source, k, h, x)), _of(source, Kpi(""), h, x)) if kpis else _of(source, Kpi(""), h, x)
    return let(let(number, each), of)


def by_source(source: Column, of) -> Column:
    """of(name) for the source's name; "" for an unknown one."""
    out = F
    for name in SOURCES:
        out = out.when(source == name, of(name))
    return out.otherwise(of(""))


def candidates(hits: DataFrame, kpis: tuple[Kpi, ...]) -> DataFrame:
    """hits (as columns of HIT) with value, unit, unit_known and score."""
    names = ("code", "source", "raw_value", "raw_unit", "reported_unit", "confidence")
    allowed = by_code(kpis, F.col("code"), lambda k: strings(k.units)).otherwise(strings(()))
    canonical = by_code(kpis, F.col("code"), lambda k: F.lit(k.units[0] if k.units else None).cast("string"))
    df = hits.withColumn("__v", let(F.struct(*names), lambda h: by_source(h["source"], lambda s: valued(s, h, kpis, lambda v: v)))).withColumn("__allowed", allowed)
    known = F.when(F.col("source") == "regex", units.known(F.col("raw_unit"), canonical)).otherwise(F.lit(True))
    of = score(F.col("__v.value"), F.col("__v.unit"), F.col("__allowed"), F.col("confidence"), F.col("source"))
    return df.select(*hits.columns, F.col("__v.value").alias("value"), F.col("__v.unit").alias("unit"), known.alias("unit_known"), of.alias("score"))
