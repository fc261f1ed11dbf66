"""The score of a candidate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.text import let
from reportlake.plans.catalogue import SOURCES


def weight(source: Column) -> Column:
    out = F
    for name, (w, _, _) in SOURCES.items():
        out = out.when(source == name, w)
    return out.otherwise(1.0)


def priority(source: Column) -> Column:
    out = F
    for name, (_, p, _) in SOURCES.items():
        out = out.when(source == name, p)
    return out.otherwise(-1)


def unit_quality(unit: Column, allowed: Column) -> Column:
    has = unit.isNotNull() & (unit != "")
    return F.when(has & (F.size(allowed) > 0), F.when(F.array_contains(allowed, unit), 1.0).otherwise(0.0)).when(has, 0.7).otherwise(0.0)


def quality_among(unit: Column, allowed: tuple[str, ...]) -> Column:
    """The same for units known when the plan is made."""
    none = F.when(unit.isNull() | (unit == ""), 0.0)
    for u in allowed:
        none = none.when(unit == u, 1.0)
    return none.otherwise(0.0 if allowed else 0.7)


def total(value: Column, uq: Column, confidence: Column, source: Column) -> Column:
    vq = F.when(value.isNotNull(), 1.0).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * (F.lit(0.7) * vq + F.lit(0.3) * uq) * weight(source)))


def score(value: Column, unit: Column, allowed: Column, confidence: Column, source: Column) -> Column:
    """value_quality, unit_quality, source_weight, base_confidence and score, within 0 and 1."""
    vq = F.when(value.isNotNull(), 1.0).otherwise(0.0)
    return let(unit_quality(unit, allowed), lambda uq: F.struct(vq.alias("value_quality"), uq.alias("unit_quality"), weight(source).alias("source_weight"), confidence.alias("base_confidence"), total(value, uq, confidence, source).alias("score")))
