"""Units of hits: conversion to the canonical unit, and matching among the allowed ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportlake.functions.text import first, let, unit_token, unit_token_wide
from reportlake.plans.catalogue import CONVERSIONS


def factor(raw_unit: Column, canonical: str | Column) -> Column:
    """What a value in raw_unit is multiplied by; 1 for a unit that is not known for this canonical one."""

    def of(token: Column) -> Column:
        out = F.when(token == unit_token_wide(F.lit(canonical)), 1.0)
        for t, c, f in CONVERSIONS:
            if not isinstance(canonical, str):
                out = out.when((token == t) & (canonical == c), f)
            elif canonical == c:
                out = out.when(token == t, f)
        return out.otherwise(1.0)

    return F.when(raw_unit.isNull() | (raw_unit == "") | F.isnull(F.lit(canonical)), 1.0).otherwise(let(unit_token_wide(raw_unit), of))


def known(raw_unit: Column, canonical: Column) -> Column:
    """Whether the unit is the canonical one or convertible; others are relabelled silently."""

    def of(token: Column) -> Column:
        pairs = F.lit(False)
        for t, c, _ in CONVERSIONS:
            pairs = pairs | ((token == t) & (canonical == c))
        return (token == unit_token_wide(canonical)) | pairs

    return let(unit_token_wide(raw_unit), of)


def same_unit(token: Column, units: tuple[str, ...], wide: bool = False) -> Column:
    """The first of the units that reads as the token."""
    norm, out = unit_token_wide if wide else unit_token, F
    for u in units:
        out = out.when(token == norm(F.lit(u)), u)
    return out.otherwise(F.lit(None).cast("string")) if units else F.lit(None).cast("string")


def match(raw_unit: Column, allowed: Column, wide: bool = False) -> Column:
    """The first allowed unit that reads the same; the only one where nothing does."""
    norm = unit_token_wide if wide else unit_token
    found = F.when(raw_unit != "", let(norm(raw_unit), lambda t: first(allowed, lambda u: norm(u) == t)))
    return F.coalesce(found, F.when(F.size(allowed) == 1, F.get(allowed, F.lit(0))))
