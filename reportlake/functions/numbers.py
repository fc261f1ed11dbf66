"""Numbers as reports write them: local separators, spaces, and words for scale.

What a step gives is bound to a name (`let`), so that each is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportlake.functions.text import contains_any, let, strip, swap

GROUPED = r"^\d{1,3}([.,]\d{3})+$"
WHOLE = r"^\d+$"
ONE_MARK = r"^\d+[.,]\d+$"
FLOAT = r"(?i)^[+-]?(\d+(_\d+)*(e[+-]?\d+)?|inf|infinity|nan)$"
SCALE_WORDS = "million|billion|thousand|k"


def tidy(x: Column) -> Column:
    """Plain spaces for fixed-width ones, no space around, no stops behind."""
    return F.rtrim(swap(strip(x), "\u00a0\u2007\u202f", " "), F.lit("."))


def decide(s: Column) -> Column:
    """The value of a tidy number: groups of three are thousands, a lone mark is decimal, else marks are dropped."""
    def of(t: Column) -> Column:
        return (
            F.when(t.rlike(GROUPED), swap(t, ".,", "").try_cast("double"))
            .when(t.rlike(WHOLE), t.try_cast("double"))
            .when(t.rlike(ONE_MARK), swap(t, ",", ".").try_cast("double"))
            .otherwise(let(swap(t, ".,", ""), lambda c: F.when(c.rlike(FLOAT), swap(c, "_", "").try_cast("double"))))
        )

    return let(swap(s, " ", ""), of)


def locale_number(x: Column) -> Column:
    return let(tidy(x), decide)


def scale(low: Column) -> Column:
    return F.when(F.contains(low, F.lit("million")), 1e6).when(F.contains(low, F.lit("billion")), 1e9).when(F.contains(low, F.lit("thousand")), 1e3).when(F.endswith(low, F.lit("k")), 1e3).otherwise(1.0)


def unscaled(low: Column) -> Column:
    return F.when(contains_any(low, SCALE_WORDS.split("|")), F.regexp_replace(low, SCALE_WORDS, "")).otherwise(low)


def scaled_number(x: Column) -> Column:
    return let(F.lower(strip(x)), lambda low: locale_number(unscaled(low)) * scale(low))


def with_numbers(df: DataFrame, raw: str, scaled: Column, out: str) -> DataFrame:
    """df with the number in `raw`; scale words count where `scaled` holds."""
    return df.withColumn(out, F.when(scaled, scaled_number(F.col(raw))).otherwise(locale_number(F.col(raw))))
