import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportlake.functions.numbers import locale_number, scaled_number, with_numbers

CASES = [
    ("123,400", 123400.0, 123400.0),
    ("123.400", 123400.0, 123400.0),
    ("123 400", 123400.0, 123400.0),
    ("1.200.000", 1200000.0, 1200000.0),
    ("1200000.", 1200000.0, 1200000.0),
    ("1 200 000.0", 1200000.0, 1200000.0),
    ("1 200 000.0", 1200000.0, 1200000.0),
    ("1 200 000", 1200000.0, 1200000.0),
    ("3 1,200,000", 31200000.0, 31200000.0),
    ("5d", None, None),
    ("123,45", 123.45, 123.45),
    ("0.123", 123.0, 123.0),
    ("1 200,000", 1200.0, 1200.0),
    ("12 34", 1234.0, 1234.0),
    ("500,000,", 500000.0, 500000.0),
    ("1,234.56", 123456.0, 123456.0),
    ("-12.5", -125.0, -125.0),
    ("2024 123,400", 2024123.4, 2024123.4),
    ("1.2 million", None, 1200000.0),
    ("1.234 million", None, 1234000000.0),
    ("2 billion", None, 2000000000.0),
    ("120k", None, 120000.0),
    ("N/A", None, None),
    ("", None, None),
    (None, None, None),
    ("...", None, None),
    ("1_000", 1000.0, 1000.0),
    ("1e3", 1000.0, 1000.0),
]


def test_table(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, raw string")
    got = df.select("i", locale_number(F.col("raw")).alias("a"), scaled_number(F.col("raw")).alias("b")).orderBy("i").collect()
    assert [(CASES[r.i][0], r.a, r.b) for r in got] == CASES


@pytest.mark.parametrize("scaled,at", [(False, 1), (True, 2)])
def test_steps_give_what_expressions_give(spark, scaled, at):
    df = spark.createDataFrame([(c[0], c[at]) for c in CASES], "raw string, want double")
    got = with_numbers(df, "raw", F.lit(scaled), "number").collect()
    assert [r.number for r in got] == [r.want for r in got]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=20))
def test_grouped_whole_numbers_read_back(spark, numbers):
    df = spark.createDataFrame([(f"{n:,}".replace(",", sep), float(n)) for n in numbers for sep in (",", ".", " ")], "raw string, want double")
    assert df.where(~locale_number(F.col("raw")).eqNullSafe(F.col("want"))).count() == 0
