"""Digits and decimals of numbers, held against Python's shortest texts."""

from decimal import Decimal

import pytest

from tallyglass.operators import schema

VALUES = [0.0, -0.0, 1.0, 100.0, 10.5, -0.25, 0.001, 1e-3, 1.5e-15, 1e30, 123456789.125, 1e7, 12345678.9, 9.999e22, 1.7976931348623157e308, float("nan"), float("inf"), None]


def shape(x):
    sign, digits, last = Decimal(repr(abs(x))).normalize().as_tuple()
    kept = "".join(map(str, digits)).lstrip("0")
    last = last if kept else 0
    return max(len(kept) + max(last, 0), -last + (1 if len(kept) + last <= 0 else 0), 1), max(-last, 0)


@pytest.mark.parametrize("value", VALUES)
def test_digits_of_one_number(spark, value):
    row = schema.precision_scale(spark.createDataFrame([(value,)], "x double")).first()
    known = value is not None and value == value and abs(value) != float("inf")
    assert (row["precision"], row["scale"]) == (shape(value) if known else (None, None))


def test_columns_of_all_kinds_together(spark):
    rows = [(2 ** 63 - 1, -3, Decimal("0E-10"), 0.5), (-2 ** 63, None, Decimal("12.3400000000"), None)]
    df = spark.createDataFrame(rows, "a long, b int, c decimal(20,10), d float")
    found = {r["column"]: (r["precision"], r["scale"]) for r in schema.precision_scale(df, ["d", "a", "c", "b"]).collect()}
    assert found == {"a": (19, 0), "b": (1, 0), "c": (4, 2), "d": (2, 1)}


def test_a_number_becomes_text_once_and_no_pattern_is_used(spark):
    df = spark.range(3).selectExpr("CAST(id AS DOUBLE) / 4 AS x")
    plan = schema.precision_scale(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and plan.count("as string") == 1
