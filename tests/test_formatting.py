"""Display texts against Python's format specs (the reference's helpers)."""

import pytest

from tillroll.functions.formatting import fmt_currency, fmt_number, fmt_percent


def py_currency(v, symbol="£"):
    if v is None:
        return f"{symbol}0"
    if abs(v) >= 1_000_000:
        return f"{symbol}{v / 1_000_000:,.2f}M"
    if abs(v) >= 1_000:
        return f"{symbol}{v / 1_000:,.1f}K"
    return f"{symbol}{v:,.0f}"


def py_number(v):
    return py_currency(v, "")


def py_percent(v, decimals=1):
    if v is None:
        return "0%"
    return f"{v * 100:.{decimals}f}%"


VALUES = [None, 0.0, 0.4, 0.5, 1.5, 2.5, 12.5, 999.4, 999.5, 1000.0, 1234.56, 99_949.0, 99_951.0,
          123_456.0, 999_999.0, 1_000_000.0, 2_319_410_000.0, -1234.0, -12.5, 45_678_901.25]


@pytest.mark.parametrize("fn,ref", [(fmt_currency, py_currency), (fmt_number, py_number)])
def test_banded_texts(spark, fn, ref):
    df = spark.createDataFrame([(v,) for v in VALUES], "v DOUBLE")
    got = [r[0] for r in df.select(fn("v")).collect()]
    assert got == [ref(v) for v in VALUES]


def test_percent_texts(spark):
    vals = [None, 0.0, 0.123, 0.5, 0.69834, 1.0, 0.0005, 0.00049]
    df = spark.createDataFrame([(v,) for v in vals], "v DOUBLE")
    got = [r[0] for r in df.select(fmt_percent("v")).collect()]
    assert got == [py_percent(v) for v in vals]
