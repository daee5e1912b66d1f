"""Display text for KPI values (F15-F17) as Column expressions.

Values are first rounded the way Python's format spec rounds (the exact
binary value, exact ties to even: 12.5 -> ``12``, 0.05 (just above) -> ``0.1``),
then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.functions.numeric import np_round, py_round


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fmt_fixed(c, digits: int, thousands: bool = True) -> Column:
    """Fixed-point text, optionally with thousands separators."""
    v = py_round(c, digits)
    if thousands:
        return F.format_number(v, digits)
    return F.format_string(f"%.{digits}f", v)


def _banded(c, prefix: str) -> Column:
    v = _c(c).cast("double")
    a = F.abs(v)
    return (F.when(v.isNull() | F.isnan(v), F.lit(prefix + "0"))
             .when(a >= 1_000_000, F.concat(F.lit(prefix), fmt_fixed(v / 1_000_000, 2), F.lit("M")))
             .when(a >= 1_000, F.concat(F.lit(prefix), fmt_fixed(v / 1_000, 1), F.lit("K")))
             .otherwise(F.concat(F.lit(prefix), fmt_fixed(v, 0))))


def fmt_currency(c, symbol: str = "£") -> Column:
    """``£1.23M`` / ``£4.5K`` / ``£678``; null -> ``£0``."""
    return _banded(c, symbol)


def fmt_number(c) -> Column:
    """``1.23M`` / ``4.5K`` / ``678``; null -> ``0``."""
    return _banded(c, "")


def fmt_percent(c, decimals: int = 1) -> Column:
    """Fraction -> ``12.3%``; null -> ``0%``."""
    v = _c(c).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit("0%")) \
            .otherwise(F.concat(fmt_fixed(v * 100, decimals, thousands=False), F.lit("%")))


def fmt_plain_float(c, digits: int) -> Column:
    """pandas ``.round(d).astype(str)`` for moderate values."""
    return np_round(c, digits).cast("string")
