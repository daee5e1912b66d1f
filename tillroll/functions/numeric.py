"""Numeric and string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(num, den, default: float = 0.0) -> Column:
    """num / den, or ``default`` when den is 0 or null (ANSI-safe)."""
    return F.coalesce(F.try_divide(_c(num), F.nullif(_c(den), F.lit(0))), F.lit(default))


def np_round(c, digits: int = 0) -> Column:
    """numpy / pandas ``round``: half-to-even on the scaled double, ``rint(x * 10**d) / 10**d``."""
    m = F.lit(float(10 ** digits))
    return F.rint(_c(c) * m) / m


def py_round(c, digits: int = 0) -> Column:
    """Python ``round(x, d)`` / ``format(x, '.df')``: the exact binary value of x
    rounded to d decimals, exact ties to even.

    ``x * 10**d`` is rounded once by the multiplication; its exact error is
    recovered with Dekker's TwoProduct (Veltkamp splits, plain double
    arithmetic), which decides the cases where the rounded product lands on a
    half although the exact product does not.
    """
    x = _c(c).cast("double")
    m = float(10 ** digits)
    p = x * F.lit(m)
    split = F.lit(134217729.0)                  # 2**27 + 1
    cx = split * x
    xh = cx - (cx - x)
    xl = x - xh
    cm = 134217729.0 * m
    mh = cm - (cm - m)
    ml = m - mh
    err = ((xh * F.lit(mh) - p) + xh * F.lit(ml) + xl * F.lit(mh)) + xl * F.lit(ml)
    lo = F.floor(p).cast("double")
    half = (p - lo) == F.lit(0.5)
    r = (F.when(half & (err > 0), lo + 1.0)
          .when(half & (err < 0), lo)
          .otherwise(F.rint(p)))
    return F.when(x.isNull() | F.isnan(x), x).otherwise(r / F.lit(m))


def strip_ws(c) -> Column:
    """Strip leading and trailing whitespace of any kind (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def money_sum(c) -> Column:
    """Total of unrounded amounts: each is taken to six decimals and added as DECIMAL, so the result does not depend on
    summation order (partitioning, AQE coalescing, retries). Nothing is rounded to cents before the sum."""
    return F.sum(_c(c).cast("decimal(18,6)")).cast("double")


def money_sum_sql(x: str) -> str:
    """DuckDB text of the same total."""
    return f"CAST(sum(CAST({x} AS DECIMAL(18,6))) AS DOUBLE)"
