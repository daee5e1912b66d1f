"""Registered queries: name -> (spark, sf_dir) -> DataFrame, plus DuckDB oracle text.

A query without oracle text is checked by row count and properties only
(model outputs whose values depend on a random initialisation).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def cmp_round(c, digits: int) -> Column:
    """Rounding for compared outputs, the same double arithmetic as SQL engines'
    ``round(x, n)`` on DOUBLE: half away from zero applied to ``x * 10**n``.
    (Spark's ``round`` rounds the shortest decimal text instead, so the two
    can disagree on values that print with a trailing 5.)"""
    v = F.col(c) if isinstance(c, str) else c
    m = F.lit(float(10 ** digits))
    return F.signum(v) * F.floor(F.abs(v) * m + F.lit(0.5)) / m


def r2(c) -> Column:
    """Money: 2 decimals (both engines see sums in different orders)."""
    return cmp_round(c, 2)


def r6(c) -> Column:
    """Ratios: 6 decimals."""
    return cmp_round(c, 6)


def rounded(df: DataFrame, money=(), ratio=(), **digits: int) -> DataFrame:
    """Round compared columns: money to 2, ratios to 6, others by name=digits."""
    cols = {**{c: r2(c) for c in money}, **{c: r6(c) for c in ratio},
            **{c: cmp_round(c, d) for c, d in digits.items()}}
    return df.withColumns(cols)
