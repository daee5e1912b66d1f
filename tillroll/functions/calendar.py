"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillroll.config import SEASONS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_name(ts) -> Column:
    """Three-letter English month abbreviation (Jan..Dec)."""
    return F.date_format(_c(ts), "MMM")


def day_name(ts) -> Column:
    """Full English weekday name."""
    return F.date_format(_c(ts), "EEEE")


def day_number(ts) -> Column:
    """Weekday number with Monday = 0."""
    return F.weekday(_c(ts))


def year_month(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def season(month) -> Column:
    """Month number -> meteorological season (northern hemisphere)."""
    m = _c(month)
    expr = None
    for name in ("Winter", "Spring", "Summer", "Autumn"):
        months = [k for k, v in SEASONS.items() if v == name]
        expr = (F.when(m.isin(months), F.lit(name)) if expr is None
                else expr.when(m.isin(months), F.lit(name)))
    return expr


def elapsed_days(start, end) -> Column:
    """Whole days elapsed from ``start`` to ``end`` (floor of the duration,
    not a count of calendar-day boundaries; inputs here have end >= start)."""
    return F.timestamp_diff("DAY", _c(start), _c(end))
