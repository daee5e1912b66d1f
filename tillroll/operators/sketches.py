"""Approximate quantiles from mergeable KLL sketches (A24's opt-in; ``quantiles.exact_quantiles`` stays the default).

Lines are read once, into one sketch a cell (such as a country's month) and column: the partial sketches of the tasks are merged in the
shuffle, so a cell that holds a third of the lines moves as one sketch a task. Any filter or grouping by cell keys then
merges sketches and reads no lines. Counts, smallest and largest values are exact; a quantile is a value of the column whose rank lies
within about ``rank_error(k)`` of the wanted one, and is exact while a merged cell has no more than k values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: values that the top level of a sketch keeps
K = 1024
#: groups whose quantiles may go to the lines as a broadcast, some 200 bytes each a column
GROUPS = 100_000
_SKETCH = "sketch_{}".format


def rank_error(k: int = K) -> float:
    """Rank error, as a part of the rows, that a sketch's quantile keeps with 99 % confidence (fitted by the sketch's authors)."""
    return 2.296 / k ** 0.9021


def sketch_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str], k: int = K) -> DataFrame:
    """``keys`` and a sketch of each column; nulls and NaN are left out, so a sketch may be empty."""
    def number(c: str) -> Column:
        return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    return df.groupBy(*keys).agg(*(F.kll_sketch_agg_double(number(c), F.lit(k)).alias(_SKETCH(c)) for c in columns))


def merged(cells: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cells of fewer ``keys`` (none: one row), each the merge of the given ones."""
    return cells.groupBy(*keys).agg(*(F.kll_merge_agg_double(_SKETCH(c)).alias(_SKETCH(c)) for c in columns))


def sketch_quantiles(cells: DataFrame, column: str, probs: Sequence[float]) -> tuple[Column, Column]:
    """(number of values, their quantiles as an array in the order of ``probs``); the array is null if there are no values."""
    sketch = F.col(_SKETCH(column))
    n = F.coalesce(F.kll_sketch_get_n_double(sketch), F.lit(0)).cast("long")
    at = F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(float(p)) for p in probs)))
    return n, F.when(n > 0, at)


def approx_quantiles(cells: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (``by``, column, q, n, value) of cells that hold the columns' sketches; value is null where n is 0.

    Filters go on ``cells`` before: ``approx_quantiles(cells.where("Country = 'FRANCE'"), ...)``. Without ``by``, no cells give n = 0.
    """
    wide = merged(cells, by, columns)
    parts = []
    for c in columns:
        n, values = sketch_quantiles(wide, c, probs)
        ranks = F.array(*(F.lit(float(p)) for p in probs))
        parts.append(F.struct(F.lit(c).alias("column"), n.alias("n"), ranks.alias("q"), values.alias("value")))
    rows = wide.select(*by, F.explode(F.array(*parts)).alias("s")).select(*by, "s.*")
    return rows.select(*by, "column", "n", F.posexplode("q").alias("i", "q"), "value").select(
        *by, "column", "q", "n", F.get("value", F.col("i")).alias("value"))


def rank_misses(df: DataFrame, quantiles: DataFrame, by: str, column: str, probs: Sequence[float]) -> DataFrame:
    """:func:`column_misses` of one column: (``by``, miss)."""
    return column_misses(df, quantiles, by, (column,), probs).select(by, "miss")


def column_misses(df: DataFrame, quantiles: DataFrame, by: str, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """How far approximate quantiles are off: (``by``, column, miss), miss being the largest distance, as a part of the group's rows, between a
    wanted rank and the ranks that its value holds in ``df``. One pass over the lines for all columns; ``quantiles`` has one row a group, column
    and rank and should be a written table, since its groups are counted first: up to ``GROUPS`` go to the lines, which are then not shuffled.
    """
    def picked(f, condition: Column, value: str, name: str) -> Column:
        return f(F.when(condition, F.col(value))).alias(name)
    places = [(c, i, float(p)) for c in columns for i, p in enumerate(probs)]
    of = {c: j for j, c in enumerate(columns)}
    table = quantiles.where(F.col("column").isin(list(columns))).groupBy(by).agg(
        *(picked(F.max, F.col("column") == c, "n", f"n{j}") for c, j in of.items()),
        *(picked(F.max, (F.col("column") == c) & (F.col("q") == p), "value", f"v{of[c]}_{i}") for c, i, p in places))
    if quantiles.select(by).distinct().limit(GROUPS + 1).count() <= GROUPS:
        table = F.broadcast(table)
    counts = [F.count(F.when(hit, 1)).alias(f"{name}{of[c]}_{i}") for c, i, _ in places for name, hit in
              (("below", F.col(c).cast("double") < F.col(f"v{of[c]}_{i}")), ("upto", F.col(c).cast("double") <= F.col(f"v{of[c]}_{i}")))]
    ranked = df.select(by, *columns).join(table, by).groupBy(by, *(f"n{j}" for j in of.values())).agg(*counts)
    off = {c: [F.greatest(F.lit(0.0), F.col(f"below{j}_{i}") / F.col(f"n{j}") - F.lit(p), F.lit(p) - F.col(f"upto{j}_{i}") / F.col(f"n{j}"))
               for d, i, p in places if d == c] for c, j in of.items()}
    misses = [F.struct(F.lit(c).alias("column"), F.col(f"n{of[c]}").alias("n"), (F.greatest(*m) if len(m) > 1 else m[0]).alias("miss"))
              for c, m in off.items()]
    return ranked.select(by, F.explode(F.array(*misses)).alias("m")).where(F.col("m.n").isNotNull()).select(by, "m.column", "m.miss")
