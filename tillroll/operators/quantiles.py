"""Exact (linear-interpolation) quantiles of any number of columns and probabilities.

Two or three shared passes, whatever the number of columns, probabilities and values: each pass counts rows per
(target, bucket) over a fixed number of buckets, with map-side combining, and the driver sees those counts alone.

1. every column: buckets of ``asinh`` (about 0.2 % wide anywhere on the number line), with smallest and largest value;
2. every wanted rank: the rows inside its bucket's range, cut into ``BUCKETS`` equal parts (a monotone function of the value, so counts
   below a part are exact ranks), and the rows below that range; repeated on the part that holds the rank until that
   part holds a single value. Ties never widen a part, so they never add a pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: asinh buckets per unit
FIRST = 512


def _order_statistics(d: DataFrame, wanted: dict[str, set[int]], ranges: dict[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], float]:
    """The value of each (column, rank), ``ranges`` holding it or being near it."""
    found: dict[tuple[str, int], float] = {}
    open_ = {(c, r): ranges[c, r] for c in wanted for r in wanted[c]}
    while open_:
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi) in open_.items()})
        cells = []
        for i, (c, lo, hi) in enumerate(spans):
            v = F.col(c)
            part = F.lit(0) if hi <= lo else F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(BUCKETS))), F.lit(BUCKETS - 1))
            cells.append(F.struct(F.lit(i).alias("t"), F.when(v < lo, F.lit(-1)).when(v > hi, F.lit(BUCKETS)).otherwise(part).cast("int").alias("b"), v.alias("v")))
        rows = (d.select(F.explode(F.array(*cells)).alias("s")).select("s.*").where("v is not null")
                .groupBy("t", "b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        by: dict[int, list] = {}
        for r in rows:  # at most BUCKETS + 2 a span
            by.setdefault(r.t, []).append(r)
        for (c, rank), (lo, hi) in list(open_.items()):
            below = 0
            for r in sorted(by[spans.index((c, lo, hi))], key=lambda r: r.b):
                if rank < below + r.n:
                    if r.lo == r.hi:
                        found[c, rank] = r.lo
                        del open_[c, rank]
                    else:  # also when the rank lies outside of the range: its part is then all that is below or above
                        open_[c, rank] = r.lo, r.hi
                    break
                below += r.n
    return found


def exact_quantiles(df: DataFrame, spec: dict[str, Sequence[float]]) -> dict[tuple[str, float], float | None]:
    """{(column, p): value} for the probabilities of each column; nulls and NaN are left out, None if nothing is left."""
    cols = list(spec)
    names = {c: f"_v{i}" for i, c in enumerate(cols)}
    d = df.select(*(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(names[c]) for c in cols))
    pairs = d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(names[c]).alias("v")) for c in cols))).alias("s")).select("s.*").where("v is not null")
    rows = (pairs.groupBy("c", F.floor(F.asinh("v") * FIRST).alias("b"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect())  # a fixed number of buckets a column
    wanted: dict[str, set[int]] = {}
    ranges: dict[tuple[str, int], tuple[float, float]] = {}
    size = {c: sum(r.n for r in rows if r.c == c) for c in cols}
    for c in cols:
        if not size[c]:
            continue
        hist = sorted((r.b, r.n, r.lo, r.hi) for r in rows if r.c == c)
        ranks = {k for p in spec[c] for k in (math.floor(p * (size[c] - 1)), math.ceil(p * (size[c] - 1)))}
        wanted[names[c]] = ranks
        for rank in ranks:
            below = 0
            for _, n, lo, hi in hist:
                if rank < below + n:
                    ranges[names[c], rank] = lo, hi
                    break
                below += n
    value = _order_statistics(d, wanted, ranges) if wanted else {}
    out: dict[tuple[str, float], float | None] = {}
    for c in cols:
        for p in spec[c]:
            if not size[c]:
                out[c, p] = None
                continue
            pos = p * (size[c] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            a, b = value[names[c], lo], value[names[c], hi]
            out[c, p] = a if lo == hi else (hi - pos) * a + (pos - lo) * b
    return out


def quantiles_row(df: DataFrame, spec: Sequence[tuple[str, float, str]]) -> DataFrame:
    """One row, one DOUBLE column per (column, probability, name) in ``spec``, from shared passes."""
    by: dict[str, list[float]] = {}
    for c, p, _ in spec:
        by.setdefault(c, []).append(float(p))
    got = exact_quantiles(df, by)
    return df.sparkSession.createDataFrame([tuple(got[c, float(p)] for c, p, _ in spec)], ", ".join(f"`{n}` DOUBLE" for _, _, n in spec))


def quantile_row(df: DataFrame, column: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row, one DOUBLE column per requested probability of one column."""
    return quantiles_row(df, [(column, p, n) for p, n in zip(probs, names, strict=True)])


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The aggregate runs once as a scalar subquery and its value is inlined
    into the plan (no join, nothing shuffled); it is a global aggregate, so
    it is exactly one row at any scale.
    """
    cols = one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_scalars")).scalar()
    return df.withColumn("_scalars", packed).withColumns(
        {c: F.col("_scalars")[c] for c in cols}).drop("_scalars")


def distinct_counts(df: DataFrame, columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row of exact distinct counts, one narrow aggregate per column.

    Several ``count(DISTINCT ...)`` in one aggregate make Spark expand every
    row once per distinct column before the shuffle; separate aggregates each
    read one column and de-duplicate it map-side instead.
    """
    rows = [df.select(F.col(c).alias("_v")).where(F.col("_v").isNotNull()).distinct()
              .agg(F.count(F.lit(1)).alias(n)) for c, n in zip(columns, names)]
    out = rows[0]
    for r in rows[1:]:
        out = with_scalars(out, r)
    return out
