"""Distribution operators: quantile tables, trimmed histograms, correlation,
describe (A21-A26).

Each is a fixed number of global aggregates (one row each) broadcast back,
plus one grouped count; nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.quantiles import exact_quantiles, quantile_row, quantiles_row, with_scalars


def quantile_table(df: DataFrame, spec: Sequence[tuple[str, float]]) -> DataFrame:
    """Rows (column, q, value) for each requested (column, probability)."""
    by: dict[str, list[float]] = {}
    for c, p in spec:
        by.setdefault(c, []).append(float(p))
    got = exact_quantiles(df, by)
    return df.sparkSession.createDataFrame([(c, p, got[c, p]) for c in by for p in by[c]], "column STRING, q DOUBLE, value DOUBLE")


def histogram(df: DataFrame, column: str, bins: int, trim_q: float | None = None,
              inclusive: bool = False, by: str | None = None) -> DataFrame:
    """Equal-width histogram over [min, max] of the (trimmed) values.

    Trim keeps ``x < q`` (or ``x <= q`` when ``inclusive``). Output: [by,] bin,
    bin_lo, bin_hi, count; empty bins are omitted.
    """
    x = F.col(column).cast("double")
    d = df.where(x.isNotNull())
    if trim_q is not None:
        d = with_scalars(d, quantile_row(d, column, [trim_q], ["_cap"]))
        d = d.where(x <= F.col("_cap")) if inclusive else d.where(x < F.col("_cap"))
    mm = d.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    raw_bin = F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins)))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(raw_bin, F.lit(bins - 1))).cast("int")
    keys = [by] if by else []
    g = (with_scalars(d, mm).withColumn("bin", b)
         .groupBy(*keys, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("count")))
    w = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    return g.select(*keys, "bin",
                    (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                    (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"),
                    "count")


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation matrix as rows (row, col, corr).

    Plain sums of products of values centred on their means: n + n (n + 1) / 2 sums, few enough buffer fields
    for the aggregate to stay inside generated code. Rows with a null in any of the columns are left out.
    """
    n = len(columns)
    x = df.select(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)]).dropna()
    centred = with_scalars(x, x.agg(*[F.avg(f"_x{i}").alias(f"_m{i}") for i in range(n)])).select(
        *[(F.col(f"_x{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(n)])
    sums = centred.agg(*[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i in range(n) for j in range(i, n)])
    pairs = [(columns[i], columns[j], f"_c{i}_{j}") for i in range(n) for j in range(i, n)]
    agg = sums.select(*[F.try_divide(F.col(f"_s{i}_{j}"), F.nullif(F.sqrt(F.col(f"_s{i}_{i}")) * F.sqrt(F.col(f"_s{j}_{j}")), F.lit(0.0))).alias(f"_c{i}_{j}")
                        for i in range(n) for j in range(i, n)])
    cells = []
    for a, b, name in pairs:
        cells.append(F.struct(F.lit(a).alias("row"), F.lit(b).alias("col"), F.col(name).alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("row"), F.lit(a).alias("col"), F.col(name).alias("corr")))
    return agg.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def split_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric vs non-numeric columns, by schema type."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]
    other = [f.name for f in df.schema.fields if not isinstance(f.dataType, NUMERIC)]
    return num, other


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample std, min, 25/50/75 % (linear), max per numeric column."""
    columns = list(columns or split_columns(df)[0])
    names = {c: f"_c{i}" for i, c in enumerate(columns)}
    moments = []
    for c in columns:
        x, n = F.col(c).cast("double"), names[c]
        moments += [F.count(x).alias(f"{n}_count"), F.avg(x).alias(f"{n}_mean"),
                    F.stddev_samp(x).alias(f"{n}_std"), F.min(x).alias(f"{n}_min"), F.max(x).alias(f"{n}_max")]
    # one pass for all moments, one pass for all quartiles
    qs = quantiles_row(df, [(c, p, f"{names[c]}_{tag}") for c in columns
                            for p, tag in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    row = with_scalars(df.agg(*moments), qs)
    stats = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")
    cells = [F.struct(F.lit(c).alias("column"), *[F.col(f"{names[c]}_{s}").alias(s) for s in stats])
             for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def describe_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, unique, top (most frequent; ties -> smallest), freq per text column."""
    columns = list(columns or [c for c in split_columns(df)[1]
                               if isinstance(df.schema[c].dataType, T.StringType)])
    parts = []
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        summary = counts.agg(F.sum("_n").alias("count"), F.count(F.lit(1)).alias("unique"))
        top = counts.orderBy(F.desc("_n"), F.asc("_v")).limit(1).select(
            F.col("_v").alias("top"), F.col("_n").alias("freq"))
        parts.append(with_scalars(summary, top).select(F.lit(c).alias("column"), "count", "unique", "top", "freq"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first ``n`` rows (a display preview; the limit is the feature)."""
    return df.limit(n)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)
