"""Trend and season model of many daily series from grouped sums.

Model of a key, with t its days scaled to [0, 1] and y divided by its largest absolute value:
    y(t) = m + k t + sum_j d_j max(t - c_j, 0) + weekly Fourier terms (order 3) + yearly ones (order 10, with a year of days)
Priors: m, k ~ N(0, 5), seasons ~ N(0, 10), slope changes d_j ~ Laplace(0, 0.05); noise N(0, s).

All that the fit needs of the data is the Gram matrix of the design row (its columns and y), so outer products are summed
per key (``gram``) and a task solves one small system per key and round (``fit``): the Laplace
prior is met by reweighted ridge rounds, in which a change weighs 1 / (0.05 |d_j|), until the coefficients rest, and s by the
residual sum, which is a form in the same matrix. ``predict`` evaluates the model in Spark expressions for the
days of the history and ahead, and joins the actuals to them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, Config

CHANGES = 25               # hinge points, evenly spaced in the first RANGE of a key's history
RANGE = 0.8
WEEKLY, YEARLY = 3, 10     # Fourier orders
WEEK, YEAR = 7.0, 365.25
YEAR_DAYS = 365            # a key with fewer days has no yearly terms
LEVEL_PRIOR, CHANGE_PRIOR, SEASON_PRIOR = 5.0, 0.05, 10.0
ROUNDS, RESTS = 2000, 1e-9  # rounds end when no coefficient moves by RESTS (y has scale 1), or after ROUNDS
SMALLEST = 1e-6            # a slope change below it weighs like one of this size
PATHS = 1000               # simulated futures of a key
WIDTH = 2 + CHANGES + 2 * WEEKLY + 2 * YEARLY

MODEL = ("series_key string, lo date, hi date, span double, scale double, n long, beta array<double>, sigma double, "
         "ahead array<struct<h: int, low: double, high: double>>")


def series_range(daily: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """A row per key with enough days: first and last day, span in days, scale of y and number of days."""
    g = daily.where(F.col("y").isNotNull()).groupBy("series_key").agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"), F.max(F.abs("y")).alias("scale"),
                                                                         F.count("y").alias("n"))
    return (g.where(F.col("n") >= cfg.min_forecast_days)
            .withColumns({"span": F.greatest(F.datediff("hi", "lo"), F.lit(1)).cast("double"), "scale": F.greatest("scale", F.lit(1.0))}))


def _waves(day: Column, order: int, period: float) -> list[Column]:
    return [f(day * F.lit(2.0 * np.pi * k / period)) for k in range(1, order + 1) for f in (F.sin, F.cos)]


def design(ds: Column) -> Column:
    """The WIDTH design values of a day as an array; the row holds its key's ``series_range``."""
    day = F.datediff(ds, F.col("lo")).cast("double")
    t = day / F.col("span")
    hinges = [F.greatest(t - F.lit(RANGE * j / (CHANGES + 1)), F.lit(0.0)) for j in range(1, CHANGES + 1)]
    yearly = [F.when(F.col("n") >= YEAR_DAYS, w).otherwise(F.lit(0.0)) for w in _waves(day, YEARLY, YEAR)]
    return F.array(F.lit(1.0), t, *hinges, *_waves(day, WEEKLY, WEEK), *yearly)


def _partial_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows (series_key, x), one summed outer product for each run of a key in a batch."""
    upper = np.triu_indices(WIDTH + 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, WIDTH + 1)
        names = keys.to_numpy(zero_copy_only=False)
        starts = np.r_[0, np.flatnonzero(names[1:] != names[:-1]) + 1]
        sums = [(x[i:j].T @ x[i:j])[upper] for i, j in zip(starts, np.r_[starts[1:], len(names)])]
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts)), pa.array(sums, pa.list_(pa.float64()))], ["series_key", "p"])


def gram(daily: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``series_range`` and ``g``: the upper triangle, row by row, of the summed outer products of (design row, y / scale).

    A key's days (at most the calendar's) lie together, so a task sums them as matrices and hands on an array of
    (WIDTH + 1)(WIDTH + 2) / 2 doubles a key and batch, which Spark adds up. Days with a null y do not count.
    """
    ranges = series_range(daily, cfg)
    rows = daily.where(F.col("y").isNotNull()).join(ranges, "series_key")
    row = F.concat(design(F.col("ds")), F.array(F.col("y") / F.col("scale")))
    parts = (rows.select("series_key", row.alias("x")).repartition("series_key").sortWithinPartitions("series_key")
             .mapInArrow(_partial_grams, "series_key string, p array<double>"))
    sums = parts.groupBy("series_key").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("p")))).alias("g"))
    return ranges.join(sums, "series_key")


def gram_entries(grams: DataFrame) -> DataFrame:
    """``gram`` in long form: series_key, i, j (0 <= i <= j <= WIDTH; WIDTH is y) and value."""
    n = WIDTH + 1
    at = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(i, n)])
    cells = F.zip_with(at, "g", lambda a, v: F.struct(a["i"].alias("i"), a["j"].alias("j"), v.alias("value")))
    return grams.select("series_key", F.explode(cells).alias("c")).select("series_key", "c.*")


def solve(g: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Coefficients and noise of one key from its full Gram matrix, by reweighted ridge rounds."""
    xx, xy, yy = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    weights = np.full(WIDTH, SEASON_PRIOR ** -2)
    weights[:2] = LEVEL_PRIOR ** -2
    change = slice(2, 2 + CHANGES)
    weights[change] = CHANGE_PRIOR ** -2
    variance, before = max(yy / n, 1e-12), np.full(WIDTH, np.inf)
    for _ in range(ROUNDS):
        beta = np.linalg.solve(xx + variance * np.diag(weights), xy)
        left = yy - 2.0 * beta @ xy + beta @ xx @ beta
        variance = max(left / n, 1e-12)
        weights[change] = 1.0 / (CHANGE_PRIOR * np.maximum(np.abs(beta[change]), SMALLEST))
        if np.abs(beta - before).max() < RESTS:
            break
        before = beta
    return beta, float(np.sqrt(variance))


def band_ahead(key: str, beta: np.ndarray, sigma: float, span: float, horizon: int, seed: int) -> list[dict]:
    """Distances of the 5 % and 95 % quantiles from the forecast, a day ahead each: later slope changes come as often and as large as
    past ones (Poisson, Laplace of their mean size), and noise is added. The draw depends on the key and the seed alone."""
    rng = np.random.default_rng([seed, zlib.crc32(key.encode())])
    t = np.arange(1, horizon + 1) / span
    size = float(np.mean(np.abs(beta[2:2 + CHANGES])))
    changes = rng.poisson(CHANGES * t[-1], PATHS)
    paths = rng.normal(0.0, sigma, (PATHS, horizon))
    for k in range(int(changes.max())):  # the k-th change of every path that has one
        when, by = rng.uniform(0.0, t[-1], PATHS), rng.laplace(0.0, size, PATHS)
        paths += np.where(changes > k, by, 0.0)[:, None] * np.maximum(t[None, :] - when[:, None], 0.0)
    low, high = np.quantile(paths, (0.05, 0.95), axis=0)
    return [{"h": h + 1, "low": float(low[h]), "high": float(high[h])} for h in range(horizon)]


def fit(grams: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, cfg: Config = DEFAULT) -> DataFrame:
    """A row per key (``MODEL``): coefficients, noise and the band ahead, in units of the key's scale."""
    seed = cfg.seed
    upper = np.triu_indices(WIDTH + 1)
    names = ["series_key", "lo", "hi", "span", "scale", "n"]
    kind = pa.list_(pa.struct([("h", pa.int32()), ("low", pa.float64()), ("high", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            betas, sigmas, bands = [], [], []
            for key, span, n, cells in zip(*(batch.column(c).to_pylist() for c in ("series_key", "span", "n", "g"))):
                full = np.zeros((WIDTH + 1, WIDTH + 1))
                full[upper] = cells
                full = full + np.triu(full, 1).T
                beta, sigma = solve(full, n)
                betas.append(beta.tolist())
                sigmas.append(sigma)
                bands.append(band_ahead(key or "", beta, sigma, span, horizon, seed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(betas, pa.list_(pa.float64())), pa.array(sigmas, pa.float64()), pa.array(bands, kind)],
                [*names, "beta", "sigma", "ahead"])

    return grams.mapInArrow(task, MODEL)


def attach_actuals(predicted: DataFrame, daily: DataFrame) -> DataFrame:
    """The actual of each predicted day, null and ``IsForecast`` where there is none."""
    return (predicted.join(daily.select("series_key", "ds", "y"), ["series_key", "ds"], "left")
            .withColumn("IsForecast", F.col("y").isNull()))


def predict(models: DataFrame, daily: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, cfg: Config = DEFAULT) -> DataFrame:
    """The forecast table: each key's days with sales and the days ahead, yhat and lower clipped at 0, actuals joined.

    Days ahead come from the series' ranges, so that the models are read once.
    """
    h = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    ahead = series_range(daily, cfg).select("series_key", "hi", h.alias("h")).select("series_key", F.date_add("hi", F.col("h")).alias("ds"), "h")
    past = daily.where(F.col("y").isNotNull()).select("series_key", "ds", F.lit(None).cast("int").alias("h"))
    days = past.unionByName(ahead).join(models.select("series_key", "lo", "span", "scale", "n", "beta", "sigma", "ahead"), "series_key")
    half = F.lit(cfg.interval_z) * F.col("sigma")
    band = F.element_at("ahead", F.col("h"))
    dot = F.aggregate(F.zip_with(design(F.col("ds")), "beta", lambda x, b: x * b), F.lit(0.0), lambda s, v: s + v)
    out = days.withColumns({"raw": dot, "low": F.when(F.col("h").isNull(), -half).otherwise(band["low"]),
                            "high": F.when(F.col("h").isNull(), half).otherwise(band["high"])}).select(
        "series_key", "ds", F.greatest(F.col("raw") * F.col("scale"), F.lit(0.0)).alias("yhat"),
        F.greatest((F.col("raw") + F.col("low")) * F.col("scale"), F.lit(0.0)).alias("yhat_lower"),
        ((F.col("raw") + F.col("high")) * F.col("scale")).alias("yhat_upper"))
    return attach_actuals(out, daily).select("series_key", "ds", "y", "yhat", "yhat_lower", "yhat_upper", "IsForecast")


def with_coefficients(daily: DataFrame, beta: list[float], sigma: float, horizon: int = DEFAULT.forecast_horizon_days,
                      cfg: Config = DEFAULT) -> DataFrame:
    """Models of all keys with given coefficients and noise (in units of the key's scale) and a normal band ahead."""
    if len(beta) != WIDTH:
        raise ValueError(f"{len(beta)} coefficients; the model has {WIDTH}")
    half = cfg.interval_z * sigma
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(
        h.alias("h"), F.lit(-half).alias("low"), F.lit(half).alias("high")))
    return series_range(daily, cfg).withColumns(
        {"beta": F.array(*[F.lit(float(b)) for b in beta]), "sigma": F.lit(float(sigma)), "ahead": ahead})
