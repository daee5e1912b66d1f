"""Demand forecasting (A18, F7, W7, M6-M10, P19), re-aimed at many series.

A series is one key (the whole business, a country, a SKU ...). Daily sums
come from one grouped aggregate; the gap-filled daily series of each key is one
array, bounded by the number of calendar days in the data (not by the number of
lines), and the additive Holt-Winters recurrence (weekly season, additive trend) moves all
keys of a task day by day as vectors (``smoothing``). Keys are independent, so fits spread
across executors by key.

Holt-Winters recurrence (season length m = 7, ring s[0..6], s[0] = season of
the current day):
    fit   = l + b + s[0]
    l'    = a (y - s[0]) + (1 - a) (l + b)
    b'    = c (l' - l) + (1 - c) b
    ring  = s[1..6] + [g (y - l - b) + (1 - g) s[0]]
    yhat(h) = l + h b + s[(h - 1) mod 7]
Start: l = mean(y[0:7]), b = (mean(y[7:14]) - mean(y[0:7])) / 7, s[i] = y[i] - l.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import PythonException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, Config
from tillroll.functions.formatting import fmt_currency, fmt_fixed
from tillroll.functions.numeric import money_sum
from tillroll.operators import decomposition, smoothing

M = smoothing.M
LOG = logging.getLogger(__name__)


def daily_series(df: DataFrame, value_col: str = "TotalPrice", keys: Sequence[str] = ()) -> DataFrame:
    """(series_key, ds DATE, y) daily sums of ``value_col`` per key ('ALL' without keys)."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("ALL")
    agg = money_sum(value_col) if value_col == "TotalPrice" else F.sum(value_col)
    return df.groupBy(key.alias("series_key"), F.to_date("InvoiceDate").alias("ds")).agg(agg.alias("y"))


def fill_daily(daily: DataFrame) -> DataFrame:
    """Every calendar day of each series, gaps linearly interpolated.

    Adds ``observed`` (the day had sales). Windows are partitioned by series
    key and hold that key's days only.
    """
    rng = daily.groupBy("series_key").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    days = rng.select("series_key", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 DAY"))).alias("ds"))
    j = days.join(daily, ["series_key", "ds"], "left")
    # both look-ups are running frames (unbounded preceding .. current row), which
    # Spark evaluates incrementally; the "next" value runs over descending days
    w_prev = Window.partitionBy("series_key").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    w_next = Window.partitionBy("series_key").orderBy(F.desc("ds")).rowsBetween(Window.unboundedPreceding, 0)
    obs_ds = F.when(F.col("y").isNotNull(), F.col("ds"))
    py, pd_ = F.last("y", True).over(w_prev), F.last(obs_ds, True).over(w_prev)
    ny, nd = F.last("y", True).over(w_next), F.last(obs_ds, True).over(w_next)
    interp = (F.col("_ny") - F.col("_py")) / F.datediff("_nd", "_pd") * F.datediff("ds", "_pd") + F.col("_py")
    return (j.withColumns({"_py": py, "_pd": pd_, "_ny": ny, "_nd": nd})
             .select("series_key", "ds", F.coalesce(F.col("y"), interp).alias("y"),
                     F.col("y").isNotNull().alias("observed")))


def series_status(filled: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """M7: a row per key: observed days, whether it is forecast, and if not why."""
    return with_status(filled.groupBy("series_key").agg(F.count_if("observed").alias("observed_days")), cfg)


def with_status(keys: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """M7: adds to rows with ``observed_days`` whether they are forecast, and if not why."""
    short = F.col("observed_days") < cfg.min_forecast_days
    return keys.withColumns({"forecast": ~short, "reason": F.when(short, F.lit(f"fewer than {cfg.min_forecast_days} days with sales"))})


MODES = ("fixed", "grid", "estimated")


def smoothed(filled: DataFrame, mode: str = "fixed", cfg: Config = DEFAULT) -> DataFrame:
    """A row per key with enough days: parameters, squared error, last state, start state and fits (``smoothing.RESULT``), and the array ``d`` of its days."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    days = (filled.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("ds", "y", "observed"))).alias("d"))
            .where((F.size(F.filter("d", lambda x: x["observed"])) >= cfg.min_forecast_days) & (F.size("d") >= 2 * M)))
    grid = np.array([(a, c, g) for a in cfg.hw_grid for c in cfg.hw_trend_grid for g in cfg.hw_grid], float)
    fit = smoothing.smoother(mode, (cfg.hw_alpha, cfg.hw_beta, cfg.hw_gamma), grid)
    # the days pass through, so nothing is joined back
    rows = days.select("series_key", "d", F.transform("d", lambda x: x["y"]).alias("ys"))
    return rows.mapInArrow(fit, smoothing.RESULT + ", d array<struct<ds: date, y: double, observed: boolean>>")


def holt_winters(filled: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, cfg: Config = DEFAULT,
                 mode: str = "fixed") -> DataFrame:
    """M6/M7: fitted history plus ``horizon`` future days per key.

    Keys with fewer than ``min_forecast_days`` observed days have no forecast (:func:`series_status` names them).
    A key's days are one array (bounded by the calendar span); a task moves all its keys day by day as vectors (``smoothing``). ``mode``: fixed
    parameters, per key the best of cfg's grid, or parameters and start states estimated per key.
    """
    days = smoothed(filled, mode, cfg)
    resid = F.zip_with(F.transform("d", lambda x: x["y"]), "fits", lambda y, f: y - f)
    # sample standard deviation of the residuals by running mean and squares
    spread = F.aggregate(resid, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q")),
                         lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["m"] + (x - s["m"]) / (s["n"] + 1)).alias("m"),
                                               (s["q"] + (x - (s["m"] + (x - s["m"]) / (s["n"] + 1))) * (x - s["m"])).alias("q")))
    days = days.withColumn("r", spread).withColumn("band", F.lit(cfg.interval_z) * F.sqrt(F.col("r.q") / (F.col("r.n") - 1)))
    last = F.element_at("d", -1)["ds"]
    past = F.zip_with("d", "fits", lambda d, f: F.struct(d["ds"].alias("ds"), d["y"].alias("y"), f.alias("yhat"), F.lit(False).alias("IsForecast")))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.struct(
        F.date_add(last, h).alias("ds"), F.lit(None).cast("double").alias("y"),
        F.greatest(F.col("level") + h * F.col("trend") + F.element_at("ring", ((h - 1) % M + 1).cast("int")), F.lit(0.0)).alias("yhat"), F.lit(True).alias("IsForecast")))
    rows = days.select("series_key", "band", F.explode(F.concat(past, ahead)).alias("x")).select("series_key", "band", "x.*")
    return rows.select("series_key", "ds", "y", "yhat", F.greatest(F.col("yhat") - F.col("band"), F.lit(0.0)).alias("yhat_lower"),
                       (F.col("yhat") + F.col("band")).alias("yhat_upper"), "IsForecast")


def forecast_demand(df: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, value_col: str = "TotalPrice",
                    keys: Sequence[str] = (), mode: str = "fixed", cfg: Config = DEFAULT) -> DataFrame:
    """Daily series -> gap fill -> Holt-Winters per key (parameters fixed, of a grid, or estimated)."""
    return holt_winters(fill_daily(daily_series(df, value_col, keys)), horizon, cfg, mode)


METHODS = ("auto", "trend_season", "holt_winters")
NUMERICAL = ("LinAlgError", "FloatingPointError")


def forecast(df: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, value_col: str = "TotalPrice", keys: Sequence[str] = (),
             method: str = "auto", cfg: Config = DEFAULT) -> tuple[DataFrame, str]:
    """M6-M8: the forecast and the name of the method that made it.

    Without keys, fewer than ``min_forecast_days`` sale days are an error. ``auto`` takes the trend and season regression, and if its
    systems cannot be solved, Holt-Winters with parameters and start states estimated per key; either can be asked for by name.
    """
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    if not keys:
        require_history(df, cfg.min_forecast_days)
    if method != "holt_winters":
        out = trend_season(df, horizon, value_col, keys, cfg).persist()
        try:
            out.count()  # tasks run here, so a failure is met here
            return out, "trend_season"
        except PythonException as failed:
            out.unpersist()
            # only a numerical failure changes the method; a lost task or a lack of memory is an error
            if method == "trend_season" or not any(name in str(failed) for name in NUMERICAL):
                raise
            LOG.warning("the trend and season model could not be solved; Holt-Winters takes its place: %s", failed)
    return forecast_demand(df, horizon, value_col, keys, "estimated", cfg), "holt_winters"


def require_history(df: DataFrame, min_days: int = DEFAULT.min_forecast_days) -> None:
    """M7 for a single total series: raise when fewer than ``min_days`` sale days exist."""
    n = df.select(F.to_date("InvoiceDate").alias("d")).distinct().limit(min_days).count()
    if n < min_days:
        raise ValueError(f"{n} days with sales are too few for a forecast; {min_days} are needed")


def summary(fc: DataFrame, window: int = 30) -> DataFrame:
    """M9: future total, trailing-30-day mean of history, future mean, pct change (0 if undefined)."""
    last = F.max(F.when(~F.col("IsForecast"), F.col("ds"))).over(Window.partitionBy("series_key"))
    d = fc.withColumn("_last", last)
    trailing = ~F.col("IsForecast") & (F.col("ds") > F.date_sub("_last", window))
    g = d.groupBy("series_key").agg(
        F.coalesce(F.sum(F.when(F.col("IsForecast"), F.col("yhat"))), F.lit(0.0)).alias("forecast_total"),
        F.avg(F.when(trailing, F.col("y"))).alias("_t"),
        F.avg(F.when(F.col("IsForecast"), F.col("yhat"))).alias("_f"))
    pct = F.when(F.col("_t").isNotNull() & (F.col("_t") != 0) & F.col("_f").isNotNull(),
                 (F.col("_f") - F.col("_t")) / F.col("_t")).otherwise(F.lit(0.0))
    return g.select("series_key", "forecast_total",
                    F.coalesce("_t", F.lit(0.0)).alias("trailing_avg_daily"),
                    F.coalesce("_f", F.lit(0.0)).alias("forecast_avg_daily"),
                    pct.alias("pct_change_vs_trailing"))


#: days of series that :func:`key_summaries` fills and smooths at once
DAYS = 1 << 21
SUMMARY = "series_key string, observed_days long, forecast_total double, trailing_avg_daily double, forecast_avg_daily double, pct_change_vs_trailing double"


def _dense(at: np.ndarray, row: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """F7/W7 for many series: value y at day ``at`` of series ``row``, gaps linearly interpolated as in :func:`fill_daily`; 0 behind a
    series' own n days, NaN where no day with a value is before or after."""
    width = int(n.max())
    out = np.full((len(n), width), np.nan)
    out[row, at] = y
    day = np.arange(width)
    known = ~np.isnan(out)
    before = np.maximum.accumulate(np.where(known, day, -1), axis=1)
    after = np.minimum.accumulate(np.where(known, day, width)[:, ::-1], axis=1)[:, ::-1]
    r, d = np.nonzero(~known & (before >= 0) & (after < width))
    lo, hi = before[r, d], after[r, d]
    a, b = out[r, lo], out[r, hi]
    out[r, d] = (b - a) / (hi - lo) * (d - lo) + a
    out[day >= n[:, None]] = 0.0
    return out


def _summarise(mode: str, horizon: int, window: int, cfg: Config):
    grid = np.array([(a, c, g) for a in cfg.hw_grid for c in cfg.hw_trend_grid for g in cfg.hw_grid], float)
    fixed = (cfg.hw_alpha, cfg.hw_beta, cfg.hw_gamma)

    def some(days: np.ndarray, off: np.ndarray, y: np.ndarray, n: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The four sums of the given series."""
        size = np.diff(off)[keys]
        row = np.repeat(np.arange(len(keys)), size)
        x = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(off[keys], size)
        z = _dense(days[x] - np.repeat(days[off[keys]], size), row, y[x], n[keys])
        p, start = smoothing.chosen(mode, fixed, grid, z, n[keys])
        _, level, trend, ring, _ = smoothing.run(z, n[keys], start, p)
        h = np.arange(1, horizon + 1)
        ahead = np.maximum(level[:, None] + h * trend[:, None] + ring[:, (h - 1) % M], 0.0)
        # sums run in the order of the days, as Spark's do: rounded means of interpolated days often lie on a half
        total = np.cumsum(ahead, axis=1)[:, -1]
        at = n[keys, None] - np.arange(window, 0, -1)
        past = np.take_along_axis(z, np.maximum(at, 0), axis=1)
        seen = (at >= 0) & ~np.isnan(past)
        count = seen.sum(axis=1)
        mean = np.divide(np.cumsum(np.where(seen, past, 0.0), axis=1)[:, -1], count, out=np.zeros(len(keys)), where=count > 0)
        change = np.divide(total / horizon - mean, mean, out=np.zeros(len(keys)), where=mean != 0)
        return np.column_stack([total, mean, total / horizon, change])

    def of(batches):
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("d")
            off = lists.offsets.to_numpy()
            off = off - off[0]
            flat = lists.flatten()
            days = flat.field("ds").cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
            y = flat.field("y").to_numpy(zero_copy_only=False).astype(float)
            n = days[off[1:] - 1] - days[off[:-1]] + 1
            observed = b.column("observed_days").to_numpy(zero_copy_only=False)
            # series of like length go together, so that little is padded
            long = np.flatnonzero((observed >= cfg.min_forecast_days) & (n >= 2 * M))
            long = long[np.argsort(n[long], kind="stable")]
            out = np.zeros((b.num_rows, 4))
            while len(long):
                step = max(1, DAYS // int(n[long[-1]]))
                keys, long = long[-step:], long[:-step]
                out[keys] = some(days, off, y, n, keys)
            none = (observed < cfg.min_forecast_days) | (n < 2 * M)
            yield pa.RecordBatch.from_arrays([b.column("series_key"), b.column("observed_days"), *(pa.array(c, mask=none) for c in out.T)],
                                             names=[c.split()[0] for c in SUMMARY.split(", ")])
    return of


def key_summaries(daily: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, window: int = 30, cfg: Config = DEFAULT, mode: str = "fixed") -> DataFrame:
    """F7, M6, M7 and M9 for very many keys: a row per key of :func:`daily_series` with its observed days and what :func:`summary` says of
    :func:`holt_winters` of :func:`fill_daily` (nulls for keys that have no forecast).

    Only the days with sales are shuffled; a task fills a batch of keys, smooths and summarises them, so the calendar of a key (its days
    times its keys is far more than the lines) is never a table.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}, not {mode!r}")
    days = (daily.where(F.col("ds").isNotNull()).groupBy("series_key")
            .agg(F.count("y").alias("observed_days"), F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("d")))
    return days.mapInArrow(_summarise(mode, horizon, window, cfg), SUMMARY)


def errors(fc: DataFrame, min_rows: int = 5) -> DataFrame:
    """In-sample MAE and MAPE (%) per key, for keys with more than ``min_rows`` history rows."""
    h = fc.where(~F.col("IsForecast") & F.col("y").isNotNull())
    err = F.abs(F.col("y") - F.col("yhat"))
    g = h.groupBy("series_key").agg(
        F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"),
        (F.avg(F.when(F.col("y") != 0, err / F.col("y"))) * 100).alias("mape"))
    return g.where(F.col("n") > min_rows)


def forecast_table(fc: DataFrame, symbol: str = DEFAULT.currency) -> DataFrame:
    """Future rows as display text (date, forecast, lower, upper)."""
    def money(c):
        return F.concat(F.lit(symbol), fmt_fixed(c, 0))
    return fc.where(F.col("IsForecast")).select(
        "series_key", F.date_format("ds", "yyyy-MM-dd").alias("Date"), money("yhat").alias("Forecast"),
        money("yhat_lower").alias("Lower Bound"), money("yhat_upper").alias("Upper Bound"))


def trend_season(df: DataFrame, horizon: int = DEFAULT.forecast_horizon_days, value_col: str = "TotalPrice",
                 keys: Sequence[str] = (), cfg: Config = DEFAULT) -> DataFrame:
    """M8: trend with slope changes and weekly and yearly terms per key, fitted on the days with sales (no gap fill) from grouped sums
    (``decomposition``); 90 % band, yhat and lower clipped at 0. Keys with fewer than ``min_forecast_days`` days have no rows."""
    daily = daily_series(df, value_col, keys)
    return decomposition.predict(decomposition.fit(decomposition.gram(daily, cfg), horizon, cfg), daily, horizon, cfg)


def forecast_card(summed: DataFrame, symbol: str = DEFAULT.currency) -> DataFrame:
    """The overview's forecast card: the future total, and its signed change against the trailing average."""
    pct = F.col("pct_change_vs_trailing") * 100
    sign = F.when(pct >= 0, F.lit("+")).otherwise(F.lit(""))
    return summed.select("series_key", fmt_currency("forecast_total", symbol).alias("value"),
                         F.concat(sign, fmt_fixed(pct, 1, thousands=False), F.lit("% vs trailing avg")).alias("delta"),
                         (F.col("pct_change_vs_trailing") >= 0).alias("positive"))
