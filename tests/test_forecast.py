import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import forecast as FC
from tillroll.operators import smoothing

D0 = dt.date(2011, 1, 3)


def test_fill_interpolates_linearly(spark):
    rows = [("k", D0, 10.0), ("k", D0 + dt.timedelta(days=3), 40.0)]
    daily = spark.createDataFrame(rows, "series_key STRING, ds DATE, y DOUBLE")
    got = [(r.y, r.observed) for r in FC.fill_daily(daily).orderBy("ds").collect()]
    assert got == [(10.0, True), (20.0, False), (30.0, False), (40.0, True)]


def test_holt_winters_shape_and_bands(spark, featured_small):
    fc = FC.forecast_demand(featured_small, horizon=30).cache()
    fut = fc.where("IsForecast")
    assert fut.count() == 30
    assert fc.where(F.col("IsForecast") != F.col("y").isNull()).count() == 0
    assert fut.where(~((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper")))).count() == 0
    assert fc.where(F.col("yhat_lower") < 0).count() == 0
    days = featured_small.agg(F.datediff(F.max(F.to_date("InvoiceDate")), F.min(F.to_date("InvoiceDate")))).first()[0]
    assert fc.where(~F.col("IsForecast")).count() == days + 1


def plain(ys, a, c, g):
    l0 = sum(ys[:7]) / 7
    level, trend, s = l0, (sum(ys[7:14]) / 7 - l0) / 7, [y - l0 for y in ys[:7]]
    fits, sse = [], 0.0
    for t, y in enumerate(ys):
        fits.append(level + trend + s[t % 7])
        sse += (y - fits[-1]) ** 2
        nl = a * (y - s[t % 7]) + (1 - a) * (level + trend)
        s[t % 7] = g * (y - level - trend) + (1 - g) * s[t % 7]
        trend, level = c * (nl - level) + (1 - c) * trend, nl
    n = len(ys)
    return fits, sse, [max(level + h * trend + s[(n + h - 1) % 7], 0.0) for h in range(1, 11)]


@pytest.mark.parametrize("mode", ["fixed", "grid"])
def test_recurrence_matches_plain_one(spark, mode):
    series = {"a": [float((i * 37) % 11 + i * 0.5) for i in range(40)], "b": [float((i * i * 13) % 29) + 3 * (i % 7) for i in range(61)], "short": [1.0] * 13}
    rows = [(k, D0 + dt.timedelta(days=i), y, True) for k, ys in series.items() for i, y in enumerate(ys)]
    filled = spark.createDataFrame(rows, "series_key STRING, ds DATE, y DOUBLE, observed BOOLEAN")
    out = FC.holt_winters(filled, 10, mode=mode).orderBy("series_key", "ds").collect()
    cfg = FC.DEFAULT
    for k in ("a", "b"):
        ys = series[k]
        grid = [(a, c, g) for a in cfg.hw_grid for c in cfg.hw_trend_grid for g in cfg.hw_grid] if mode == "grid" else [(cfg.hw_alpha, cfg.hw_beta, cfg.hw_gamma)]
        fits, _, ahead = plain(ys, *min(grid, key=lambda p: plain(ys, *p)[1]))
        got = [r for r in out if r.series_key == k]
        assert [r.yhat for r in got] == pytest.approx(fits + ahead, rel=1e-9, abs=1e-9)
        r = [y - f for y, f in zip(ys, fits, strict=True)]
        m = sum(r) / len(r)
        band = cfg.interval_z * math.sqrt(sum((x - m) ** 2 for x in r) / (len(r) - 1))
        assert [x.yhat_upper - x.yhat for x in got] == pytest.approx([band] * len(got))
    assert {r.series_key for r in out} == {"a", "b"}
    status = {r.series_key: r for r in FC.series_status(filled).collect()}
    assert status["a"].forecast and not status["short"].forecast and status["short"].observed_days == 13 and "14" in status["short"].reason


def test_methods_fallback_and_guard(spark, featured_small, monkeypatch):
    assert FC.forecast(featured_small, 7)[1] == "trend_season"
    assert FC.forecast(featured_small, 7, method="holt_winters")[1] == "holt_winters"

    def unsolved(batches):
        raise np.linalg.LinAlgError("does not fit")
        yield from batches

    def broken(*args, **kw):
        return featured_small.select("Invoice").mapInArrow(unsolved, "x string")
    monkeypatch.setattr(FC, "trend_season", broken)
    out, method = FC.forecast(featured_small, 7)
    assert method == "holt_winters" and out.where("IsForecast").count() == 7
    with pytest.raises(Exception, match="does not fit"):
        FC.forecast(featured_small, 7, method="trend_season")
    # any other failure is an error, not a change of method
    monkeypatch.setattr(FC, "trend_season", lambda *args, **kw: featured_small.select(F.raise_error(F.lit("lost")).alias("x")))
    with pytest.raises(Exception, match="lost"):
        FC.forecast(featured_small, 7)
    with pytest.raises(ValueError, match="too few"):
        FC.forecast(featured_small.where("day(InvoiceDate) = 1 and month(InvoiceDate) = 1"), 7)
    with pytest.raises(ValueError, match="method"):
        FC.forecast(featured_small, 7, method="other")


def replay(ys, r):
    """Squared error and forecasts of the recurrence from returned states and parameters."""
    level, trend, *s = r.start
    sse = 0.0
    for t, y in enumerate(ys):
        fit = level + trend + s[t % 7]
        sse += (y - fit) ** 2
        nl = r.a * (y - s[t % 7]) + (1 - r.a) * (level + trend)
        s[t % 7] = r.g * (y - level - trend) + (1 - r.g) * s[t % 7]
        trend, level = r.c * (nl - level) + (1 - r.c) * trend, nl
    return sse, [max(level + h * trend + s[(len(ys) + h - 1) % 7], 0.0) for h in range(1, 8)]


def test_estimated_is_never_worse_than_the_grid(spark, featured_small):
    filled = FC.fill_daily(FC.daily_series(featured_small, keys=["Country"])).persist()
    grid = {r.series_key: r for r in FC.smoothed(filled, "grid").collect()}
    best = {r.series_key: r for r in FC.smoothed(filled, "estimated").collect()}
    assert best and set(best) == set(grid)
    ahead = {}
    for r in FC.holt_winters(filled, 7, mode="estimated").where("IsForecast").orderBy("series_key", "ds").collect():
        ahead.setdefault(r.series_key, []).append(r.yhat)
    for k, r in best.items():
        ys = [x.y for x in r.d]
        sse, fc = replay(ys, r)
        assert r.sse <= grid[k].sse and r.sse == pytest.approx(sse, rel=1e-6)
        assert all(0 <= x <= 1 for x in (r.a, r.c, r.g)) and ahead[k] == pytest.approx(fc, rel=1e-6, abs=1e-6)
    assert sum(best[k].sse < 0.97 * grid[k].sse for k in best) > len(best) / 2
    filled.unpersist()


def test_estimate_finds_the_states_and_parameters_of_a_made_series():
    rng = np.random.default_rng(1)
    rows, n = 6, 300
    start = np.column_stack([np.full(rows, 50.0), np.full(rows, 0.3), *(rng.normal(0, 8, (rows, 7)) @ (np.eye(7) - 1 / 7)).T])
    p = np.column_stack([np.linspace(0.1, 0.8, rows), np.linspace(0.05, 0.3, rows), np.linspace(0.1, 0.5, rows)])
    y = np.zeros((rows, n))
    for r in range(rows):  # noise-free: each value is the recurrence's own fit, with one shock
        level, trend, s = start[r, 0], start[r, 1], list(start[r, 2:])
        for t in range(n):
            y[r, t] = level + trend + s[t % 7] + (30.0 if t in (40, 41, 120) else 0.0)
            x = y[r, t]
            nl = p[r, 0] * (x - s[t % 7]) + (1 - p[r, 0]) * (level + trend)
            s[t % 7] = p[r, 2] * (x - level - trend) + (1 - p[r, 2]) * s[t % 7]
            trend, level = p[r, 1] * (nl - level) + (1 - p[r, 1]) * trend, nl
    size = np.full(rows, n)
    assert np.allclose(smoothing.best_start(y[:, :40], np.full(rows, 40), p)[:, :2], start[:, :2], atol=1e-5)
    found, sse, _ = smoothing.estimate(y, size, np.array([(a, c, g) for a in (0.1, 0.5) for c in (0.05, 0.3) for g in (0.1, 0.5)]))
    truth = smoothing.run(y, size, start, p)[0]
    assert (sse <= truth * 1.01).all()


def test_short_history_rejected(spark):
    df = spark.createDataFrame([(dt.datetime(2011, 1, d), 1.0) for d in range(1, 10)],
                               "InvoiceDate TIMESTAMP_NTZ, TotalPrice DOUBLE")
    with pytest.raises(ValueError):
        FC.require_history(df)
    assert FC.forecast_demand(df).count() == 0          # per-key form: key left out


def test_tuned_and_trend_season_run(spark, featured_small):
    tuned = FC.forecast_demand(featured_small, horizon=7, mode="grid")
    assert tuned.where("IsForecast").count() == 7
    ts = FC.trend_season(featured_small, horizon=7)
    assert ts.where("IsForecast").count() == 7
    assert ts.where(F.col("yhat") < 0).count() == 0


def test_summary_and_errors(spark, featured_small):
    fc = FC.forecast_demand(featured_small)
    s = FC.summary(fc).first()
    assert s.forecast_total >= 0 and s.trailing_avg_daily >= 0
    e = FC.errors(fc).first()
    assert e.n > 5 and e.mae >= 0
    t = FC.forecast_table(fc).collect()
    assert len(t) == 30 and all(r.Forecast.startswith("£") for r in t)


def test_key_summaries_say_what_the_rows_say_and_make_no_calendar_table(spark):
    rng = np.random.default_rng(5)
    rows = [("one", D0, 3.0), ("short", D0, 1.0), ("short", D0 + dt.timedelta(days=900), 2.0), ("gone", None, 4.0)]
    for k in range(12):  # spans and gaps of their own, some days without a value, some spans below the window of 30 days
        at = np.sort(rng.choice(20 + 40 * k, 16, replace=False))
        rows += [(f"k{k}", D0 + dt.timedelta(days=int(d)), None if k % 4 == 1 and 3 < i < 6 else float(rng.integers(1, 500)) / 4) for i, d in enumerate(at)]
    daily = spark.createDataFrame(rows, "series_key STRING, ds DATE, y DOUBLE")
    filled = FC.fill_daily(daily)
    for mode in ("fixed", "grid"):
        want = {r.series_key: r for r in FC.series_status(filled).join(FC.summary(FC.holt_winters(filled, mode=mode)), "series_key", "left").collect()}
        got = {r.series_key: r for r in FC.with_status(FC.key_summaries(daily, mode=mode)).collect()}
        assert set(got) == set(want) and "gone" not in got and sum(r.forecast_total is not None for r in got.values()) == 12
        for k, w in want.items():
            assert (got[k].observed_days, got[k].forecast, got[k].reason) == (w.observed_days, w.forecast, w.reason)
            for c in ("forecast_total", "trailing_avg_daily", "forecast_avg_daily", "pct_change_vs_trailing"):
                assert (got[k][c] is None) == (w[c] is None) and (w[c] is None or got[k][c] == pytest.approx(w[c], rel=1e-12, abs=1e-12))
    # one exchange by key and day, one by key, no window and no generated days
    plan = FC.key_summaries(daily)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
