import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import decomposition as DC
from tillroll.operators import forecast as FC

D0 = dt.date(2010, 3, 1)
SCHEMA = "series_key STRING, ds DATE, y DOUBLE"


def plain_design(days, span, yearly):
    t = days / span
    cols = [np.ones_like(t), t] + [np.maximum(t - 0.8 * j / 26, 0) for j in range(1, 26)]
    for period, order, used in ((7.0, 3, True), (365.25, 10, yearly)):
        for k in range(1, order + 1):
            w = 2 * np.pi * k * days / period
            cols += [np.sin(w) * used, np.cos(w) * used]
    return np.stack(cols, axis=1)


def series(n, seed, slope_after=None):
    rng = np.random.default_rng(seed)
    days = np.arange(n, dtype=float)
    y = 100 + 0.1 * days + 10 * np.sin(2 * np.pi * days / 7) + rng.normal(0, 2, n)
    if slope_after is not None:
        y += 0.8 * np.maximum(days - slope_after, 0)
    return days, y


@pytest.fixture(scope="module")
def daily(spark):
    made = {"long": series(500, 1, 200), "short": series(60, 2), "few": series(13, 3), "zero": (np.arange(30.0), np.zeros(30))}
    rows = [(k, D0 + dt.timedelta(days=int(d)), float(v)) for k, (ds, ys) in made.items() for d, v in zip(ds, ys, strict=True) if k != "long" or d % 11 != 3]
    return spark.createDataFrame(rows + [("long", D0 + dt.timedelta(days=3), None)], SCHEMA).repartition(5)


def of(daily, key):
    rows = sorted((r.ds, r.y) for r in daily.where((F.col("series_key") == key) & F.col("y").isNotNull()).collect())
    return np.array([(d - rows[0][0]).days for d, _ in rows], float), np.array([y for _, y in rows])


@pytest.mark.parametrize("key", ["long", "short"])
def test_fit_equals_one_on_the_whole_series(spark, daily, key):
    days, y = of(daily, key)
    scale, span, n = np.abs(y).max(), days[-1], len(y)
    x, v = plain_design(days, span, n >= 365), y / np.abs(y).max()
    row = DC.fit(DC.gram(daily), 5).where(F.col("series_key") == key).first()
    assert (row.n, row.span, row.scale) == (n, span, scale)
    # the same rounds on the rows themselves, as least squares of stacked prior rows
    prior = np.r_[np.full(2, 5.0 ** -2), np.full(25, 0.05 ** -2), np.full(26, 10.0 ** -2)]
    var, before = (v @ v) / n, np.inf
    for _ in range(DC.ROUNDS):
        beta = np.linalg.lstsq(np.vstack([x, np.diag(np.sqrt(var * prior))]), np.r_[v, np.zeros(len(prior))], rcond=None)[0]
        var = ((v - x @ beta) ** 2).mean()
        prior[2:27] = 1 / (0.05 * np.maximum(np.abs(beta[2:27]), DC.SMALLEST))
        if np.max(np.abs(beta - before)) < DC.RESTS:
            break
        before = beta
    assert x @ np.array(row.beta) == pytest.approx(x @ beta, abs=1e-6)
    assert row.sigma == pytest.approx(np.sqrt(var), rel=1e-4)


def test_slope_changes_meet_the_laplace_prior_and_the_trend_is_met(spark, daily):
    days, y = of(daily, "long")
    row = DC.fit(DC.gram(daily), 5).where("series_key = 'long'").first()
    beta, x, v = np.array(row.beta), plain_design(days, days[-1], True), y / np.abs(y).max()
    changes = beta[2:27]
    # where the density is highest, its slope in a change is 1 / 0.05 against the change's sign, and no steeper at a change of zero
    pull = x[:, 2:27].T @ (v - x @ beta) / row.sigma ** 2
    used = np.abs(changes) > 1e-3
    assert 1 <= used.sum() <= 12
    assert pull[used] == pytest.approx(np.sign(changes[used]) / 0.05, rel=0.02)
    assert np.abs(pull).max() <= 1.02 / 0.05
    # one change of slope was made, at day 200 of 499
    assert abs(np.average(np.arange(1, 26) * 0.8 / 26, weights=np.abs(changes)) - 200 / days[-1]) < 0.08
    fc = {r.ds: r for r in DC.predict(DC.fit(DC.gram(daily), 30), daily).where("series_key = 'long' and IsForecast").collect()}
    assert len(fc) == 30
    for ds, r in fc.items():
        d = (ds - D0).days
        assert r.yhat == pytest.approx(100 + 0.1 * d + 10 * np.sin(2 * np.pi * d / 7) + 0.8 * (d - 200), abs=12)
        assert r.yhat_lower < r.yhat < r.yhat_upper


def test_rows_actuals_and_odd_series(spark, daily):
    fc = DC.predict(DC.fit(DC.gram(daily), 9), daily, 9)
    got = {r.series_key: r for r in fc.groupBy("series_key").agg(F.count_if("IsForecast").alias("ahead"), F.count("y").alias("past"),
                                                                 F.min("yhat_lower").alias("low"), F.max(F.abs("yhat")).alias("top")).collect()}
    assert set(got) == {"long", "short", "zero"}            # 13 days are too few
    for key in got:
        assert (got[key].ahead, got[key].past) == (9, len(of(daily, key)[1])) and got[key].low >= 0
    assert got["zero"].top == pytest.approx(0, abs=1e-9)
    assert DC.predict(DC.fit(DC.gram(daily.limit(0)), 9), daily.limit(0), 9).count() == 0
    again = DC.predict(DC.fit(DC.gram(daily.repartition(2)), 9), daily, 9)
    key = ["series_key", "ds"]
    a, b = (f.orderBy(*key).collect() for f in (fc, again))
    assert [r.yhat_upper for r in a] == pytest.approx([r.yhat_upper for r in b], rel=1e-5)


def test_the_plan_has_no_pandas_group(spark, featured_small):
    plan = FC.trend_season(featured_small, 7, keys=["Country"])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("MapInArrow") == 2            # partial sums, fits
