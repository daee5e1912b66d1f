"""Registered queries: forecasting.

Holt-Winters with fixed parameters is checked against a DuckDB recursive
CTE that runs the same recurrence one day per iteration; of the trend and season model, the sums that its fit reads
and the evaluation of given coefficients with the join of actuals are (M8, J2).
"""

from __future__ import annotations

import math

from tillroll.config import DEFAULT
from tillroll.functions.numeric import money_sum_sql
from tillroll.operators import decomposition as DC
from tillroll.operators import forecast as FC
from tillroll.plans.oracle import with_chain
from tillroll.plans.registry import query, rounded
from tillroll.plans.stages import featured_frame

MS = money_sum_sql("TotalPrice")
H = DEFAULT.forecast_horizon_days


def _lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def series_sql(key_expr: str) -> str:
    return f"""hw_daily AS (SELECT {key_expr} AS series_key, CAST(InvoiceDate AS DATE) AS ds, {MS} AS y
             FROM featured GROUP BY 1, 2),
hw_rng AS (SELECT series_key, min(ds) AS lo, max(ds) AS hi FROM hw_daily GROUP BY 1),
hw_days AS (SELECT series_key, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM hw_rng),
hw_j AS (SELECT d.series_key, d.ds, x.y FROM hw_days d LEFT JOIN hw_daily x ON x.series_key = d.series_key AND x.ds = d.ds),
hw_w AS (SELECT *,
   last_value(y IGNORE NULLS) OVER wp AS py, last_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER wp AS pd,
   first_value(y IGNORE NULLS) OVER wn AS ny, first_value(CASE WHEN y IS NOT NULL THEN ds END IGNORE NULLS) OVER wn AS nd
   FROM hw_j
   WINDOW wp AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
          wn AS (PARTITION BY series_key ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT series_key, ds,
                  coalesce(y, (ny - py) / date_diff('day', pd, nd) * date_diff('day', pd, ds) + py) AS y,
                  y IS NOT NULL AS observed, row_number() OVER (PARTITION BY series_key ORDER BY ds) - 1 AS t
           FROM hw_w)"""


def _step_sql(y: str) -> str:
    """The next state of a recursion over h, whose columns are a, c, g, l, b and s0 to s6; sums are written in the order of the operator."""
    new = f"h.a * ({y} - h.s0) + (1.0 - h.a) * (h.l + h.b)"
    return f"""{new}, h.c * (({new}) - h.l) + (1.0 - h.c) * h.b,
        h.s1, h.s2, h.s3, h.s4, h.s5, h.s6, h.g * ({y} - h.l - h.b) + (1.0 - h.g) * h.s0"""


def _grid_sql() -> str:
    """The grid point with the smallest squared error of each key: the recurrence once for every point."""
    points = [(a, c, g) for a in DEFAULT.hw_grid for c in DEFAULT.hw_trend_grid for g in DEFAULT.hw_grid]
    rows = ", ".join(f"({i}, {_lit(a)}, {_lit(c)}, {_lit(g)})" for i, (a, c, g) in enumerate(points))
    return f"""hw_try(series_key, i, t, a, c, g, l, b, s0, s1, s2, s3, s4, s5, s6, sse) AS (
 SELECT series_key, i, -1, a, c, g, l0, b0, s0, s1, s2, s3, s4, s5, s6, CAST(0 AS DOUBLE)
 FROM hw_init CROSS JOIN (VALUES {rows}) AS points(i, a, c, g)
 UNION ALL
 SELECT h.series_key, h.i, h.t + 1, h.a, h.c, h.g, {_step_sql("f.y")},
        h.sse + (f.y - (h.l + h.b + h.s0)) * (f.y - (h.l + h.b + h.s0))
 FROM hw_try h JOIN filled f ON f.series_key = h.series_key AND f.t = h.t + 1),
hw_pick AS (SELECT series_key, a, c, g FROM hw_try
            QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY t DESC, sse, i) = 1)"""


def hw_sql(key_expr: str, alpha=DEFAULT.hw_alpha, beta=DEFAULT.hw_beta, gamma=DEFAULT.hw_gamma,
           horizon: int = H, z: float = DEFAULT.interval_z, grid: bool = False) -> str:
    pick = _grid_sql() if grid else f"hw_pick AS (SELECT series_key, {_lit(alpha)} AS a, {_lit(beta)} AS c, {_lit(gamma)} AS g FROM hw_init)"
    ys = ", ".join(f"max(y) FILTER (WHERE t = {i}) AS y{i}" for i in range(14))
    first = " + ".join(f"y{i}" for i in range(7))
    second = " + ".join(f"y{i}" for i in range(7, 14))
    seas = ", ".join(f"y{i} - l0 AS s{i}" for i in range(7))
    ring_case = " ".join(f"WHEN {i} THEN s{i}" for i in range(7))
    return series_sql(key_expr) + f""",
hw_keys AS (SELECT series_key FROM filled GROUP BY 1 HAVING count(*) FILTER (WHERE observed) >= {DEFAULT.min_forecast_days}),
hw_y AS (SELECT series_key, {ys} FROM filled WHERE series_key IN (SELECT series_key FROM hw_keys) GROUP BY 1),
hw_l AS (SELECT *, ({first}) / {_lit(7)} AS l0 FROM hw_y),
hw_init AS (SELECT series_key, l0, (({second}) / {_lit(7)} - l0) / {_lit(7)} AS b0, {seas} FROM hw_l),
{pick},
hw(series_key, t, a, c, g, l, b, s0, s1, s2, s3, s4, s5, s6, fit) AS (
 SELECT i.series_key, -1, a, c, g, l0, b0, s0, s1, s2, s3, s4, s5, s6, CAST(NULL AS DOUBLE) FROM hw_init i JOIN hw_pick USING (series_key)
 UNION ALL
 SELECT h.series_key, h.t + 1, h.a, h.c, h.g, {_step_sql("f.y")}, h.l + h.b + h.s0
 FROM hw h JOIN filled f ON f.series_key = h.series_key AND f.t = h.t + 1),
hw_hist AS (SELECT f.series_key, f.ds, f.y, h.fit AS yhat FROM filled f
            JOIN hw h ON h.series_key = f.series_key AND h.t = f.t),
hw_sigma AS (SELECT series_key, stddev_samp(y - yhat) AS sigma FROM hw_hist GROUP BY 1),
hw_last AS (SELECT h.*, r.hi FROM hw h JOIN (SELECT series_key, max(t) AS mt FROM hw GROUP BY 1) m
            ON m.series_key = h.series_key AND m.mt = h.t JOIN hw_rng r ON r.series_key = h.series_key),
hw_fut AS (SELECT series_key, CAST(hi + CAST(k AS INTEGER) AS DATE) AS ds, CAST(NULL AS DOUBLE) AS y,
                  greatest(l + k * b + CASE (k - 1) % 7 {ring_case} END, 0.0) AS yhat
           FROM hw_last CROSS JOIN generate_series(1, {horizon}) AS gs(k)),
forecast AS (SELECT u.series_key, u.ds, u.y, u.yhat, greatest(u.yhat - {_lit(z)} * s.sigma, 0.0) AS yhat_lower,
                    u.yhat + {_lit(z)} * s.sigma AS yhat_upper, u.y IS NULL AS IsForecast
             FROM (SELECT * FROM hw_hist UNION ALL SELECT * FROM hw_fut) u JOIN hw_sigma s USING (series_key))"""


def _fc_round(df):
    """Interpolated days sit on half cents, so values are compared at 6 decimals; the band at 3, as SQL's standard deviation differs
    in the last bits from run to run (its threads add in any order), and one bound of sf0.01 lies on a half of the fourth."""
    return rounded(df, y=6, yhat=6, yhat_lower=3, yhat_upper=3)


FC_OUT = """SELECT series_key, ds, round(y, 6) AS y, round(yhat, 6) AS yhat, round(yhat_lower, 3) AS yhat_lower,
       round(yhat_upper, 3) AS yhat_upper, IsForecast FROM forecast"""


def _f(spark, sf):
    return featured_frame(spark, sf)


@query("daily_series", with_chain("featured", "SELECT * FROM hw_daily", extra=series_sql("'ALL'")))
def q_daily_series(spark, sf):
    return FC.daily_series(_f(spark, sf))


@query("daily_series_filled", with_chain("featured", "SELECT series_key, ds, round(y, 6) AS y, observed FROM filled",
                                         extra=series_sql("Country")))
def q_daily_series_filled(spark, sf):
    return rounded(FC.fill_daily(FC.daily_series(_f(spark, sf), keys=["Country"])), ratio=("y",))


@query("forecast", with_chain("featured", FC_OUT, extra=hw_sql("'ALL'"), recursive=True))
def q_forecast(spark, sf):
    return _fc_round(FC.forecast_demand(_f(spark, sf)))


@query("forecast_by_country", with_chain("featured", FC_OUT, extra=hw_sql("Country"), recursive=True))
def q_forecast_by_country(spark, sf):
    return _fc_round(FC.forecast_demand(_f(spark, sf), keys=["Country"]))


SUMMARY_SQL = """
SELECT series_key, round(coalesce(sum(yhat) FILTER (WHERE IsForecast), 0.0), 2) AS forecast_total,
       round(coalesce(avg(y) FILTER (WHERE NOT IsForecast AND ds > last_ds - INTERVAL 30 DAY), 0.0), 2) AS trailing_avg_daily,
       round(coalesce(avg(yhat) FILTER (WHERE IsForecast), 0.0), 2) AS forecast_avg_daily,
       round(coalesce((avg(yhat) FILTER (WHERE IsForecast) - avg(y) FILTER (WHERE NOT IsForecast AND ds > last_ds - INTERVAL 30 DAY))
                      / nullif(avg(y) FILTER (WHERE NOT IsForecast AND ds > last_ds - INTERVAL 30 DAY), 0), 0.0), 6)
         AS pct_change_vs_trailing
FROM (SELECT *, max(ds) FILTER (WHERE NOT IsForecast) OVER (PARTITION BY series_key) AS last_ds FROM forecast)
GROUP BY series_key"""


@query("forecast_summary", with_chain("featured", SUMMARY_SQL, extra=hw_sql("'ALL'"), recursive=True))
def q_forecast_summary(spark, sf):
    s = FC.summary(FC.forecast_demand(_f(spark, sf)))
    return rounded(s, money=("forecast_total", "trailing_avg_daily", "forecast_avg_daily"),
                   ratio=("pct_change_vs_trailing",))


@query("forecast_error", with_chain("featured", """
SELECT series_key, count(*) AS n, round(avg(abs(y - yhat)), 2) AS mae,
       round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / y END) * 100, 6) AS mape
FROM forecast WHERE NOT IsForecast AND y IS NOT NULL GROUP BY series_key HAVING count(*) > 5""",
                                    extra=hw_sql("Country"), recursive=True))
def q_forecast_error(spark, sf):
    e = FC.errors(FC.forecast_demand(_f(spark, sf), keys=["Country"]))
    return rounded(e, money=("mae",), ratio=("mape",))


@query("forecast_table", with_chain("featured", f"""
SELECT series_key, strftime(ds, '%Y-%m-%d') AS Date, '{DEFAULT.currency}' || format('{{:,.0f}}', yhat) AS Forecast,
       '{DEFAULT.currency}' || format('{{:,.0f}}', yhat_lower) AS "Lower Bound",
       '{DEFAULT.currency}' || format('{{:,.0f}}', yhat_upper) AS "Upper Bound"
FROM forecast WHERE IsForecast""", extra=hw_sql("'ALL'"), recursive=True))
def q_forecast_table(spark, sf):
    return FC.forecast_table(FC.forecast_demand(_f(spark, sf)))


@query("forecast_tuned", with_chain("featured", FC_OUT, extra=hw_sql("Country", grid=True), recursive=True))
def q_forecast_tuned(spark, sf):
    """Grid-tuned Holt-Winters per country."""
    return _fc_round(FC.forecast_demand(_f(spark, sf), keys=["Country"], mode="grid"))


@query("forecast_estimated")
def q_forecast_estimated(spark, sf):
    """Holt-Winters per country with parameters and start states estimated (rows-only: the search has no SQL; tests replay the
    recurrence from the estimates and hold its squared error against the grid's)."""
    return _fc_round(FC.forecast_demand(_f(spark, sf), keys=["Country"], mode="estimated"))


def _design_sql(ds: str) -> str:
    """The design row of day ``ds`` of a row that holds its key's range."""
    day = f"CAST(date_diff('day', lo, {ds}) AS DOUBLE)"
    hinges = [f"greatest({day} / span - {_lit(DC.RANGE * j / (DC.CHANGES + 1))}, 0.0)" for j in range(1, DC.CHANGES + 1)]
    weekly = [f"{f}({day} * {_lit(2 * math.pi * k / DC.WEEK)})" for k in range(1, DC.WEEKLY + 1) for f in ("sin", "cos")]
    yearly = [f"CASE WHEN n >= {DC.YEAR_DAYS} THEN {f}({day} * {_lit(2 * math.pi * k / DC.YEAR)}) ELSE 0.0 END"
              for k in range(1, DC.YEARLY + 1) for f in ("sin", "cos")]
    return ", ".join([_lit(1.0), f"{day} / span", *hinges, *weekly, *yearly])


RANGE_SQL = series_sql("Country") + f""",
ts_range AS (SELECT series_key, min(ds) AS lo, max(ds) AS hi, CAST(greatest(date_diff('day', min(ds), max(ds)), 1) AS DOUBLE) AS span,
                    greatest(max(abs(y)), 1.0) AS scale, count(*) AS n
             FROM hw_daily GROUP BY 1 HAVING count(*) >= {DEFAULT.min_forecast_days})"""


@query("trend_season_gram", with_chain("featured", """
SELECT a.series_key, a.i, b.i AS j, round(sum(a.v * b.v), 6) AS value
FROM ts_cell a JOIN ts_cell b ON a.series_key = b.series_key AND a.ds = b.ds AND a.i <= b.i GROUP BY 1, 2, 3""", extra=RANGE_SQL + f""",
ts_row AS (SELECT series_key, ds, [{_design_sql("ds")}, y / scale] AS x FROM hw_daily JOIN ts_range USING (series_key)),
ts_cell AS (SELECT series_key, ds, unnest(x) AS v, unnest(range({DC.WIDTH + 1})) AS i FROM ts_row)"""))
def q_trend_season_gram(spark, sf):
    """The Gram matrix of each country's design rows and y, all that the trend and season fit reads."""
    daily = FC.daily_series(_f(spark, sf), keys=["Country"])
    return rounded(DC.gram_entries(DC.gram(daily)), value=6)


# coefficients that let every term take part: level, slope, slope changes of either sign, all waves
GIVEN = [0.2, 0.1, *[0.02 * (-1) ** j for j in range(DC.CHANGES)], *[0.03 / (1 + j) for j in range(2 * DC.WEEKLY + 2 * DC.YEARLY)]]
GIVEN_SIGMA = 0.05
_HALF = _lit(DEFAULT.interval_z * GIVEN_SIGMA)
_DOT = f"list_sum(list_transform(range(1, {DC.WIDTH + 1}), lambda i: x[i] * [{', '.join(map(_lit, GIVEN))}][i]))"


@query("trend_season_applied", with_chain("featured", f"""
SELECT p.series_key, p.ds, round(d.y, 2) AS y, round(greatest(raw * scale, 0.0), 4) AS yhat, round(greatest((raw - {_HALF}) * scale, 0.0), 4) AS yhat_lower,
       round((raw + {_HALF}) * scale, 4) AS yhat_upper, d.y IS NULL AS IsForecast
FROM (SELECT *, {_DOT} AS raw FROM ts_x) p LEFT JOIN hw_daily d ON d.series_key = p.series_key AND d.ds = p.ds""", extra=RANGE_SQL + f""",
ts_day AS (SELECT series_key, ds FROM hw_daily UNION ALL
           SELECT series_key, CAST(hi + CAST(k AS INTEGER) AS DATE) FROM ts_range CROSS JOIN generate_series(1, {H}) AS gs(k)),
ts_x AS (SELECT series_key, ds, scale, [{_design_sql("ds")}] AS x FROM ts_day JOIN ts_range USING (series_key))"""))
def q_trend_season_applied(spark, sf):
    """The trend and season model of each country with given coefficients: its days and 30 ahead, with the join of actuals."""
    daily = FC.daily_series(_f(spark, sf), keys=["Country"])
    return rounded(DC.predict(DC.with_coefficients(daily, GIVEN, GIVEN_SIGMA), daily), y=2, yhat=4, yhat_lower=4, yhat_upper=4)


@query("forecast_trend_season")
def q_forecast_trend_season(spark, sf):
    """The trend and season model fitted per country from grouped sums (rows-only: tests hold the fit against a plain one;
    ``trend_season_gram`` and ``trend_season_applied`` check its input and its evaluation)."""
    return _fc_round(FC.trend_season(_f(spark, sf), keys=["Country"]))


@query("forecast_summary_by_sku", with_chain("featured", f"""
SELECT k.series_key, k.observed_days, k.observed_days >= {DEFAULT.min_forecast_days} AS forecast,
       CASE WHEN k.observed_days < {DEFAULT.min_forecast_days} THEN 'fewer than {DEFAULT.min_forecast_days} days with sales' END AS reason,
       s.forecast_total, s.trailing_avg_daily, s.forecast_avg_daily, s.pct_change_vs_trailing
FROM (SELECT series_key, count(*) FILTER (WHERE observed) AS observed_days FROM filled GROUP BY 1) k LEFT JOIN ({SUMMARY_SQL}) s USING (series_key)""",
                                            extra=hw_sql("StockCode"), recursive=True))
def q_forecast_summary_by_sku(spark, sf):
    """Holt-Winters per SKU, summarised per SKU; keys that are too short for a forecast are named."""
    keys = FC.with_status(FC.key_summaries(FC.daily_series(_f(spark, sf), keys=["StockCode"])))
    s = rounded(keys, money=("forecast_total", "trailing_avg_daily", "forecast_avg_daily"), ratio=("pct_change_vs_trailing",))
    return s.select("series_key", "observed_days", "forecast", "reason", "forecast_total", "trailing_avg_daily", "forecast_avg_daily",
                    "pct_change_vs_trailing")
