"""Registered queries: inventory.

The oracle builds the zero-filled daily series with explicit gap rows and
takes tail means and a 60-day standard deviation the direct way, so it
checks the gap-free sums formulation used on Spark.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.config import DEFAULT, STOCK_ACTIONS
from tillroll.operators import inventory as INV
from tillroll.plans.oracle import with_chain
from tillroll.plans.registry import query
from tillroll.plans.stages import featured_frame

W, SW, N = DEFAULT.trend_window_days, DEFAULT.std_window_days, DEFAULT.top_n_skus

INV_SQL = f"""tq AS (SELECT StockCode, sum(Quantity) AS TotalQty FROM featured GROUP BY StockCode
       ORDER BY TotalQty DESC, StockCode LIMIT {N}),
dd AS (SELECT StockCode, CAST(InvoiceDate AS DATE) AS day, sum(Quantity) AS q
       FROM featured WHERE StockCode IN (SELECT StockCode FROM tq) GROUP BY 1, 2),
rng AS (SELECT StockCode, min(day) AS first_day, max(day) AS last_day FROM dd GROUP BY 1),
grid AS (SELECT StockCode, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day, last_day
         FROM rng),
filled AS (SELECT g.StockCode, g.day, coalesce(dd.q, 0.0) AS q, date_diff('day', g.day, g.last_day) AS d,
                  count(*) OVER (PARTITION BY g.StockCode) AS span
           FROM grid g LEFT JOIN dd ON dd.StockCode = g.StockCode AND dd.day = g.day),
st AS (SELECT StockCode, any_value(span) AS span, sum(q) AS total,
              CASE WHEN any_value(span) < {W} THEN avg(q) ELSE avg(q) FILTER (WHERE d < {W}) END AS recent,
              avg(q) FILTER (WHERE d >= {W} AND d < {2 * W}) AS prior_slice,
              CASE WHEN any_value(span) >= 2 THEN stddev_samp(q) FILTER (WHERE d < {SW}) ELSE 0.0 END AS std
       FROM filled GROUP BY StockCode),
st2 AS (SELECT *, CASE WHEN span < {W} THEN recent ELSE coalesce(prior_slice, recent) END AS prior FROM st),
st3 AS (SELECT *, CASE WHEN prior <> 0 THEN (recent - prior) / prior ELSE 0.0 END AS pct FROM st2),
sku_descr AS (SELECT StockCode, Description FROM (
           SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY count(*) DESC, Description) AS rn
           FROM featured WHERE StockCode IN (SELECT StockCode FROM tq) GROUP BY StockCode, Description) WHERE rn = 1),
inv AS (
 SELECT s.StockCode, sku_descr.Description, round_even(recent, 2) AS RecentAvgDailyQty,
        round_even(prior, 2) AS PriorAvgDailyQty, round_even(pct, 4) AS PctChange,
        CASE WHEN pct >= {DEFAULT.increase_threshold} THEN 'Increase Stock'
             WHEN pct <= {DEFAULT.reduce_threshold} THEN 'Reduce Stock' ELSE 'Maintain Stock' END AS RecommendedAction,
        round_even(least(0.95, 0.5 + least(abs(pct), 1.0) * 0.4 + CASE WHEN span >= {SW} THEN 0.05 ELSE 0.0 END), 2)
          AS Confidence,
        CAST(round_even(greatest(greatest(recent, 0.0) * {DEFAULT.lead_time_days}
                                 + {DEFAULT.service_level_z} * std * sqrt({float(DEFAULT.lead_time_days)}), 0.0), 0) AS BIGINT)
          AS SuggestedReorderQty,
        CAST(total AS BIGINT) AS TotalHistoricalQty
 FROM st3 s LEFT JOIN sku_descr USING (StockCode))"""


def _inv(spark, sf):
    return INV.recommend(featured_frame(spark, sf))


@query("top_skus", with_chain("featured", "SELECT * FROM tq", extra=INV_SQL))
def q_top_skus(spark, sf):
    return INV.top_skus(featured_frame(spark, sf), N)


@query("sku_description", with_chain("featured", """
SELECT StockCode, Description FROM (
  SELECT StockCode, Description, row_number() OVER (PARTITION BY StockCode ORDER BY count(*) DESC, Description) AS rn
  FROM featured GROUP BY StockCode, Description) WHERE rn = 1"""))
def q_sku_description(spark, sf):
    return INV.sku_description(featured_frame(spark, sf))


@query("sku_trend", with_chain("featured", """
SELECT StockCode, round_even(recent, 6) AS recent, round_even(prior, 6) AS prior, round_even(pct, 6) AS pct,
       span, total AS total_qty FROM st3""", extra=INV_SQL.replace(f"LIMIT {N})", ")", 1)))
def q_sku_trend(spark, sf):
    """Trend of every SKU (recommendations read that of the top N)."""
    t = INV.sku_trend(featured_frame(spark, sf))
    return t.select("StockCode", F.bround("recent", 6).alias("recent"), F.bround("prior", 6).alias("prior"),
                    F.bround("pct", 6).alias("pct"), "span", "total_qty")


@query("inventory", with_chain("featured", "SELECT * FROM inv", extra=INV_SQL))
def q_inventory(spark, sf):
    return _inv(spark, sf)


@query("inventory_summary", with_chain("featured", """
SELECT count(*) FILTER (WHERE RecommendedAction = 'Increase Stock') AS increase_count,
       count(*) FILTER (WHERE RecommendedAction = 'Maintain Stock') AS maintain_count,
       count(*) FILTER (WHERE RecommendedAction = 'Reduce Stock') AS reduce_count,
       CAST(coalesce(sum(SuggestedReorderQty), 0) AS BIGINT) AS total_reorder_units FROM inv""", extra=INV_SQL))
def q_inventory_summary(spark, sf):
    return INV.summary(_inv(spark, sf))


@query("inventory_by_action", with_chain("featured", """
SELECT * FROM inv WHERE RecommendedAction IN ('Reduce Stock', 'Maintain Stock')""", extra=INV_SQL))
def q_inventory_by_action(spark, sf):
    """The action filter with two of the three actions chosen."""
    return INV.by_action(_inv(spark, sf), [STOCK_ACTIONS[2], STOCK_ACTIONS[1]])


@query("inventory_movers", with_chain("featured", """
SELECT * FROM inv ORDER BY abs(PctChange) DESC, StockCode LIMIT 20""", extra=INV_SQL))
def q_inventory_movers(spark, sf):
    return INV.movers(_inv(spark, sf))


@query("inventory_table", with_chain("featured", """
SELECT StockCode, Description, RecentAvgDailyQty, PriorAvgDailyQty,
       CAST(round_even(PctChange * 100, 1) AS VARCHAR) || '%' AS PctChange, RecommendedAction,
       CAST(CAST(round_even(Confidence * 100, 0) AS BIGINT) AS VARCHAR) || '%' AS Confidence, SuggestedReorderQty
FROM inv""", extra=INV_SQL))
def q_inventory_table(spark, sf):
    return INV.table(_inv(spark, sf))
