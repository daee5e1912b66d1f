"""Registered queries: deterministic twins of model outputs, and display tables, each with its SQL.

The functions that label, summarise, list and format a model's output run here on clusters and scores that
do not depend on an initialisation, so SQL can check every value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, SEGMENT_LABELS
from tillroll.functions.numeric import money_sum_sql
from tillroll.operators import churn as CH
from tillroll.operators import customers as CU
from tillroll.operators import forecast as FC
from tillroll.operators import insights as IN
from tillroll.operators import segments as SG
from tillroll.plans.oracle import with_chain
from tillroll.plans.q_forecast import hw_sql
from tillroll.plans.q_insights import S, T, cur, fixed, num
from tillroll.plans.q_models import CF_SQL, QSEG_SQL, RFM_SQL
from tillroll.plans.q_sales import CUST_SQL
from tillroll.plans.registry import query
from tillroll.plans.stages import customer_frame, featured_frame

SEG_MS = money_sum_sql("Monetary")
KS = (3, 4, 5, 6)
_POOL = ", ".join(f"'{x}'" for x in SEGMENT_LABELS)


def _rfm(spark, sf):
    return customer_frame(spark, sf, "rfm", CU.rfm)


def _labels(spark, sf):
    return customer_frame(spark, sf, "labels", CH.churn_labels)


def _label_sql(k: int) -> str:
    return f"""SELECT {k} AS k, Cluster, Score, list_value({_POOL})[CAST(round_even(pos * (6.0 / (n - 1)), 0) AS INTEGER) + 1] AS Segment
FROM (SELECT *, row_number() OVER (ORDER BY Score, Cluster) - 1 AS pos, count(*) OVER () AS n
      FROM (SELECT Cluster, ((rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0::DOUBLE)
                             + (rank() OVER (ORDER BY f DESC) + (count(*) OVER (PARTITION BY f) - 1) / 2.0::DOUBLE)
                             + (rank() OVER (ORDER BY m DESC) + (count(*) OVER (PARTITION BY m) - 1) / 2.0::DOUBLE)) / 3.0::DOUBLE AS Score
            FROM (SELECT CAST(Frequency % {k} AS INTEGER) AS Cluster, avg(Recency) AS r, avg(Frequency) AS f, avg(Monetary) AS m FROM rfm GROUP BY 1)))"""


@query("segment_labels_by_k", with_chain("featured", " UNION ALL ".join(f"SELECT * FROM ({_label_sql(k)})" for k in KS), extra=RFM_SQL))
def q_segment_labels_by_k(spark, sf):
    """Label slots for 3 to 6 clusters (clusters by order count)."""
    parts = [SG.segment_labels(SG.frequency_clusters(_rfm(spark, sf), k)).select(F.lit(k).alias("k"), "Cluster", "Score", "Segment") for k in KS]
    return reduce(DataFrame.unionByName, parts)


@query("segment_table", with_chain("featured", f"""
SELECT Segment, count(*) AS Customers, round_even(CAST(sum(Recency) AS DOUBLE) / count(*), 1) AS AvgRecencyDays,
       round_even(CAST(sum(Frequency) AS DOUBLE) / count(*), 1) AS AvgFrequency, {cur(f"{SEG_MS} / count(*)")} AS AvgMonetary, {cur(SEG_MS)} AS TotalMonetary,
       CAST(round_even(CAST(100.0 AS DOUBLE) * count(*) / (SELECT count(*) FROM qseg), 1) AS VARCHAR) || '%' AS PctOfCustomers,
       CAST(round_even(CAST(100.0 AS DOUBLE) * {SEG_MS} / (SELECT {SEG_MS} FROM qseg), 1) AS VARCHAR) || '%' AS PctOfRevenue
FROM qseg GROUP BY Segment""", extra=QSEG_SQL))
def q_segment_table(spark, sf):
    return SG.segment_table(SG.segment_summary(SG.quartile_segments(_rfm(spark, sf))))


_RULES = "SELECT *, CASE WHEN IsChurned THEN 0.9 ELSE 0.1 END::DOUBLE AS p FROM labels"


@query("churn_watchlist_rules", with_chain("featured", f"""
SELECT CustomerID, Recency, Frequency, Monetary, p AS ChurnProbability, ChurnRiskLabel FROM ({_RULES})
WHERE ChurnRiskLabel <> 'Churned' ORDER BY p DESC, CustomerID LIMIT 20""", extra=CF_SQL))
def q_churn_watchlist_rules(spark, sf):
    return CH.watchlist(CH.score(None, _labels(spark, sf)))


@query("churn_watchlist_table", with_chain("featured", f"""
SELECT CustomerID, Recency, Frequency, Monetary, CAST(round_even(p * 100, 1) AS VARCHAR) || '%' AS ChurnProbability, ChurnRiskLabel FROM ({_RULES})
WHERE ChurnRiskLabel <> 'Churned' ORDER BY p DESC, CustomerID LIMIT 20""", extra=CF_SQL))
def q_churn_watchlist_table(spark, sf):
    return CH.watchlist_table(CH.watchlist(CH.score(None, _labels(spark, sf))))


@query("insight_segments", with_chain("featured", f"""
SELECT 8 AS ordinal, {T(8)}, printf({S(8)}, Segment, {fixed(f"CAST(100.0 AS DOUBLE) * m / (SELECT {SEG_MS} FROM qseg)", 1)},
       {fixed("CAST(100.0 AS DOUBLE) * n / (SELECT count(*) FROM qseg)", 1)}) AS detail
FROM (SELECT Segment, {SEG_MS} AS m, count(*) AS n FROM qseg GROUP BY 1) ORDER BY m DESC, Segment LIMIT 1""", extra=QSEG_SQL))
def q_insight_segments(spark, sf):
    """The segment insight on quartile segments."""
    made = IN.generate(featured_frame(spark, sf), SG.quartile_segments(_rfm(spark, sf)))
    return IN.by_category(made, "Customers")


@query("kpi_customer_texts", with_chain("featured", f"""
SELECT {num("count(*)")} AS total_customers, {cur("avg(TotalSpend)")} AS avg_spend, {fixed("avg(TotalOrders)", 1)} AS avg_orders,
       {num("count(*) FILTER (WHERE TotalOrders > 1)")} AS repeat_customers FROM cust""", extra=CUST_SQL))
def q_kpi_customer_texts(spark, sf):
    return CU.kpi_texts(customer_frame(spark, sf, "summary", CU.customer_summary))


@query("forecast_card", with_chain("featured", f"""
SELECT series_key, {cur("total")} AS value, CASE WHEN pct >= 0 THEN '+' ELSE '' END || {fixed("pct * 100", 1)} || '% vs trailing avg' AS delta, pct >= 0 AS positive
FROM (SELECT series_key, sum(yhat) FILTER (WHERE IsForecast) AS total,
             coalesce((avg(yhat) FILTER (WHERE IsForecast) - avg(y) FILTER (WHERE NOT IsForecast AND ds > last_ds - INTERVAL 30 DAY))
                      / nullif(avg(y) FILTER (WHERE NOT IsForecast AND ds > last_ds - INTERVAL 30 DAY), 0), 0.0) AS pct
      FROM (SELECT *, max(ds) FILTER (WHERE NOT IsForecast) OVER (PARTITION BY series_key) AS last_ds FROM forecast) GROUP BY series_key)""",
                                  extra=hw_sql("'ALL'", horizon=DEFAULT.forecast_horizon_days), recursive=True))
def q_forecast_card(spark, sf):
    return FC.forecast_card(FC.summary(FC.forecast_demand(featured_frame(spark, sf))))


@query("forecast_long", with_chain("featured", """
SELECT series_key, ds, round(yhat, 4) AS yhat FROM forecast WHERE IsForecast""", extra=hw_sql("Country", horizon=90), recursive=True))
def q_forecast_long(spark, sf):
    """The longest horizon that the page offers (90 days), per country."""
    out = FC.forecast_demand(featured_frame(spark, sf), horizon=90, keys=["Country"]).where("IsForecast")
    return out.select("series_key", "ds", F.round("yhat", 4).alias("yhat"))


