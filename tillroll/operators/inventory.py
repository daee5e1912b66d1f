"""Inventory recommendations.

Displayed numbers are rounded like numpy (the per-SKU statistics are numpy
floats), i.e. half-to-even on the scaled value.

One grouped pass per SKU replaces the per-SKU loop: the zero-filled daily
means and the 60-day standard deviation need only sums over day offsets
from each SKU's own last sale day, so no gap rows are generated.

With ``d`` = days before the SKU's last day and ``span`` = days from its
first to its last sale (inclusive):
  recent = sum(q) / span                    when span < 30
         = sum(q | d < 30) / 30             otherwise
  prior  = recent                           when span <= 30
         = sum(q | 30 <= d < 60) / min(30, span - 30)
  std    = sample std of the last n = min(60, span) zero-filled days,
           from sum(x) and sum(x^2) over d < n; 0 when n < 2.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, STOCK_ACTIONS, Config
from tillroll.functions.formatting import fmt_plain_float
from tillroll.functions.numeric import np_round


def sku_description(df: DataFrame) -> DataFrame:
    """Each StockCode's most frequent Description (ties: smallest text)."""
    counts = df.groupBy("StockCode", "Description").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy("StockCode").agg(
        F.min_by("Description", F.struct((-F.col("_n")).alias("n"), F.col("Description").alias("d")))
         .alias("Description"))


def top_skus(df: DataFrame, n: int) -> DataFrame:
    """K6: the n StockCodes with the most units (ties: smallest code)."""
    return (df.groupBy("StockCode").agg(F.sum("Quantity").alias("TotalQty"))
              .orderBy(F.desc("TotalQty"), F.asc("StockCode")).limit(n))


#: SKUs that a top-N list may hold; the list is broadcast
MAX_TOP_N = 100_000


def _only(df: DataFrame, top: DataFrame) -> DataFrame:
    """Lines of the SKUs of a bounded top-N frame (semi-join; the list is broadcast)."""
    return df.join(F.broadcast(top.select("StockCode")), "StockCode", "left_semi")


def sku_trend(df: DataFrame, skus: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Per SKU recent / prior daily means, pct change, 60-day std, span, total; of every SKU,
    or of those of a bounded top-N frame."""
    w, sw = cfg.trend_window_days, cfg.std_window_days
    daily = (df if skus is None else _only(df, skus)).groupBy("StockCode", F.to_date("InvoiceDate").alias("day")) \
        .agg(F.sum("Quantity").alias("q"))
    # first/last sale day over each SKU's days (a partition holds one SKU's calendar days)
    per_sku = Window.partitionBy("StockCode")
    d = (daily.withColumns({"_first": F.min("day").over(per_sku), "_last": F.max("day").over(per_sku)})
              .withColumn("d", F.datediff("_last", "day")))
    span = F.datediff("_last", "_first") + 1
    n_std = F.least(F.lit(sw), span)
    g = d.groupBy("StockCode", "_first", "_last").agg(
        F.sum("q").alias("_all"),
        F.sum(F.when(F.col("d") < w, F.col("q")).otherwise(0.0)).alias("_rec"),
        F.sum(F.when((F.col("d") >= w) & (F.col("d") < 2 * w), F.col("q")).otherwise(0.0)).alias("_pri"),
        F.sum(F.when(F.col("d") < n_std, F.col("q")).otherwise(0.0)).alias("_sx"),
        F.sum(F.when(F.col("d") < n_std, F.col("q") * F.col("q")).otherwise(0.0)).alias("_sxx"),
    ).withColumn("span", span)
    sp = F.col("span")
    recent = F.when(sp < w, F.col("_all") / sp).otherwise(F.col("_rec") / F.lit(float(w)))
    prior = F.when(sp <= w, recent).otherwise(F.col("_pri") / F.least(F.lit(w), sp - w))
    g = g.withColumns({"recent": recent, "prior": prior})
    pct = F.when(F.col("prior") != 0, (F.col("recent") - F.col("prior")) / F.col("prior")).otherwise(F.lit(0.0))
    n = F.least(F.lit(sw), sp).cast("double")
    var = (F.col("_sxx") - F.col("_sx") * F.col("_sx") / n) / (n - 1)
    std = F.when(sp >= 2, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(F.lit(0.0))
    return g.select("StockCode", "recent", "prior", pct.alias("pct"), std.alias("std"), "span",
                    F.col("_all").alias("total_qty"))


def action(pct, cfg: Config = DEFAULT):
    """F19."""
    return (F.when(pct >= cfg.increase_threshold, F.lit(STOCK_ACTIONS[0]))
             .when(pct <= cfg.reduce_threshold, F.lit(STOCK_ACTIONS[2]))
             .otherwise(F.lit(STOCK_ACTIONS[1])))


def recommend(df: DataFrame, cfg: Config = DEFAULT, top_n: int | None = None) -> DataFrame:
    """Recommendations for the top-N SKUs by units, ordered by units."""
    top_n = top_n or cfg.top_n_skus
    if top_n > MAX_TOP_N:
        raise ValueError(f"top_n is {top_n}; a top-N list holds {MAX_TOP_N} SKUs at most (sku_trend has all)")
    top = top_skus(df, top_n)
    t = sku_trend(df, top, cfg)
    desc = sku_description(_only(df, top))
    pct = F.col("pct")
    conf = F.least(F.lit(0.95), F.lit(0.5) + F.least(F.abs(pct), F.lit(1.0)) * 0.4
                   + F.when(F.col("span") >= cfg.std_window_days, F.lit(0.05)).otherwise(F.lit(0.0)))
    safety = F.lit(cfg.service_level_z) * F.col("std") * F.sqrt(F.lit(float(cfg.lead_time_days)))
    reorder = F.greatest(F.col("recent"), F.lit(0.0)) * cfg.lead_time_days + safety
    # one row a listed SKU, MAX_TOP_N at most
    return (t.join(F.broadcast(desc), "StockCode", "left")
             .select("StockCode", "Description",
                     np_round("recent", 2).alias("RecentAvgDailyQty"),
                     np_round("prior", 2).alias("PriorAvgDailyQty"),
                     np_round(pct, 4).alias("PctChange"),
                     action(pct, cfg).alias("RecommendedAction"),
                     np_round(conf, 2).alias("Confidence"),
                     np_round(F.greatest(reorder, F.lit(0.0)), 0).cast("bigint").alias("SuggestedReorderQty"),
                     F.col("total_qty").cast("bigint").alias("TotalHistoricalQty")))


def summary(inv: DataFrame) -> DataFrame:
    """SKUs per action and total reorder units."""
    a = F.col("RecommendedAction")
    return inv.agg(F.count_if(a == STOCK_ACTIONS[0]).alias("increase_count"),
                   F.count_if(a == STOCK_ACTIONS[1]).alias("maintain_count"),
                   F.count_if(a == STOCK_ACTIONS[2]).alias("reduce_count"),
                   F.coalesce(F.sum("SuggestedReorderQty"), F.lit(0)).cast("bigint").alias("total_reorder_units"))


def by_action(inv: DataFrame, actions: Sequence[str] = STOCK_ACTIONS) -> DataFrame:
    """P15."""
    return inv.where(F.col("RecommendedAction").isin(list(actions)))


def movers(inv: DataFrame, k: int = 20) -> DataFrame:
    """K7: the k largest absolute changes (shown ordered by signed change)."""
    return inv.orderBy(F.desc(F.abs("PctChange")), F.asc("StockCode")).limit(k)


def table(inv: DataFrame) -> DataFrame:
    """P20: display table, percent texts for change and confidence."""
    return inv.select("StockCode", "Description", "RecentAvgDailyQty", "PriorAvgDailyQty",
                      F.concat(fmt_plain_float(F.col("PctChange") * 100, 1), F.lit("%")).alias("PctChange"),
                      "RecommendedAction",
                      F.concat(np_round(F.col("Confidence") * 100, 0).cast("bigint").cast("string"),
                               F.lit("%")).alias("Confidence"),
                      "SuggestedReorderQty")
