"""Sales analytics.

All are grouped aggregates over the featured lines; grouping keys are low
cardinality (months, countries, seasons, weekdays) or product names, and
Spark's partial aggregation collapses each key per map task before the
shuffle, so a hot country or product never lands whole in one task. Top-k
uses ``orderBy(...).limit(k)``, planned as a per-partition top-k followed by
one small merge.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.functions.numeric import money_sum
from tillroll.config import WEEKDAYS
from tillroll.functions.numeric import safe_divide
from tillroll.operators.quantiles import distinct_counts, with_scalars


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Top-k rows by ``order`` (callers always add a key as the last sort term)."""
    return df.orderBy(*order).limit(k)


def filter_sales(df: DataFrame, countries: Sequence[str] = (),
                 start: dt.date | str | None = None, end: dt.date | str | None = None) -> DataFrame:
    """Country multi-select (empty = all) and inclusive calendar-date range.

    The date bounds are applied as half-open timestamp bounds so Parquet
    row-group statistics can skip data.
    """
    if countries:
        df = df.where(F.col("Country").isin(list(countries)))
    if start is not None:
        df = df.where(F.col("InvoiceDate") >= F.to_timestamp_ntz(F.lit(str(start))))
    if end is not None:
        end_excl = F.to_timestamp_ntz(F.lit(str(end))) + F.make_interval(days=F.lit(1))
        df = df.where(F.col("InvoiceDate") < end_excl)
    return df


def country_list(df: DataFrame) -> DataFrame:
    """P13 domain: the distinct countries offered by the country filter (shown sorted)."""
    return df.select("Country").distinct()


def kpi_home(df: DataFrame) -> DataFrame:
    """A1: revenue, orders, customers, average order value, countries served."""
    agg = with_scalars(df.agg(money_sum("TotalPrice").alias("total_revenue")),
                       distinct_counts(df, ["Invoice", "CustomerID", "Country"],
                                       ["total_orders", "total_customers", "countries"]))
    return agg.withColumn("avg_order_value", safe_divide("total_revenue", "total_orders"))


def kpi_sales(df: DataFrame) -> DataFrame:
    """A3: revenue, orders, AOV and units of a (filtered) frame."""
    agg = df.agg(money_sum("TotalPrice").alias("revenue"),
                 F.count_distinct("Invoice").alias("orders"),
                 F.sum("Quantity").alias("units"))
    return agg.withColumn("avg_order_value", safe_divide("revenue", "orders"))


def revenue_by(df: DataFrame, key: str, value: str = "TotalPrice", name: str = "revenue") -> DataFrame:
    agg = money_sum(value) if value == "TotalPrice" else F.sum(value)
    return df.groupBy(key).agg(agg.alias(name))


def monthly_revenue(df: DataFrame) -> DataFrame:
    """A4."""
    return revenue_by(df, "YearMonth")


def country_revenue(df: DataFrame) -> DataFrame:
    """A5 with each country's share of total revenue (percent)."""
    by = revenue_by(df, "Country")
    total = df.agg(money_sum("TotalPrice").alias("_total"))
    return (with_scalars(by, total)
            .withColumn("share_pct", F.lit(100.0) * F.col("revenue") / F.col("_total"))
            .drop("_total"))


def top_market(df: DataFrame) -> DataFrame:
    """A2: the country with the highest revenue (ties: first by name)."""
    return top_k(revenue_by(df, "Country"), 1, F.desc("revenue"), F.asc("Country"))


def season_revenue(df: DataFrame) -> DataFrame:
    """A6."""
    return revenue_by(df, "Season")


def orders_by_weekday(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """A7 + J7: distinct invoices per weekday, all seven days present (0-filled)."""
    spark = spark or df.sparkSession
    days = spark.createDataFrame([(i, d) for i, d in enumerate(WEEKDAYS)], "DayOfWeekNum INT, DayOfWeek STRING")
    counts = df.groupBy("DayOfWeek").agg(F.count_distinct("Invoice").alias("Orders"))
    # the grouped counts have at most seven rows (one per weekday)
    return (days.join(F.broadcast(counts), "DayOfWeek", "left")
            .select("DayOfWeekNum", "DayOfWeek", F.coalesce("Orders", F.lit(0)).alias("Orders")))


def product_totals(df: DataFrame) -> DataFrame:
    """Revenue and units per product description."""
    return df.groupBy("Description").agg(money_sum("TotalPrice").alias("revenue"),
                                         F.sum("Quantity").alias("units"))


def top_countries(df: DataFrame, k: int = 10) -> DataFrame:
    """K1."""
    return top_k(revenue_by(df, "Country"), k, F.desc("revenue"), F.asc("Country"))


def top_products_revenue(df: DataFrame, k: int = 10) -> DataFrame:
    """K2."""
    return top_k(revenue_by(df, "Description"), k, F.desc("revenue"), F.asc("Description"))


def top_products_units(df: DataFrame, k: int = 10) -> DataFrame:
    """K3."""
    return top_k(revenue_by(df, "Description", "Quantity", "units"), k,
                 F.desc("units"), F.asc("Description"))
