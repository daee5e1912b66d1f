"""Feature operators (F1-F8, W1, A9, J1): clean lines -> 28-column featured lines.

Invoice and customer totals are grouped aggregates joined back, not
unbounded window partitions: the partial (map-side) aggregate absorbs a hot
invoice or customer, and AQE's skew-join splitting handles a hot key on the
line side of the join, whereas a window would hold the whole hot group in
one task. Both totals meet on the different (invoice, customer) pairs first, so
the lines themselves are shuffled once, and before the columns that follow from
a line alone are added to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import money_sum
from tillroll.config import DEFAULT, Config
from tillroll.functions.calendar import (day_name, day_number, elapsed_days, month_name,
                                         season, year_month)
from tillroll.operators.quantiles import quantile_row, with_scalars

FEATURED_EXTRA = ("Year", "Month", "MonthName", "Quarter", "DayOfWeek", "DayOfWeekNum", "Hour",
                  "Season", "YearMonth", "DemandLevel", "InvoiceTotalValue",
                  "InvoiceTotalQuantity", "AverageOrderValue", "PurchaseFrequency",
                  "CustomerLifetimeValue", "RecencyDays", "CustomerTotalOrders",
                  "CustomerTotalSpend")


def calendar_features(df: DataFrame) -> DataFrame:
    """Nine calendar columns from InvoiceDate."""
    ts = F.col("InvoiceDate")
    return df.withColumns({
        "Year": F.year(ts),
        "Month": F.month(ts),
        "MonthName": month_name(ts),
        "Quarter": F.quarter(ts),
        "DayOfWeek": day_name(ts),
        "DayOfWeekNum": day_number(ts),
        "Hour": F.hour(ts),
        "Season": season(F.month(ts)),
        "YearMonth": year_month(ts),
    })


def demand_level(df: DataFrame, cfg: Config = DEFAULT, of: DataFrame | None = None) -> DataFrame:
    """F8: Low (<= q.33), Medium (<= q.67), High, on the capped Quantity; the quantiles are those of ``of`` (``df`` unless given)."""
    qs = quantile_row(df if of is None else of, "Quantity", [cfg.demand_low_q, cfg.demand_high_q], ["_lo", "_hi"])
    lvl = (F.when(F.col("Quantity") <= F.col("_lo"), F.lit("Low"))
            .when(F.col("Quantity") <= F.col("_hi"), F.lit("Medium"))
            .otherwise(F.lit("High")))
    return with_scalars(df, qs).withColumn("DemandLevel", lvl).drop("_lo", "_hi")


def invoice_totals(df: DataFrame) -> DataFrame:
    """Invoice -> InvoiceTotalValue, InvoiceTotalQuantity."""
    return df.groupBy("Invoice").agg(
        money_sum("TotalPrice").alias("InvoiceTotalValue"),
        F.sum("Quantity").alias("InvoiceTotalQuantity"))


def order_value(df: DataFrame) -> DataFrame:
    """Invoice totals repeated on every line of the invoice."""
    return df.join(invoice_totals(df), "Invoice", "left")


def snapshot_row(df: DataFrame, days: int = 1, name: str = "snapshot") -> DataFrame:
    """One row: max(InvoiceDate) + ``days`` (negative for a look-back)."""
    return df.agg((F.max("InvoiceDate") + F.make_interval(days=F.lit(days))).alias(name))


def customer_value(df: DataFrame) -> DataFrame:
    """One row per customer with tenure, recency, AOV, monthly frequency and CLV."""
    cust = df.groupBy("CustomerID").agg(
        F.min("InvoiceDate").alias("FirstPurchaseDate"),
        F.max("InvoiceDate").alias("LastPurchaseDate"),
        F.count_distinct("Invoice").alias("TotalOrders"),
        money_sum("TotalPrice").alias("TotalSpend"),
        F.sum("Quantity").alias("TotalItemsPurchased"),
    )
    cust = with_scalars(cust, snapshot_row(df))
    tenure = F.greatest(elapsed_days("FirstPurchaseDate", "snapshot"), F.lit(1))
    months = tenure / F.lit(30.0)
    aov = F.try_divide(F.col("TotalSpend"), F.nullif(F.col("TotalOrders"), F.lit(0)))
    freq = F.col("TotalOrders") / months
    return cust.select(
        "CustomerID", "FirstPurchaseDate", "LastPurchaseDate", "TotalOrders", "TotalSpend",
        "TotalItemsPurchased",
        tenure.alias("CustomerTenureDays"),
        elapsed_days("LastPurchaseDate", "snapshot").alias("RecencyDays"),
        F.coalesce(aov, F.lit(0.0)).alias("AverageOrderValue"),
        F.coalesce(freq, F.lit(0.0)).alias("PurchaseFrequency"),
        F.coalesce(aov * freq * months, F.lit(0.0)).alias("CustomerLifetimeValue"),
    )


def _line_columns(df: DataFrame) -> DataFrame:
    """The six columns of :func:`customer_value` that go onto the lines (two renamed)."""
    return customer_value(df).select(
        "CustomerID", "AverageOrderValue", "PurchaseFrequency", "CustomerLifetimeValue",
        "RecencyDays", F.col("TotalOrders").alias("CustomerTotalOrders"),
        F.col("TotalSpend").alias("CustomerTotalSpend"))


def customer_value_features(df: DataFrame) -> DataFrame:
    """Six customer aggregates joined back onto every line (two renamed)."""
    return df.join(_line_columns(df), "CustomerID", "left")


def order_and_customer_value(df: DataFrame) -> DataFrame:
    """W1 and J1 with one shuffle of the lines: what :func:`order_value` and :func:`customer_value_features` add, joined to the
    different (invoice, customer) pairs and from there, nulls equal, to the lines."""
    pairs = (df.select("Invoice", "CustomerID").distinct()
             .join(invoice_totals(df), "Invoice", "left").join(_line_columns(df), "CustomerID", "left")
             .withColumnsRenamed({"Invoice": "_invoice", "CustomerID": "_customer"}))
    same = F.col("CustomerID").eqNullSafe(F.col("_customer")) & F.col("Invoice").eqNullSafe(F.col("_invoice"))
    return df.join(pairs, same, "left").drop("_invoice", "_customer")


def engineer(clean_df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Clean lines -> featured lines (clean columns + 18 features, 28 columns)."""
    df = order_and_customer_value(clean_df)
    df = calendar_features(df)
    # the cuts are taken from the clean lines, not from the joined ones
    df = demand_level(df, cfg, of=clean_df)
    return df.select(*clean_df.columns, *FEATURED_EXTRA)
