"""Customer analytics (A10-A14, K4-K5, K11, M20) and the shared customer aggregate.

Every per-customer table is one ``groupBy("CustomerID")``. The distinct
invoice count is planned by Spark as an aggregate on (customer, invoice)
followed by one on customer; both are partially aggregated map-side, so a
customer holding a third of all lines still shuffles one row per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.formatting import fmt_currency, fmt_fixed, fmt_number
from tillroll.functions.numeric import money_sum
from tillroll.functions.calendar import elapsed_days
from tillroll.functions.numeric import safe_divide
from tillroll.operators.features import snapshot_row
from tillroll.operators.quantiles import quantile_row, with_scalars
from tillroll.operators.sales import top_k


def customer_summary(df: DataFrame) -> DataFrame:
    """Spend, orders, first/last purchase, first country, AOV per customer.

    "First" country is the country of the customer's earliest line (ties by
    invoice, then country), which is stable under any partitioning.
    """
    agg = df.groupBy("CustomerID").agg(
        money_sum("TotalPrice").alias("TotalSpend"),
        F.count_distinct("Invoice").alias("TotalOrders"),
        F.min("InvoiceDate").alias("FirstPurchase"),
        F.max("InvoiceDate").alias("LastPurchase"),
        F.min_by("Country", F.struct("InvoiceDate", "Invoice", "Country")).alias("Country"),
    )
    return agg.withColumn("AvgOrderValue", F.col("TotalSpend") / F.col("TotalOrders"))


def kpi_customers(summary: DataFrame) -> DataFrame:
    """Customers, mean spend, mean orders, repeat customers."""
    return summary.agg(F.count(F.lit(1)).alias("total_customers"),
                       F.avg("TotalSpend").alias("avg_spend"),
                       F.avg("TotalOrders").alias("avg_orders"),
                       F.count_if(F.col("TotalOrders") > 1).alias("repeat_customers"))


def customers_by_country(summary: DataFrame) -> DataFrame:
    """Distinct customers per (first) country."""
    return summary.groupBy("Country").agg(F.count_distinct("CustomerID").alias("customers"))


def top_customers(summary: DataFrame, k: int = 15) -> DataFrame:
    """K4."""
    return top_k(summary.select("CustomerID", "TotalSpend"), k,
                 F.desc("TotalSpend"), F.asc("CustomerID"))


def top_customer_countries(summary: DataFrame, k: int = 10) -> DataFrame:
    """K5."""
    return top_k(customers_by_country(summary), k, F.desc("customers"), F.asc("Country"))


def rfm(df: DataFrame) -> DataFrame:
    """A10: Recency (days to max+1 day), Frequency (distinct invoices), Monetary; Monetary > 0."""
    agg = df.groupBy("CustomerID").agg(F.max("InvoiceDate").alias("_last"),
                                       F.count_distinct("Invoice").alias("Frequency"),
                                       money_sum("TotalPrice").alias("Monetary"))
    return (with_scalars(agg, snapshot_row(df))
            .select("CustomerID", elapsed_days("_last", "snapshot").alias("Recency"),
                    "Frequency", "Monetary")
            .where(F.col("Monetary") > 0))


def customer_features_at(df: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Churn features from lines on or before a snapshot (one-row frame, column ``snapshot``).

    Only customers seen by the snapshot appear (the documented intent; T1).
    """
    hist = with_scalars(df, snapshot).where(F.col("InvoiceDate") <= F.col("snapshot"))
    g = hist.groupBy("CustomerID").agg(
        F.max("InvoiceDate").alias("_last"), F.min("InvoiceDate").alias("_first"),
        F.count_distinct("Invoice").alias("Frequency"), money_sum("TotalPrice").alias("Monetary"),
        F.first("snapshot").alias("_snap"))
    return g.select(
        "CustomerID",
        elapsed_days("_last", "_snap").alias("Recency"),
        "Frequency", "Monetary",
        safe_divide("Monetary", "Frequency").alias("AvgOrderValue"),
        F.greatest(elapsed_days("_first", "_snap"), F.lit(1)).alias("TenureDays"),
    )


def clv_scatter(df: DataFrame, q: float = 0.97) -> DataFrame:
    """One row per customer (customer columns are constant per customer),
    keeping CLV <= its 0.97 quantile."""
    per = df.groupBy("CustomerID").agg(
        F.first("CustomerLifetimeValue").alias("CustomerLifetimeValue"),
        F.first("PurchaseFrequency").alias("PurchaseFrequency"),
        F.first("CustomerTotalSpend").alias("CustomerTotalSpend"))
    cap = quantile_row(per, "CustomerLifetimeValue", [q], ["_cap"])
    return with_scalars(per, cap).where(F.col("CustomerLifetimeValue") <= F.col("_cap")).drop("_cap")


def kpi_texts(summary: DataFrame, symbol: str = "£") -> DataFrame:
    """Display form of the customer KPIs."""
    return kpi_customers(summary).select(
        fmt_number("total_customers").alias("total_customers"), fmt_currency("avg_spend", symbol).alias("avg_spend"),
        fmt_fixed("avg_orders", 1, thousands=False).alias("avg_orders"), fmt_number("repeat_customers").alias("repeat_customers"))
