"""Registered queries: cleaning steps (P1-P12) and features."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.operators import cleaning as C
from tillroll.operators import features as FE
from tillroll.operators.quantiles import with_scalars
from tillroll.plans.oracle import with_chain
from tillroll.plans.registry import query
from tillroll.plans.stages import clean_frame, featured_frame, raw_frame, staged_clean_report
from tillroll.session import scratch_path

STEP_COLS = "Invoice, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, SourceSheet"


def _raw(spark, sf):
    return raw_frame(spark, sf, spaced_names=True)


@query("standardize", with_chain("raw", f"SELECT {STEP_COLS} FROM std", extra=""" std AS (
 SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price AS UnitPrice, CustomerID, Country, SourceSheet FROM raw)"""))
def q_standardize(spark, sf):
    return C.standardize(_raw(spark, sf)).select(*STEP_COLS.split(", "))


@query("dedup", with_chain("clean", f"SELECT {STEP_COLS} FROM dedup"))
def q_dedup(spark, sf):
    return C.dedup(C.standardize(_raw(spark, sf))).select(*STEP_COLS.split(", "))


@query("drop_missing_customer", with_chain("clean", f"SELECT {STEP_COLS} FROM has_cust"))
def q_drop_missing(spark, sf):
    return C.drop_missing_customer(C.dedup(C.standardize(_raw(spark, sf)))).select(*STEP_COLS.split(", "))


@query("clean_description", with_chain("clean", f"SELECT {STEP_COLS} FROM cust_txt"))
def q_clean_description(spark, sf):
    df = C.drop_missing_customer(C.dedup(C.standardize(_raw(spark, sf))))
    return C.customer_id_text(C.clean_description(df)).select(*STEP_COLS.split(", "))


@query("parse_dates", with_chain("clean", f"SELECT {STEP_COLS} FROM dated"))
def q_parse_dates(spark, sf):
    df = C.drop_missing_customer(C.dedup(C.standardize(_raw(spark, sf))))
    return C.parse_dates(C.customer_id_text(C.clean_description(df))).select(*STEP_COLS.split(", "))


@query("flag_cancellations", with_chain("clean", """
SELECT IsCancelled, count(*) AS lines, CAST(sum(Quantity) AS DOUBLE) AS quantity FROM flagged GROUP BY IsCancelled"""))
def q_flag_cancellations(spark, sf):
    df = C.drop_missing_customer(C.dedup(C.standardize(_raw(spark, sf))))
    df = C.flag_cancellations(C.parse_dates(C.customer_id_text(C.clean_description(df))))
    return df.groupBy("IsCancelled").agg(F.count(F.lit(1)).alias("lines"), F.sum("Quantity").alias("quantity"))


@query("valid_sales", with_chain("clean", f"SELECT {STEP_COLS}, IsCancelled FROM valid"))
def q_valid_sales(spark, sf):
    df = C.drop_missing_customer(C.dedup(C.standardize(_raw(spark, sf))))
    df = C.valid_sales(C.flag_cancellations(C.parse_dates(C.customer_id_text(C.clean_description(df)))))
    return df.select(*STEP_COLS.split(", "), "IsCancelled")


@query("drop_non_products", with_chain("clean", f"SELECT {STEP_COLS}, IsCancelled FROM products"))
def q_drop_non_products(spark, sf):
    return C.pre_cap(_raw(spark, sf)).select(*STEP_COLS.split(", "), "IsCancelled")


@query("winsorize", with_chain("clean", """
SELECT q_cap, p_cap, (SELECT count(*) FROM capped) AS lines,
       (SELECT count(*) FROM products, caps WHERE Quantity > q_cap) AS quantity_capped,
       (SELECT count(*) FROM products, caps WHERE UnitPrice > p_cap) AS price_capped
FROM caps"""))
def q_winsorize(spark, sf):
    pre = C.pre_cap(_raw(spark, sf))
    caps = C.cap_values(pre)
    flags = with_scalars(pre, caps).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(F.col("Quantity") > F.col("q_cap")).alias("quantity_capped"),
        F.count_if(F.col("UnitPrice") > F.col("p_cap")).alias("price_capped"))
    return with_scalars(caps, flags)


@query("clean", with_chain("clean", "SELECT * FROM clean"))
def q_clean(spark, sf):
    return clean_frame(spark, sf)


REPORT_SQL = with_chain("clean", """
SELECT (SELECT count(*) FROM raw) AS start_rows,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM dedup) AS duplicates_removed,
       (SELECT count(*) FROM dedup) - (SELECT count(*) FROM has_cust) AS missing_customer_removed,
       (SELECT count(*) FROM has_cust) - (SELECT count(*) FROM cust_txt) AS empty_description_removed,
       (SELECT count(*) FROM cust_txt) - (SELECT count(*) FROM dated) AS bad_date_removed,
       (SELECT count(*) FROM flagged) - (SELECT count(*) FROM valid) AS invalid_removed,
       (SELECT count(*) FROM valid) - (SELECT count(*) FROM products) AS non_product_removed,
       (SELECT count(*) FROM clean) AS end_rows,
       (SELECT count(*) FROM raw) - (SELECT count(*) FROM clean) AS rows_removed,
       CAST(format('{:.2f}', CAST(100.0 AS DOUBLE) * ((SELECT count(*) FROM raw) - (SELECT count(*) FROM clean))
                  / (SELECT count(*) FROM raw)) AS DOUBLE) AS pct_removed""")


@query("clean_report", REPORT_SQL)
def q_clean_report(spark, sf):
    return C.clean_report(_raw(spark, sf))


@query("clean_report_staged", REPORT_SQL)
def q_clean_report_staged(spark, sf):
    """The report that a staged cleaning of the whole export leaves behind."""
    return staged_clean_report(spark, _raw(spark, sf), scratch_path(spark, "stages", f"judged-{uuid.uuid4().hex[:12]}"))[1]


# --- features ---------------------------------------------------------------

@query("calendar_features", with_chain("featured", """
SELECT Invoice, StockCode, InvoiceDate, Year, Month, MonthName, Quarter, DayOfWeek, DayOfWeekNum, Hour, Season, YearMonth
FROM featured"""))
def q_calendar(spark, sf):
    return featured_frame(spark, sf).select(
        "Invoice", "StockCode", "InvoiceDate", "Year", "Month", "MonthName", "Quarter", "DayOfWeek",
        "DayOfWeekNum", "Hour", "Season", "YearMonth")


@query("demand_level", with_chain("featured", """
SELECT DemandLevel, count(*) AS lines, min(Quantity) AS min_qty, max(Quantity) AS max_qty
FROM featured GROUP BY DemandLevel"""))
def q_demand_level(spark, sf):
    return featured_frame(spark, sf).groupBy("DemandLevel").agg(
        F.count(F.lit(1)).alias("lines"), F.min("Quantity").alias("min_qty"), F.max("Quantity").alias("max_qty"))


@query("order_value", with_chain("featured", """
SELECT DISTINCT Invoice, InvoiceTotalValue, InvoiceTotalQuantity FROM featured"""))
def q_order_value(spark, sf):
    return featured_frame(spark, sf).select(
        "Invoice", "InvoiceTotalValue", "InvoiceTotalQuantity").distinct()


@query("customer_value", with_chain("featured", """
SELECT CustomerID, FirstPurchaseDate, LastPurchaseDate, TotalOrders, TotalSpend,
       TotalItemsPurchased, CustomerTenureDays, RecencyDays, AverageOrderValue,
       PurchaseFrequency, CustomerLifetimeValue
FROM cust_val"""))
def q_customer_value(spark, sf):
    cv = FE.customer_value(featured_frame(spark, sf).select(*[c for c in (
        "Invoice", "InvoiceDate", "CustomerID", "TotalPrice", "Quantity")]))
    return cv


@query("customer_value_features", with_chain("featured", """
SELECT Invoice, StockCode, CustomerID, AverageOrderValue, PurchaseFrequency, CustomerLifetimeValue,
       RecencyDays, CustomerTotalOrders, CustomerTotalSpend
FROM featured"""))
def q_customer_value_features(spark, sf):
    f = featured_frame(spark, sf)
    return f.select("Invoice", "StockCode", "CustomerID", "AverageOrderValue", "PurchaseFrequency",
                    "CustomerLifetimeValue", "RecencyDays", "CustomerTotalOrders", "CustomerTotalSpend")
