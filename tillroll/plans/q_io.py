"""Registered queries: sources and sinks as round trips.

Each writes a frame derived from the driver's tables into the shared scratch
folder, reads it back through the source under test and returns a result
that the DuckDB oracle computes straight from the tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillroll.functions.numeric import money_sum, money_sum_sql
from tillroll.operators.customers import customer_summary
from tillroll.plans.oracle import with_chain
from tillroll.plans.q_sales import CUST_SQL
from tillroll.plans.registry import query
from tillroll.plans.stages import featured_frame, stage, staged_clean
from tillroll.session import scratch_path
from tillroll.sources import csv_records, io
from tillroll.sources.fixture import raw_transactions

RAW_COLS = ("Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "CustomerID", "Country",
            "SourceSheet")
SUMMARY_SCHEMA = ("CustomerID STRING, TotalSpend DOUBLE, TotalOrders BIGINT, FirstPurchase TIMESTAMP_NTZ, "
                  "LastPurchase TIMESTAMP_NTZ, Country STRING, AvgOrderValue DOUBLE")


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, "io", f"{name}-{uuid.uuid4().hex[:12]}")


# descriptions with quotes, commas, a line feed and a backslash, as legal CSV fields may hold them
HOSTILE_SQL = "Description || CASE WHEN Quantity > 5 THEN ' \"LARGE\", RED \\ ' || chr(10) || 'box' ELSE '' END"


def _hostile(raw):
    extra = F.when(F.col("Quantity") > 5, F.lit(' "LARGE", RED \\ \nbox')).otherwise(F.lit(""))
    return raw.withColumn("Description", F.concat("Description", extra))


@query("scan_csv", with_chain("clean", "SELECT * FROM clean").replace(
    "std AS (\n SELECT Invoice, StockCode, Description,", f"std AS (\n SELECT Invoice, StockCode, {HOSTILE_SQL} AS Description,"))
def q_scan_csv(spark, sf):
    """Raw export with quoted fields -> CSV -> full cleaning, read in splits. The parsed rows are staged, since the reading of the dates is
    found in them before they are cleaned: the file is parsed once."""
    path = _scratch(spark, "raw-csv")
    io.write_csv(_hostile(raw_transactions(spark, sf, spaced_names=True)), path)
    rows = stage(spark, _scratch(spark, "csv-rows"), lambda: csv_records.read_split(spark, path, encoding="UTF-8"))
    return staged_clean(spark, rows, _scratch(spark, "csv-clean"))


@query("scan_tagged_parts", with_chain("raw", "SELECT * FROM raw"))
def q_scan_tagged_parts(spark, sf):
    """One part folder per sheet; the reader restores SourceSheet from the part name."""
    root = _scratch(spark, "parts")
    raw = raw_transactions(spark, sf)
    for sheet in ("A", "B"):  # a blank in the part's name, as the export's sheets have, and columns in another order
        part = raw.where(F.col("SourceSheet") == sheet).drop("SourceSheet")
        io.write_parquet(part.select(*sorted(part.columns, reverse=sheet == "B")), f"{root}/Year 2009-{sheet}")
    return io.read_tagged_parts(spark, root).withColumn("SourceSheet", F.substring("SourceSheet", 11, 9)).select(*RAW_COLS)


@query("scan_parquet", with_chain("raw", "SELECT * FROM raw"))
def q_scan_parquet(spark, sf):
    path = _scratch(spark, "raw-parquet")
    io.write_parquet(raw_transactions(spark, sf), path)
    return io.read_transactions(spark, path, fmt="parquet").select(*RAW_COLS)


@query("sink_parquet", with_chain("featured", f"""
SELECT YearMonth, count(*) AS lines, {money_sum_sql("TotalPrice")} AS revenue FROM featured GROUP BY YearMonth"""))
def q_sink_parquet(spark, sf):
    """Featured lines written partitioned by YearMonth, read back per partition."""
    path = _scratch(spark, "featured-by-month")
    io.write_parquet(featured_frame(spark, sf), path, partition_by="YearMonth")
    back = io.read_parquet(spark, path)
    return back.groupBy("YearMonth").agg(F.count(F.lit(1)).alias("lines"), money_sum("TotalPrice").alias("revenue"))


@query("sink_csv", with_chain("featured", """
SELECT CustomerID, TotalSpend, TotalOrders, FirstPurchase, LastPurchase, Country,
       TotalSpend / TotalOrders AS AvgOrderValue FROM cust""", extra=CUST_SQL))
def q_sink_csv(spark, sf):
    """Customer summary export (CSV, UTF-8, header) read back with its schema."""
    path = _scratch(spark, "customer-summary-csv")
    io.write_csv(customer_summary(featured_frame(spark, sf)), path)
    return (spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .schema(SUMMARY_SCHEMA).csv(path))
