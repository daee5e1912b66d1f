"""Raw-transaction input derived from the driver's star-schema tables.

One order line becomes one invoice line. Dirt (cancellations, postage lines,
blank and missing descriptions, missing customers, zero prices, padded
country names, outlier quantities, duplicated invoices) is injected by key
arithmetic so Spark and DuckDB derive the very same rows; the modulo terms
select which lines get dirty, they never drop lines. Every line of every
order is kept, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str, spaced_names: bool = False) -> DataFrame:
    """Raw export rows: Invoice, StockCode, Description, Quantity, InvoiceDate,
    Price, CustomerID (``Customer ID`` when ``spaced_names``), Country, SourceSheet."""
    # cancellation is told before the joins, so its two texts don't travel
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice",
        ((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("cancelled"))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    # nation is a fixed 25-row dimension at every scale factor
    n = F.broadcast(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")

    # orders meet their customers first: the lines are shuffled by order and by part, never by customer, and get names of nations last
    o = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "o_orderdate", "c_nationkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(n, o.c_nationkey == n.n_nationkey)

    cancelled = F.col("cancelled")
    ok = F.col("o_orderkey").cast("string")
    pk = F.col("l_partkey")
    qty = F.col("l_quantity")
    base = j.select(
        F.when(cancelled, F.concat(F.lit("C"), ok)).otherwise(ok).alias("Invoice"),
        F.when((F.col("l_linenumber") == 7) & (pk % 10 == 0), F.lit("post"))
         .otherwise(pk.cast("string")).alias("StockCode"),
        F.when(pk % 97 == 0, F.lit(None).cast("string"))
         .when(pk % 89 == 0, F.lit("  "))
         .when((F.col("l_linenumber") == 3) & (pk % 5 == 0), F.concat(F.upper("p_name"), F.lit("  ")))
         .otherwise(F.concat_ws(" ", "p_name", "p_brand")).alias("Description"),
        F.when(cancelled, -qty)
         .when((pk % 199 == 0) & (F.col("l_linenumber") == 1), qty * 100)
         .otherwise(qty).alias("Quantity"),
        F.timestamp_add("HOUR", (F.col("o_orderkey") % 24).cast("int"), F.col("o_orderdate"))
         .alias("InvoiceDate"),
        F.when(pk % 101 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice") / qty).alias("Price"),
        F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("o_custkey").cast("double")).alias("CustomerID"),
        F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit(" "), F.col("n_name")))
         .otherwise(F.col("n_name")).alias("Country"),
        F.when(F.year("o_orderdate") < 1999, F.lit("A")).otherwise(F.lit("B")).alias("SourceSheet"),
        # every 40th order arrives twice (exact duplicate lines for dedup)
        F.when(F.col("o_orderkey") % 40 == 0, F.lit(2)).otherwise(F.lit(1)).alias("_copies"),
    )
    raw = base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))) \
              .drop("_copies", "_copy")
    if spaced_names:
        raw = raw.withColumnsRenamed({"CustomerID": "Customer ID"})
    return raw


def duckdb_raw_ctes() -> str:
    """The same rows as :func:`raw_transactions`, as DuckDB CTE text (``base``, ``raw``)."""
    return """base AS (
 SELECT CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN concat('C', CAST(o_orderkey AS VARCHAR)) ELSE CAST(o_orderkey AS VARCHAR) END AS Invoice,
        CASE WHEN l_linenumber=7 AND l_partkey % 10 = 0 THEN 'post' ELSE CAST(l_partkey AS VARCHAR) END AS StockCode,
        CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN '  '
             WHEN l_linenumber=3 AND l_partkey % 5 = 0 THEN concat(upper(p_name),'  ') ELSE concat(p_name,' ',p_brand) END AS Description,
        CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN -l_quantity WHEN l_partkey % 199 = 0 AND l_linenumber = 1 THEN l_quantity * 100 ELSE l_quantity END AS Quantity,
        o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS InvoiceDate,
        CASE WHEN l_partkey % 101 = 0 THEN CAST(0.0 AS DOUBLE) ELSE l_extendedprice / l_quantity END AS Price,
        CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS CustomerID,
        CASE WHEN o_orderkey % 13 = 0 THEN concat(' ', n_name) ELSE n_name END AS Country,
        CASE WHEN year(o_orderdate) < 1999 THEN 'A' ELSE 'B' END AS SourceSheet
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
      JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey),
raw AS (SELECT * FROM base UNION ALL
        SELECT * FROM base WHERE CAST(replace(Invoice,'C','') AS BIGINT) % 40 = 0)"""


def col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype).alias(name)
