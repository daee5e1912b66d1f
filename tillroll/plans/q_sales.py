"""Registered queries: sales and customer analytics, describe, quantiles,
histograms, correlation (A1-A8, A12-A14, A21-A26, K1-K5, K11, J7, P13-P14, M20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillroll.operators import customers as CU
from tillroll.operators import sales as S
from tillroll.operators import sketches as SK
from tillroll.operators import stats as ST
from tillroll.plans.oracle import with_chain
from tillroll.functions.numeric import money_sum
from tillroll.plans.registry import query, rounded
from tillroll.plans.stages import customer_frame, featured_frame, raw_frame

PAGE_CORR = ("Quantity", "UnitPrice", "TotalPrice", "InvoiceTotalValue",
             "CustomerLifetimeValue", "PurchaseFrequency", "AverageOrderValue")
NOTEBOOK_CORR = ("Quantity", "UnitPrice", "TotalPrice", "CustomerLifetimeValue", "PurchaseFrequency")


def _f(spark, sf):
    return featured_frame(spark, sf)


@query("kpi_home", with_chain("featured", """
SELECT CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS total_revenue, count(DISTINCT Invoice) AS total_orders,
       count(DISTINCT CustomerID) AS total_customers, count(DISTINCT Country) AS countries,
       (coalesce(CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(DISTINCT Invoice), 0), 0)) AS avg_order_value
FROM featured"""))
def q_kpi_home(spark, sf):
    return S.kpi_home(_f(spark, sf))


@query("top_market", with_chain("featured", """
SELECT Country, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured GROUP BY Country
ORDER BY CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) DESC, Country LIMIT 1"""))
def q_top_market(spark, sf):
    return S.top_market(_f(spark, sf))


# a real choice on the sales page: three countries, one month
FILTER = {"countries": ("NATION_1", "NATION_10", "NATION_7"), "start": "1996-03-01", "end": "1996-03-31"}
FILTER_SQL = """WHERE Country IN ('NATION_1', 'NATION_10', 'NATION_7')
  AND InvoiceDate >= TIMESTAMP '1996-03-01' AND InvoiceDate < TIMESTAMP '1996-04-01'"""


@query("sales_filtered", with_chain("featured", f"""
SELECT Country, count(*) AS lines, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured {FILTER_SQL} GROUP BY Country"""))
def q_sales_filtered(spark, sf):
    """The page filter with countries and a date range (both ends inclusive)."""
    out = S.filter_sales(_f(spark, sf), **FILTER)
    return out.groupBy("Country").agg(F.count(F.lit(1)).alias("lines"), money_sum("TotalPrice").alias("revenue"))


@query("kpi_sales_filtered", with_chain("featured", f"""
SELECT CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue, count(DISTINCT Invoice) AS orders, sum(Quantity) AS units,
       coalesce(CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(DISTINCT Invoice), 0), 0) AS avg_order_value
FROM featured {FILTER_SQL}"""))
def q_kpi_sales_filtered(spark, sf):
    return S.kpi_sales(S.filter_sales(_f(spark, sf), **FILTER))


@query("country_list", with_chain("featured", "SELECT DISTINCT Country FROM featured"))
def q_country_list(spark, sf):
    return S.country_list(_f(spark, sf))


@query("kpi_sales", with_chain("featured", """
SELECT CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue, count(DISTINCT Invoice) AS orders, sum(Quantity) AS units,
       (coalesce(CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) / nullif(count(DISTINCT Invoice), 0), 0)) AS avg_order_value
FROM featured"""))
def q_kpi_sales(spark, sf):
    return S.kpi_sales(_f(spark, sf))


@query("monthly_revenue", with_chain("featured", """
SELECT YearMonth, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured GROUP BY YearMonth"""))
def q_monthly_revenue(spark, sf):
    return S.monthly_revenue(_f(spark, sf))


@query("country_revenue", with_chain("featured", """
SELECT Country, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue,
       round(100.0 * CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) / (SELECT CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) FROM featured), 6) AS share_pct
FROM featured GROUP BY Country"""))
def q_country_revenue(spark, sf):
    return rounded(S.country_revenue(_f(spark, sf)), ratio=("share_pct",))


@query("season_revenue", with_chain("featured", """
SELECT Season, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured GROUP BY Season"""))
def q_season_revenue(spark, sf):
    return S.season_revenue(_f(spark, sf))


@query("orders_by_weekday", with_chain("featured", """
SELECT d.n AS DayOfWeekNum, d.name AS DayOfWeek, coalesce(c.Orders, 0) AS Orders
FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
             (5, 'Saturday'), (6, 'Sunday')) d(n, name)
LEFT JOIN (SELECT DayOfWeek, count(DISTINCT Invoice) AS Orders FROM featured GROUP BY DayOfWeek) c
  ON c.DayOfWeek = d.name"""))
def q_orders_by_weekday(spark, sf):
    return S.orders_by_weekday(_f(spark, sf), spark)


@query("product_totals", with_chain("featured", """
SELECT Description, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue, sum(Quantity) AS units FROM featured GROUP BY Description"""))
def q_product_totals(spark, sf):
    return S.product_totals(_f(spark, sf))


@query("top_countries", with_chain("featured", """
SELECT Country, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured GROUP BY Country
ORDER BY CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) DESC, Country LIMIT 10"""))
def q_top_countries(spark, sf):
    return S.top_countries(_f(spark, sf))


@query("top_products_revenue", with_chain("featured", """
SELECT Description, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS revenue FROM featured GROUP BY Description
ORDER BY CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) DESC, Description LIMIT 10"""))
def q_top_products_revenue(spark, sf):
    return S.top_products_revenue(_f(spark, sf))


@query("top_products_units", with_chain("featured", """
SELECT Description, sum(Quantity) AS units FROM featured GROUP BY Description
ORDER BY sum(Quantity) DESC, Description LIMIT 10"""))
def q_top_products_units(spark, sf):
    return S.top_products_units(_f(spark, sf))


# --- customers ----------------------------------------------------------------

CUST_SQL = """cust AS (
 SELECT CustomerID, CAST(sum(CAST(TotalPrice AS DECIMAL(18,6))) AS DOUBLE) AS TotalSpend, count(DISTINCT Invoice) AS TotalOrders,
        min(InvoiceDate) AS FirstPurchase, max(InvoiceDate) AS LastPurchase,
        arg_min(Country, (InvoiceDate, Invoice, Country)) AS Country
 FROM featured GROUP BY CustomerID)"""


def _cust(spark, sf):
    return customer_frame(spark, sf, "summary", CU.customer_summary)


@query("customer_summary", with_chain("featured", """
SELECT CustomerID, TotalSpend, TotalOrders, FirstPurchase, LastPurchase, Country,
       TotalSpend / TotalOrders AS AvgOrderValue FROM cust""", extra=CUST_SQL))
def q_customer_summary(spark, sf):
    return _cust(spark, sf)


@query("kpi_customers", with_chain("featured", """
SELECT count(*) AS total_customers, round(avg(TotalSpend), 2) AS avg_spend, round(avg(TotalOrders), 6) AS avg_orders,
       count(*) FILTER (WHERE TotalOrders > 1) AS repeat_customers FROM cust""", extra=CUST_SQL))
def q_kpi_customers(spark, sf):
    return rounded(CU.kpi_customers(_cust(spark, sf)), money=("avg_spend",), ratio=("avg_orders",))


@query("customers_by_country", with_chain("featured", """
SELECT Country, count(DISTINCT CustomerID) AS customers FROM cust GROUP BY Country""", extra=CUST_SQL))
def q_customers_by_country(spark, sf):
    return CU.customers_by_country(_cust(spark, sf))


@query("top_customers", with_chain("featured", """
SELECT CustomerID, TotalSpend FROM cust ORDER BY TotalSpend DESC, CustomerID LIMIT 15""",
                                   extra=CUST_SQL))
def q_top_customers(spark, sf):
    return CU.top_customers(_cust(spark, sf))


@query("top_customer_countries", with_chain("featured", """
SELECT Country, count(DISTINCT CustomerID) AS customers FROM cust GROUP BY Country
ORDER BY customers DESC, Country LIMIT 10""", extra=CUST_SQL))
def q_top_customer_countries(spark, sf):
    return CU.top_customer_countries(_cust(spark, sf))


@query("clv_scatter", with_chain("featured", """
SELECT CustomerID, CustomerLifetimeValue,
       PurchaseFrequency, CustomerTotalSpend
FROM per WHERE CustomerLifetimeValue <= (SELECT quantile_cont(CustomerLifetimeValue, 0.97) FROM per)""",
                                 extra="""per AS (SELECT CustomerID, any_value(CustomerLifetimeValue) AS CustomerLifetimeValue,
 any_value(PurchaseFrequency) AS PurchaseFrequency, any_value(CustomerTotalSpend) AS CustomerTotalSpend
 FROM featured GROUP BY CustomerID)"""))
def q_clv_scatter(spark, sf):
    return CU.clv_scatter(_f(spark, sf))


# --- distributions --------------------------------------------------------------

QUANTILE_SPEC = (("Quantity", 0.33), ("Quantity", 0.67), ("Quantity", 0.99), ("Quantity", 0.995),
                 ("UnitPrice", 0.995), ("TotalPrice", 0.99), ("CustomerLifetimeValue", 0.97))


@query("quantiles", with_chain("featured", " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST({p} AS DOUBLE) AS q, round(quantile_cont({c}, {p}), 6) AS value FROM featured"
    for c, p in QUANTILE_SPEC)))
def q_quantiles(spark, sf):
    return rounded(ST.quantile_table(_f(spark, sf), QUANTILE_SPEC), ratio=("value",))


SKETCHED = ("Quantity", "UnitPrice", "TotalPrice")
SKETCH_PROBS = (0.0, 0.01, 0.1, 0.25, 0.33, 0.5, 0.67, 0.75, 0.9, 0.97, 0.99, 0.995, 1.0)


def _cells(spark, sf):
    return customer_frame(spark, sf, "sketches", lambda d: SK.sketch_cells(d, ("Country", "YearMonth"), SKETCHED))


@query("quantiles_approx", with_chain("featured", " UNION ALL ".join(
    f"""SELECT Country, '{c}' AS column, count({c}) AS n, round(CAST(min({c}) AS DOUBLE), 6) AS lowest, round(CAST(max({c}) AS DOUBLE), 6) AS highest,
 true AS within FROM featured GROUP BY Country""" for c in SKETCHED)))
def q_quantiles_approx(spark, sf):
    """Quantiles of a country from the sketches of its months; ``within``: every wanted rank is met with at most twice the stated error."""
    got = customer_frame(spark, sf, "sketch-quantiles",
                         lambda _: SK.approx_quantiles(_cells(spark, sf), SKETCHED, SKETCH_PROBS, by=("Country",)))
    misses = SK.column_misses(_f(spark, sf), got, "Country", SKETCHED, SKETCH_PROBS)
    ends = got.groupBy("Country", "column", "n").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"))
    out = ends.join(misses, ["Country", "column"]).select("Country", "column", "n", "lowest", "highest",
                                                          (F.col("miss") <= 2 * SK.rank_error()).alias("within"))
    return rounded(out, ratio=("lowest", "highest"))


def _hist_sql(src: str, col: str, bins: int, trim: float | None, inclusive: bool, by: str | None = None) -> str:
    op = "<=" if inclusive else "<"
    where = f"WHERE {col} {op} (SELECT quantile_cont({col}, {trim}) FROM {src})" if trim else ""
    keys = f"{by}, " if by else ""
    return f"""t AS (SELECT {keys}CAST({col} AS DOUBLE) AS x FROM {src} {where}),
mm AS (SELECT min(x) AS lo, max(x) AS hi FROM t),
b AS (SELECT {keys}CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / (hi - lo) * {float(bins)}), {bins - 1}) AS INTEGER) END AS bin,
             lo, hi FROM t CROSS JOIN mm)
SELECT {keys}bin, round(lo + bin * ((hi - lo) / {float(bins)}), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / {float(bins)}), 6) AS bin_hi, count(*) AS count
FROM b GROUP BY {keys}bin, lo, hi"""


def _hist_chain(level: str, extra: str, body: str) -> str:
    sel_at = body.index("SELECT", body.index("FROM t CROSS JOIN mm"))
    ctes = body[:sel_at].strip().rstrip(",")
    return with_chain(level, body[sel_at:], extra=(extra + ",\n" if extra else "") + ctes)


@query("hist_revenue", _hist_chain("featured", "", _hist_sql("featured", "TotalPrice", 50, 0.99, False)))
def q_hist_revenue(spark, sf):
    return rounded(ST.histogram(_f(spark, sf), "TotalPrice", 50, 0.99), ratio=("bin_lo", "bin_hi"))


@query("hist_quantity", _hist_chain("featured", "", _hist_sql("featured", "Quantity", 50, 0.99, False)))
def q_hist_quantity(spark, sf):
    return rounded(ST.histogram(_f(spark, sf), "Quantity", 50, 0.99), ratio=("bin_lo", "bin_hi"))


@query("hist_orders", _hist_chain("featured", CUST_SQL, _hist_sql("cust", "TotalOrders", 30, 0.99, True)))
def q_hist_orders(spark, sf):
    return rounded(ST.histogram(_cust(spark, sf), "TotalOrders", 30, 0.99, inclusive=True),
                   ratio=("bin_lo", "bin_hi"))


@query("hist_spend", _hist_chain("featured", CUST_SQL, _hist_sql("cust", "TotalSpend", 40, 0.97, True)))
def q_hist_spend(spark, sf):
    return rounded(ST.histogram(_cust(spark, sf), "TotalSpend", 40, 0.97, inclusive=True),
                   ratio=("bin_lo", "bin_hi"))


def _corr_sql(cols) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"SELECT '{a}' AS row, '{b}' AS col, round(corr({a}, {b}), 6) AS corr FROM featured")
    return " UNION ALL ".join(parts)


@query("correlation", with_chain("featured", _corr_sql(PAGE_CORR)))
def q_correlation(spark, sf):
    return rounded(ST.correlation(_f(spark, sf), PAGE_CORR), ratio=("corr",))


@query("correlation_notebook", with_chain("featured", _corr_sql(NOTEBOOK_CORR)))
def q_correlation_nb(spark, sf):
    return rounded(ST.correlation(_f(spark, sf), NOTEBOOK_CORR), ratio=("corr",))


DESC_NUM = ("Quantity", "Price", "CustomerID")
DESC_CAT = ("Invoice", "StockCode", "Description", "Country", "SourceSheet")


@query("describe_numeric", with_chain("raw", " UNION ALL ".join(
    f"""SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std,
       round(min({c}), 2) AS min, round(quantile_cont({c}, 0.25), 2) AS p25, round(quantile_cont({c}, 0.5), 2) AS p50,
       round(quantile_cont({c}, 0.75), 2) AS p75, round(max({c}), 2) AS max FROM raw""" for c in DESC_NUM)))
def q_describe_numeric(spark, sf):
    raw = raw_frame(spark, sf)
    return rounded(ST.describe_numeric(raw, DESC_NUM),
                   money=("mean", "std", "min", "p25", "p50", "p75", "max"))


@query("describe_categorical", with_chain("raw", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column, (SELECT count({c}) FROM raw) AS count,
       (SELECT count(DISTINCT {c}) FROM raw) AS unique, {c} AS top, count(*) AS freq
       FROM raw WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)""" for c in DESC_CAT)))
def q_describe_categorical(spark, sf):
    return ST.describe_categorical(raw_frame(spark, sf), DESC_CAT)
