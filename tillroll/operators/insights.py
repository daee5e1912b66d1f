"""Business insights (M19, F23, K10, J3, P16) and formatted KPIs.

Each subject (months, countries, products, growth) is one grouped aggregate and a ``min_by`` over a struct
that gives all of its picks; the rows are unioned with an ordinal. Ties pick the smallest key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, INSIGHTS, STOCK_ACTIONS, Config
from tillroll.functions.formatting import fmt_currency, fmt_fixed, fmt_number, fmt_percent
from tillroll.functions.numeric import money_sum, safe_divide
from tillroll.operators.quantiles import distinct_counts, with_scalars
from tillroll.operators.sales import revenue_by


def _row(df: DataFrame, ordinal: int, *values: Column) -> DataFrame:
    """One insight row: the ``ordinal``-th entry of the fixed INSIGHTS list filled with ``values``."""
    category, title, sentence = INSIGHTS[ordinal - 1]
    return df.select(F.lit(ordinal).alias("ordinal"), F.lit(category).alias("category"),
                     F.lit(title).alias("title"), F.format_string(sentence, *values).alias("detail"))


def _pct1(c) -> Column:
    return fmt_fixed(c, 1, thousands=False)


def product_growth(df: DataFrame, days: int = 30, min_prior: float = 30) -> DataFrame:
    """Units per product in the last ``days`` vs the ``days`` before, where both
    windows have sales and prior >= ``min_prior``; growth = (recent - prior) / prior.

    One conditional aggregate replaces the outer concat + dropna of the two sums. The bounds are plain scalar
    subqueries, so the scan is filtered by date.
    """
    last = df.agg(F.max("InvoiceDate").alias("_last"))
    edge = [last.select(F.col("_last") - F.make_interval(days=F.lit(k * days))).scalar() for k in (1, 2)]
    recent = F.col("InvoiceDate") > edge[0]
    g = df.where(F.col("InvoiceDate") > edge[1]).groupBy("Description").agg(
        F.sum(F.when(recent, F.col("Quantity"))).alias("recent"),
        F.sum(F.when(~recent, F.col("Quantity"))).alias("prior"))
    return (g.where(F.col("recent").isNotNull() & F.col("prior").isNotNull() & (F.col("prior") >= min_prior))
             .withColumn("growth", (F.col("recent") - F.col("prior")) / F.col("prior")))


def _best(value: str, key: str, low: bool = False) -> Column:
    """(key, value) of the largest (smallest) value, of equals the smallest key: one aggregate, no sort."""
    order = F.struct((F.col(value) if low else -F.col(value)).alias("v"), F.col(key).alias("k"))
    return F.min_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), order)


def generate(df: DataFrame, segments: DataFrame | None = None, inventory: DataFrame | None = None,
             cfg: Config = DEFAULT) -> DataFrame:
    """Ordinal, category, title, detail."""
    sym = cfg.currency
    rows = []
    # one aggregate a subject gives both of its picks
    monthly = revenue_by(df, "YearMonth").agg(_best("revenue", "YearMonth").alias("best"), _best("revenue", "YearMonth", low=True).alias("worst"))
    rows.append(_row(monthly.where("best.k is not null"), 1, F.col("best.k"), fmt_currency("best.v", sym)))
    rows.append(_row(monthly.where("best.k is not null"), 2, F.col("worst.k"), fmt_currency("worst.v", sym)))

    # the total is the sum of the countries' exact totals
    country = (df.groupBy("Country").agg(F.sum(F.col("TotalPrice").cast("decimal(18,6)")).alias("_exact"))
               .withColumn("revenue", F.col("_exact").cast("double"))
               .agg(_best("revenue", "Country").alias("top"), F.sum("_exact").cast("double").alias("_total")))
    rows.append(_row(country.where("top.k is not null"), 3, F.col("top.k"), fmt_currency("top.v", sym),
                     _pct1(F.lit(100.0) * F.col("top.v") / F.col("_total"))))

    products = (df.groupBy("Description").agg(money_sum("TotalPrice").alias("revenue"), F.sum("Quantity").alias("units"))
                .agg(_best("revenue", "Description").alias("rev"), _best("units", "Description").alias("qty")))
    rows.append(_row(products.where("rev.k is not null"), 4, F.col("rev.k"), fmt_currency("rev.v", sym)))
    rows.append(_row(products.where("rev.k is not null"), 5, F.col("qty.k"), fmt_number("qty.v")))

    growth = product_growth(df).agg(_best("growth", "Description").alias("up"), _best("growth", "Description", low=True).alias("down"))
    rows.append(_row(growth.where("up.k is not null"), 6, F.col("up.k"), fmt_fixed(F.col("up.v") * 100, 0, thousands=False)))
    rows.append(_row(growth.where("up.k is not null"), 7, F.col("down.k"), fmt_fixed(F.abs(F.col("down.v")) * 100, 0, thousands=False)))

    if segments is not None:
        seg = segments.groupBy("Segment").agg(money_sum("Monetary").alias("_m"), F.count(F.lit(1)).alias("_n"))
        tot = segments.agg(money_sum("Monetary").alias("_tm"), F.count(F.lit(1)).alias("_tn"))
        top_s = with_scalars(seg.orderBy(F.desc("_m"), F.asc("Segment")).limit(1), tot)
        rows.append(_row(top_s, 8, F.col("Segment"), _pct1(F.lit(100.0) * F.col("_m") / F.col("_tm")),
                         _pct1(F.lit(100.0) * F.col("_n") / F.col("_tn"))))

    if inventory is not None:
        a = F.col("RecommendedAction")
        inv = inventory.agg(F.count(F.lit(1)).alias("_n"),
                            F.count_if(a == STOCK_ACTIONS[0]).alias("_inc"),
                            F.count_if(a == STOCK_ACTIONS[2]).alias("_red")).where(F.col("_n") > 0)
        rows.append(_row(inv, 9, F.col("_inc").cast("string"), F.col("_red").cast("string")))

    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def categories(insights: DataFrame) -> DataFrame:
    """Distinct insight categories (sorted when displayed)."""
    return insights.select("category").distinct()


def by_category(insights: DataFrame, category: str) -> DataFrame:
    """One category's insights."""
    return insights.where(F.col("category") == category)


def format_kpis(df: DataFrame, churn: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """The overview KPI texts (revenue, orders, customers, AOV, top market,
    countries served, churn rate)."""
    k = with_scalars(df.agg(money_sum("TotalPrice").alias("_rev")),
                     distinct_counts(df, ["Invoice", "CustomerID", "Country"], ["_orders", "_cust", "_countries"]))
    top = revenue_by(df, "Country").orderBy(F.desc("revenue"), F.asc("Country")).limit(1) \
        .select(F.col("Country").alias("_top"))
    k = with_scalars(k, top)
    if churn is not None:
        k = with_scalars(k, churn.agg(safe_divide(F.count_if(F.col("ChurnRiskLabel") == "Churned"),
                                                  F.count(F.lit(1))).alias("_churn")))
    else:
        k = k.withColumn("_churn", F.lit(0.0))
    return k.select(
        fmt_currency("_rev", cfg.currency).alias("total_revenue"),
        fmt_number("_orders").alias("total_orders"),
        fmt_number("_cust").alias("total_customers"),
        fmt_currency(safe_divide("_rev", "_orders"), cfg.currency).alias("avg_order_value"),
        F.col("_top").alias("top_market"),
        fmt_number("_countries").alias("countries_served"),
        fmt_percent("_churn").alias("churn_rate"))


def top(insights: DataFrame, n: int = 4) -> DataFrame:
    """K9: the first ``n`` insights by ordinal (the overview page shows four)."""
    return insights.orderBy("ordinal").limit(n)
