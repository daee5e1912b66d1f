"""Registered queries: insights and formatted KPIs."""

from __future__ import annotations

from tillroll.config import DEFAULT, INSIGHTS
from tillroll.functions.numeric import money_sum_sql
from tillroll.operators import churn as CH
from tillroll.operators import insights as IN
from tillroll.operators import inventory as INV
from tillroll.plans.models import segmentation
from tillroll.plans.oracle import with_chain
from tillroll.plans.q_inventory import INV_SQL
from tillroll.plans.q_models import CF_SQL
from tillroll.plans.registry import query, rounded
from tillroll.plans.stages import customer_frame, featured_frame

MS = money_sum_sql("TotalPrice")
SYM = DEFAULT.currency


def _dbl(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def banded_sql(x: str, prefix: str) -> str:
    """SQL twin of formatting._banded."""
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN '{prefix}0' "
            f"WHEN abs({x}) >= 1000000 THEN '{prefix}' || format('{{:,.2f}}', {x} / {_dbl(1e6)}) || 'M' "
            f"WHEN abs({x}) >= 1000 THEN '{prefix}' || format('{{:,.1f}}', {x} / {_dbl(1e3)}) || 'K' "
            f"ELSE '{prefix}' || format('{{:,.0f}}', {x}) END)")


def cur(x: str) -> str:
    return banded_sql(f"CAST({x} AS DOUBLE)", SYM)


def num(x: str) -> str:
    return banded_sql(f"CAST({x} AS DOUBLE)", "")


def fixed(x: str, d: int) -> str:
    return f"format('{{:.{d}f}}', CAST({x} AS DOUBLE))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def T(i: int) -> str:
    """category, title of the i-th insight as SQL literals."""
    return f"{_q(INSIGHTS[i - 1][0])} AS category, {_q(INSIGHTS[i - 1][1])} AS title"


def S(i: int) -> str:
    """sentence of the i-th insight as a printf format literal."""
    return _q(INSIGHTS[i - 1][2])


GROWTH_SQL = """pg_cut AS (SELECT max(InvoiceDate) - INTERVAL 30 DAY AS rc, max(InvoiceDate) - INTERVAL 60 DAY AS pc FROM featured),
pg AS (SELECT Description, sum(Quantity) FILTER (WHERE InvoiceDate > rc) AS recent,
              sum(Quantity) FILTER (WHERE InvoiceDate <= rc AND InvoiceDate > pc) AS prior
       FROM featured CROSS JOIN pg_cut WHERE InvoiceDate > pc GROUP BY Description),
growth AS (SELECT *, (recent - prior) / prior AS growth FROM pg
           WHERE recent IS NOT NULL AND prior IS NOT NULL AND prior >= 30)"""

INSIGHT_SQL = INV_SQL + ",\n" + GROWTH_SQL + f""",
monthly AS (SELECT YearMonth, {MS} AS revenue FROM featured GROUP BY 1),
country AS (SELECT Country, {MS} AS revenue FROM featured GROUP BY 1),
prod AS (SELECT Description, {MS} AS revenue, sum(Quantity) AS units FROM featured GROUP BY 1),
ins AS (
 SELECT * FROM (SELECT 1 AS ordinal, {T(1)}, printf({S(1)}, YearMonth, {cur('revenue')}) AS detail
        FROM monthly ORDER BY revenue DESC, YearMonth LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 2, {T(2)}, printf({S(2)}, YearMonth, {cur('revenue')})
        FROM monthly ORDER BY revenue, YearMonth LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 3, {T(3)}, printf({S(3)}, Country, {cur('revenue')},
        {fixed(f"{_dbl(100.0)} * revenue / (SELECT {MS} FROM featured)", 1)})
        FROM country ORDER BY revenue DESC, Country LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 4, {T(4)}, printf({S(4)}, Description, {cur('revenue')})
        FROM prod ORDER BY revenue DESC, Description LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 5, {T(5)}, printf({S(5)}, Description, {num('units')})
        FROM prod ORDER BY units DESC, Description LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 6, {T(6)}, printf({S(6)}, Description, {fixed('growth * 100', 0)})
        FROM growth ORDER BY growth DESC, Description LIMIT 1)
 UNION ALL
 SELECT * FROM (SELECT 7, {T(7)}, printf({S(7)}, Description, {fixed('abs(growth) * 100', 0)})
        FROM growth ORDER BY growth, Description LIMIT 1)
 UNION ALL
 SELECT 9, {T(9)}, printf({S(9)}, CAST(count(*) FILTER (WHERE RecommendedAction = 'Increase Stock') AS VARCHAR),
                          CAST(count(*) FILTER (WHERE RecommendedAction = 'Reduce Stock') AS VARCHAR))
 FROM inv HAVING count(*) > 0)"""


def _f(spark, sf):
    return featured_frame(spark, sf)


def _insights(spark, sf, with_segments: bool = False):
    f = _f(spark, sf)
    segs = segmentation(spark, sf)[0] if with_segments else None
    return IN.generate(f, segs, INV.recommend(f))


@query("product_growth", with_chain("featured", """
SELECT Description, recent, prior, round(growth, 6) AS growth FROM growth""", extra=GROWTH_SQL))
def q_product_growth(spark, sf):
    return rounded(IN.product_growth(_f(spark, sf)), ratio=("growth",))


@query("insights", with_chain("featured", "SELECT * FROM ins", extra=INSIGHT_SQL))
def q_insights(spark, sf):
    """Insights from sales, products, trends and inventory (segments optional, see insights_full)."""
    return _insights(spark, sf)


@query("insight_categories", with_chain("featured", "SELECT DISTINCT category FROM ins", extra=INSIGHT_SQL))
def q_insight_categories(spark, sf):
    return IN.categories(_insights(spark, sf))


@query("insights_full")
def q_insights_full(spark, sf):
    """All nine insight kinds including the KMeans segment insight (rows-only)."""
    return _insights(spark, sf, with_segments=True)


@query("format_kpis", with_chain("featured", f"""
SELECT {cur('rev')} AS total_revenue, {num('orders')} AS total_orders, {num('cust')} AS total_customers,
       {cur('coalesce(rev / nullif(orders, 0), 0)')} AS avg_order_value, top AS top_market,
       {num('countries')} AS countries_served,
       {fixed(f"{_dbl(100.0)} * churn", 1)} || '%' AS churn_rate
FROM (SELECT {MS} AS rev, count(DISTINCT Invoice) AS orders, count(DISTINCT CustomerID) AS cust,
             count(DISTINCT Country) AS countries FROM featured) k
CROSS JOIN (SELECT Country AS top FROM (SELECT Country, {MS} AS r FROM featured GROUP BY 1) ORDER BY r DESC, Country LIMIT 1) t
CROSS JOIN (SELECT coalesce(count(*) FILTER (WHERE ChurnRiskLabel = 'Churned') / nullif(count(*), 0), 0) AS churn
            FROM labels) c""", extra=CF_SQL))
def q_format_kpis(spark, sf):
    f = _f(spark, sf)
    return IN.format_kpis(f, customer_frame(spark, sf, "labels", CH.churn_labels))
