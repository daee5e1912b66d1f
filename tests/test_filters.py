import datetime as dt

from pyspark.sql import functions as F

from tillroll.operators import sales as S
from tillroll.plans.pipeline import run_stage
from tillroll.session import scratch_path


def test_country_and_date_filter_against_pandas(spark, featured_small):
    pdf = featured_small.select("Invoice", "Country", "InvoiceDate", "TotalPrice", "Quantity").toPandas()
    countries = sorted(pdf["Country"].unique())[:3]
    start, end = dt.date(1997, 3, 1), dt.date(1999, 6, 30)
    want = pdf[pdf["Country"].isin(countries)
               & (pdf["InvoiceDate"].dt.date >= start) & (pdf["InvoiceDate"].dt.date <= end)]
    got = S.filter_sales(featured_small, countries, start, end)
    assert got.count() == len(want)
    k = S.kpi_sales(got).first()
    assert k.orders == want["Invoice"].nunique()
    assert abs(k.revenue - want["TotalPrice"].sum()) < 1e-6 * abs(want["TotalPrice"].sum()) + 0.01
    assert k.units == want["Quantity"].sum()


def test_empty_country_list_means_all(featured_small):
    assert S.filter_sales(featured_small, ()).count() == featured_small.count()


def test_date_bounds_push_to_scan(featured_small):
    plan = S.filter_sales(featured_small, (), "1998-01-01", "1998-12-31")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "InvoiceDate" in plan


def test_run_stage_parquet_in_out(spark, featured_small):
    src = scratch_path(spark, "test-stage", "featured")
    featured_small.write.mode("overwrite").parquet(src)
    out = run_stage(spark, "inventory", src, scratch_path(spark, "test-stage", "inventory"))
    assert out.count() == 50
    assert out.where(F.col("RecommendedAction").isNull()).count() == 0
