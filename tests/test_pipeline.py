from conftest import SF_SMALL
from pyspark.sql import functions as F

from tillroll.plans.pipeline import run_pipeline
from tillroll.sources.fixture import raw_transactions


def test_full_pipeline(spark):
    res = run_pipeline(spark, raw_transactions(spark, SF_SMALL, spaced_names=True))
    assert res.report.first().end_rows == res.clean.count() == 4483
    assert len(res.featured.columns) == 28
    assert res.segments.count() == res.featured.select("CustomerID").distinct().count()
    assert res.forecast.where("IsForecast").count() == 30
    assert res.inventory.count() == 50
    assert res.insights.count() == 9
    assert res.churn.where(~F.col("ChurnProbability").between(0, 1)).count() == 0
    s = res.inventory_summary.first()
    assert s.increase_count + s.maintain_count + s.reduce_count == 50
