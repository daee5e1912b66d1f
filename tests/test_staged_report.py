"""The report of staged cleaning against the counted one, its lines against the plain chain."""

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tillroll.operators import cleaning as C
from tillroll.plans.stages import staged_clean_report
from tillroll.session import scratch_path
from tillroll.sources.fixture import raw_transactions


@pytest.mark.parametrize("dates", ["timestamp", "text"])
def test_report_and_lines_of_one_stage(spark, dates):
    raw = raw_transactions(spark, SF_SMALL, spaced_names=True)
    if dates == "text":
        raw = raw.withColumn("InvoiceDate", F.when(F.pmod(F.xxhash64("Invoice"), 50) == 0, F.lit("soon"))
                             .otherwise(F.date_format("InvoiceDate", "MM/dd/yyyy HH:mm")))
    path = scratch_path(spark, "stages", f"judged-{dates}")
    lines, report = staged_clean_report(spark, raw, path)
    want = C.clean_report(raw).first()
    assert report.first() == want and want.end_rows == lines.count()
    assert dates == "timestamp" or want.bad_date_removed > 0
    assert sorted(map(str, lines.collect())) == sorted(map(str, C.clean(raw).collect()))
    again, report = staged_clean_report(spark, raw.limit(0), path)                 # staged rows are read, not made anew
    assert report.first() == want and again.count() == want.end_rows
    rows = spark.read.parquet(f"{path}-judged")                                    # the removed rows can be looked at
    assert rows.where("_removed_by = 'missing_customer_removed' and CustomerID is null").count() == want.missing_customer_removed


def test_no_rows(spark):
    raw = raw_transactions(spark, SF_SMALL, spaced_names=True).where("false")
    lines, report = staged_clean_report(spark, raw, scratch_path(spark, "stages", "judged-none"))
    assert lines.count() == 0 and tuple(report.first()) == tuple(C.clean_report(raw).first())
