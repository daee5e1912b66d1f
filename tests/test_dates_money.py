"""Text dates by one reading a column, and money totals of sub-cent lines."""

import math

import pytest
from pyspark.sql import functions as F

from tillroll.functions.numeric import money_sum
from tillroll.operators import cleaning as C
from tillroll.operators.churn import roc_auc


def read(spark, texts, reading=None):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, InvoiceDate string")
    return [str(r.d) if r.d else None for r in df.select("i", C.invoice_date(df, reading).alias("d")).orderBy("i").collect()]


def test_year_first(spark):
    got = read(spark, ["2010-12-01 08:26:00", "2010-12-01 08:26:00.250", "2010-12-01T08:26:00Z", "2010-12-01T08:26:00+02:00", "2010-12-01", "2010-12-01 08:26",
                       "2010-13-01", "text", "", None, "2010/2/9 7:05"])
    assert got == ["2010-12-01 08:26:00", "2010-12-01 08:26:00.250000", "2010-12-01 08:26:00", "2010-12-01 08:26:00", "2010-12-01 00:00:00", "2010-12-01 08:26:00",
                   None, None, None, None, "2010-02-09 07:05:00"]


def test_one_reading_for_a_column(spark):
    assert read(spark, ["01/12/2010 08:26", "13/12/2010 08:26"]) == ["2010-12-01 08:26:00", "2010-12-13 08:26:00"]
    assert read(spark, ["01/12/2010 08:26", "1/13/2010 08:26:30"]) == ["2010-01-12 08:26:00", "2010-01-13 08:26:30"]
    assert read(spark, ["12/1/2010 8:26 AM", "12/1/2010 12:05 pm", "12/1/10 12:05 am"]) == ["2010-12-01 08:26:00", "2010-12-01 12:05:00", "2010-12-01 00:05:00"]
    assert read(spark, ["01/12/2010"], "dmy") == ["2010-12-01 00:00:00"]


@pytest.mark.parametrize("zone", ["America/New_York", "UTC"])
def test_no_session_zone(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert read(spark, ["2010-03-14 02:30:00", "3/14/2010 2:30"], "ymd")[0] == "2010-03-14 02:30:00"
        assert read(spark, ["3/14/2010 2:30"], "mdy") == ["2010-03-14 02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_sub_cent_lines(spark):
    df = spark.createDataFrame([(0.0375,)] * 1000 + [(1.005,), (-0.001,)], "v double")
    assert df.agg(money_sum("v")).first()[0] == pytest.approx(math.fsum([0.0375] * 1000 + [1.005, -0.001]), abs=1e-9)
    assert df.repartition(7).agg(money_sum("v")).first()[0] == df.coalesce(1).agg(money_sum("v")).first()[0]


def test_auc_of_near_ties(spark):
    df = spark.createDataFrame([(1, 0.5004), (0, 0.5001), (1, 0.9), (0, 0.1), (1, 0.1)], "label int, score double")
    assert roc_auc(df).first()[0] == pytest.approx((1 + 1 + 1 + 1 + 0 + 0.5) / 6)
    assert roc_auc(df.where("label = 1")).first()[0] is None
    assert roc_auc(df.withColumn("score", F.lit(0.5))).first()[0] == 0.5
