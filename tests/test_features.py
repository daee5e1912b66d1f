import datetime as dt

from pyspark.sql import functions as F

from tillroll.functions.calendar import elapsed_days
from tillroll.operators import features as FE


def test_featured_has_28_columns(featured_small):
    assert len(featured_small.columns) == 28


def test_lifetime_value_equals_total_spend(featured_small):
    bad = featured_small.where(F.abs(F.col("CustomerLifetimeValue") - F.col("CustomerTotalSpend"))
                               > 1e-6 * F.abs(F.col("CustomerTotalSpend")) + 1e-6).count()
    assert bad == 0


def test_calendar_features(spark):
    df = spark.createDataFrame([(dt.datetime(2010, 12, 6, 14, 5),), (dt.datetime(2011, 4, 3, 9, 0),)],
                               "InvoiceDate TIMESTAMP_NTZ")
    rows = FE.calendar_features(df).orderBy("InvoiceDate").collect()
    a, b = rows
    assert (a.Year, a.Month, a.MonthName, a.Quarter, a.DayOfWeek, a.DayOfWeekNum, a.Hour, a.Season, a.YearMonth) == \
        (2010, 12, "Dec", 4, "Monday", 0, 14, "Winter", "2010-12")
    assert (b.DayOfWeek, b.DayOfWeekNum, b.Season, b.Quarter) == ("Sunday", 6, "Spring", 2)


def test_elapsed_days_floors_duration(spark):
    df = spark.createDataFrame([(dt.datetime(2011, 1, 1, 23, 0), dt.datetime(2011, 1, 3, 1, 0))],
                               "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ")
    assert df.select(elapsed_days("a", "b")).first()[0] == 1      # datediff would say 2


def test_demand_level_boundaries(spark):
    df = spark.createDataFrame([(float(q),) for q in range(1, 101)], "Quantity DOUBLE")
    out = {r.Quantity: r.DemandLevel for r in FE.demand_level(df).collect()}
    # q.33 = 33.67, q.67 = 67.33 (linear interpolation)
    assert out[33.0] == "Low" and out[34.0] == "Medium" and out[67.0] == "Medium" and out[68.0] == "High"


def test_invoice_totals_repeat_on_lines(featured_small):
    per = featured_small.groupBy("Invoice").agg(F.countDistinct("InvoiceTotalValue").alias("n"))
    assert per.where(F.col("n") != 1).count() == 0


def test_totals_of_both_kinds_come_in_one_join_of_the_lines(spark):
    import datetime as dt

    from tillroll.operators import features as FE
    day = dt.datetime(2011, 1, 3)
    rows = [("i1", "a", day, 2.0, 3.0), ("i1", "b", day, 1.0, 5.0), ("i2", "a", day + dt.timedelta(days=40), 4.0, 1.5), (None, "a", day, 1.0, 2.0),
            ("i3", None, day, 7.0, 2.0), (None, None, day, 9.0, 1.0), ("i2", "a", day, 4.0, 1.5)]
    df = spark.createDataFrame(rows, "Invoice STRING, CustomerID STRING, InvoiceDate TIMESTAMP_NTZ, Quantity DOUBLE, TotalPrice DOUBLE")
    got, want = FE.order_and_customer_value(df), FE.customer_value_features(FE.order_value(df))
    assert sorted(got.select(*want.columns).collect(), key=str) == sorted(want.collect(), key=str) and got.count() == len(rows)


def test_clean_lines_are_not_written_beside_the_lines_before_the_caps(spark, tmp_path):
    from tillroll.plans import stages
    from tillroll.sources.fixture import raw_transactions
    df = stages.staged_clean(spark, raw_transactions(spark, "/root/testdata/sf0.001"), str(tmp_path / "clean"))
    assert df.count() > 0 and [p.name for p in tmp_path.iterdir()] == ["clean-precap"]
