import datetime as dt
import math

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tillroll.operators import cleaning as C
from tillroll.sources.fixture import raw_transactions

RAW = ("Invoice STRING, StockCode STRING, Description STRING, Quantity DOUBLE, InvoiceDate TIMESTAMP_NTZ, "
       "Price DOUBLE, `Customer ID` DOUBLE, Country STRING")
T0 = dt.datetime(2010, 12, 1, 8, 26)


def frame(spark, rows, schema=RAW):
    return spark.createDataFrame(rows, schema)


def line(inv="1001", code="85123A", desc="WHITE HANGING HEART", qty=6.0, ts=T0, price=2.55, cust=17850.0,
         country="United Kingdom"):
    return (inv, code, desc, qty, ts, price, cust, country)


def test_missing_columns_raise(spark):
    df = frame(spark, [line()]).drop("Country")
    with pytest.raises(ValueError, match="Country"):
        C.standardize(df)


def test_either_spelling_accepted(spark):
    df = frame(spark, [line()]).withColumnsRenamed({"Price": "UnitPrice", "Customer ID": "CustomerID"})
    assert C.clean(df).count() == 1


def test_description_fill_strip_and_drop(spark):
    rows = [line(desc=None), line(inv="1002", desc="\t lamp \n"), line(inv="1003", desc="   ")]
    out = {r.Invoice: r.Description for r in C.clean(frame(spark, rows)).collect()}
    assert out == {"1001": "UNKNOWN ITEM", "1002": "lamp"}


def test_cancellations_and_invalid_lines(spark):
    rows = [line(inv="C1001", qty=-1.0), line(inv="c1002"), line(inv="1003", qty=0.0),
            line(inv="1004", price=0.009), line(inv="1005", price=0.01), line(inv="1006", price=float("nan")),
            line(inv="1007", qty=float("nan"))]
    kept = sorted(r.Invoice for r in C.clean(frame(spark, rows)).collect())
    assert kept == ["1005", "c1002"]


def test_non_product_codes_case_insensitive(spark):
    rows = [line(inv="1", code="post"), line(inv="2", code="POST1"), line(inv="3", code="Bank Charges"),
            line(inv="4", code="TEST001"), line(inv="5", code="d")]
    kept = sorted(r.Invoice for r in C.clean(frame(spark, rows)).collect())
    assert kept == ["2"]


def test_missing_customer_dropped_and_id_text(spark):
    rows = [line(inv="1", cust=None), line(inv="2", cust=12345.0), line(inv="3", cust=float("nan"))]
    out = [(r.Invoice, r.CustomerID) for r in C.clean(frame(spark, rows)).collect()]
    assert out == [("2", "12345")]


def test_text_dates_and_customer_text(spark):
    schema = RAW.replace("InvoiceDate TIMESTAMP_NTZ", "InvoiceDate STRING").replace(
        "`Customer ID` DOUBLE", "`Customer ID` STRING")
    rows = [("1", "A", "x", 1.0, "2010-12-01 08:26:00", 1.0, "17850.0", "UK"),
            ("2", "A", "x", 1.0, "not a date", 1.0, "17850", "UK"),
            ("3", "A", "x", 1.0, "12/1/2010 8:26", 1.0, "abc", "UK")]
    out = C.clean(frame(spark, rows, schema)).collect()
    assert [(r.Invoice, r.InvoiceDate) for r in out] == [("1", T0)]


def test_whole_row_dedup_keeps_distinct_provenance(spark):
    schema = RAW + ", SourceSheet STRING"
    rows = [line() + ("A",), line() + ("A",), line() + ("B",)]
    assert C.dedup(C.standardize(frame(spark, rows, schema))).count() == 2


def test_winsorize_matches_linear_quantile(spark):
    qs = [float(i) for i in range(1, 201)] + [5000.0]
    rows = [line(inv=str(i), qty=q, price=q / 10) for i, q in enumerate(qs)]
    out = C.clean(frame(spark, rows))
    cap_q = float(np.quantile(np.array(qs), 0.995))
    assert math.isclose(out.agg(F.max("Quantity")).first()[0], cap_q, rel_tol=1e-12)
    assert math.isclose(out.agg(F.max("UnitPrice")).first()[0], float(np.quantile(np.array(qs) / 10, 0.995)),
                        rel_tol=1e-12)


def test_fixture_counts_match_fixtures_md(spark):
    raw = raw_transactions(spark, SF_SMALL)
    assert raw.count() == 6142
    assert raw.dropDuplicates().count() == 6000
    assert raw.select("Invoice").distinct().count() == 2170
    cl = C.clean(raw)
    r = cl.agg(F.count(F.lit(1)), F.count_distinct("CustomerID"), F.count_distinct("Invoice"),
               F.count_distinct("StockCode"), F.count_distinct("Description")).first()
    assert tuple(r) == (4483, 136, 1331, 196, 216)


def test_clean_report_adds_up(spark):
    rep = C.clean_report(raw_transactions(spark, SF_SMALL)).first()
    removed = (rep.duplicates_removed + rep.missing_customer_removed + rep.empty_description_removed
               + rep.bad_date_removed + rep.invalid_removed + rep.non_product_removed)
    assert rep.start_rows == 6142 and rep.end_rows == 4483
    assert removed == rep.rows_removed == 6142 - 4483
    assert rep.pct_removed == round(100 * (6142 - 4483) / 6142, 2)


def test_cleaning_idempotent_apart_from_caps(spark):
    cl = C.clean(raw_transactions(spark, SF_SMALL))
    again = C.finalize(C.pre_cap(cl.withColumnRenamed("UnitPrice", "Price")
                                 .withColumn("SourceSheet", F.lit("A"))))
    assert again.count() == cl.dropDuplicates().count()


def test_date_reading_tries_each_text_once_and_counts_its_rows(spark):
    from tillroll.operators import cleaning as CL
    # three texts read day first only, one month first only, but on more rows
    rows = [("13/02/2011",), ("14/02/2011",), ("15/02/2011",)] + [("02/16/2011",)] * 4 + [("x",), (None,)]
    df = spark.createDataFrame(rows, "InvoiceDate STRING")
    assert CL.date_reading(df) == "mdy"
    assert CL.date_reading(df.limit(0)) == "ymd"
    seen = []
    plain = CL.date_text
    CL.date_text = lambda c, r: seen.append(r) or plain(c, r)
    try:
        assert CL.date_reading(df.where("InvoiceDate <> '02/16/2011'")) == "dmy" and sorted(seen) == ["dmy", "mdy", "ymd"]
    finally:
        CL.date_text = plain
