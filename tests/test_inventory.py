"""Inventory trend statistics against a brute-force zero-filled daily series."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd

from tillroll.operators import inventory as INV

BASE = dt.datetime(2011, 1, 1, 10, 0)


def brute(daily: dict[int, float]) -> dict:
    """The reference's per-SKU algorithm on an explicit zero-filled series."""
    first, last = min(daily), max(daily)
    s = pd.Series([daily.get(d, 0.0) for d in range(first, last + 1)], dtype="float64")
    if len(s) < 30:
        recent = s.mean()
        prior = recent
    else:
        recent = s.tail(30).mean()
        sl = s.iloc[-60:-30]
        prior = sl.mean() if len(sl) else recent
    pct = (recent - prior) / prior if prior else 0.0
    std = s.tail(60).std() if len(s) >= 2 else 0.0
    std = 0.0 if pd.isna(std) else std
    return {"recent": recent, "prior": prior, "pct": pct, "std": std, "span": len(s), "total": s.sum()}


def test_trend_matches_zero_filled_series(spark):
    rng = random.Random(7)
    spans = [1, 2, 29, 30, 31, 45, 59, 60, 61, 75, 119, 120, 200]
    rows, expected = [], {}
    for i, span in enumerate(spans):
        code = f"SKU{i:03d}"
        days = {0: float(rng.randint(1, 9)), span - 1: float(rng.randint(1, 9))}
        for d in range(span):
            if rng.random() < 0.4:
                days[d] = days.get(d, 0.0) + rng.randint(1, 20)
        for d, q in days.items():
            rows.append((code, BASE + dt.timedelta(days=d), q))
        expected[code] = brute(days)
    df = spark.createDataFrame(rows, "StockCode STRING, InvoiceDate TIMESTAMP_NTZ, Quantity DOUBLE")
    got = {r.StockCode: r for r in INV.sku_trend(df, INV.top_skus(df, 100)).collect()}
    assert set(got) == set(expected)
    for code, e in expected.items():
        g = got[code]
        assert g.span == e["span"], code
        for k in ("recent", "prior", "pct"):
            assert math.isclose(getattr(g, k), e[k], rel_tol=1e-12, abs_tol=1e-12), (code, k)
        assert math.isclose(g.std, e["std"], rel_tol=1e-9, abs_tol=1e-9), (code, "std")
        assert math.isclose(g.total_qty, e["total"], rel_tol=1e-12)


def test_recommendation_rules(spark):
    # one SKU rising (prior 1/day, recent 2/day over 60+ days), one flat, one falling
    rows = []
    for code, prior_q, recent_q in (("UP", 1.0, 2.0), ("FLAT", 3.0, 3.0), ("DOWN", 4.0, 1.0)):
        for d in range(70):
            q = recent_q if d >= 40 else prior_q
            rows.append((code, f"{code} item", BASE + dt.timedelta(days=d), q))
    df = spark.createDataFrame(rows, "StockCode STRING, Description STRING, InvoiceDate TIMESTAMP_NTZ, Quantity DOUBLE")
    out = {r.StockCode: r for r in INV.recommend(df).collect()}
    assert out["UP"].RecommendedAction == "Increase Stock"
    assert out["FLAT"].RecommendedAction == "Maintain Stock" and out["FLAT"].PctChange == 0.0
    assert out["DOWN"].RecommendedAction == "Reduce Stock"
    assert out["UP"].Confidence == 0.95                    # 0.5 + 0.4 * 1.0 + 0.05, capped
    assert out["FLAT"].SuggestedReorderQty == 21            # 3/day * 7 days, no variance
    summ = INV.summary(spark.createDataFrame(list(out.values()))).first()
    assert (summ.increase_count, summ.maintain_count, summ.reduce_count) == (1, 1, 1)


def test_most_frequent_description_ties_smallest(spark):
    rows = [("A", "b"), ("A", "a"), ("A", "b"), ("A", "a"), ("B", "z"), ("B", "y"), ("B", "z")]
    df = spark.createDataFrame(rows, "StockCode STRING, Description STRING")
    got = {r.StockCode: r.Description for r in INV.sku_description(df).collect()}
    assert got == {"A": "a", "B": "z"}


def test_table_text(spark):
    inv = spark.createDataFrame([("X", "x", 1.0, 1.0, 0.1234, "Increase Stock", 0.55, 7)],
                                "StockCode STRING, Description STRING, RecentAvgDailyQty DOUBLE, "
                                "PriorAvgDailyQty DOUBLE, PctChange DOUBLE, RecommendedAction STRING, "
                                "Confidence DOUBLE, SuggestedReorderQty BIGINT")
    r = INV.table(inv).first()
    assert (r.PctChange, r.Confidence) == (f"{round(12.34, 1)}%", f"{int(round(55.00000000000001))}%")
    assert np.isclose(float(r.PctChange[:-1]), 12.3)
