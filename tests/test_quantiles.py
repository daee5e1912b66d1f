"""Exact quantiles against Spark's percentile, with the number of jobs that they take."""

import random

from conftest import SF_SMALL
from pyspark.sql import functions as F

from tillroll.operators import cleaning as C
from tillroll.operators.quantiles import exact_quantiles, quantile_row
from tillroll.sources.fixture import raw_transactions

PROBS = [0.0, 0.01, 0.33, 0.5, 0.67, 0.97, 0.99, 0.995, 1.0]


def jobs(spark, run):
    """Result of ``run`` and the number of Spark jobs that it started."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "quantile test")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup("counted"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_equals_exact_percentile(spark):
    rng = random.Random(11)
    columns = {
        "spread": [rng.uniform(-5e3, 5e5) for _ in range(20000)] + [42.0] * 3000 + [1e9],
        "ties": [float(rng.choice([0, 0, 0, 1, 7])) for _ in range(23001)],
        "tiny": [rng.gauss(0, 1e-9) for _ in range(23001)],
        "skewed": [rng.lognormvariate(0, 8) * rng.choice([-1, 1]) for _ in range(23001)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), [*columns]).withColumn("empty", F.lit(None).cast("double"))
    got, n = jobs(spark, lambda: exact_quantiles(df, {c: PROBS for c in [*columns, "empty"]}))
    for c in columns:
        assert [got[c, p] for p in PROBS] == list(df.agg(F.percentile(c, PROBS)).first()[0])
    assert all(got["empty", p] is None for p in PROBS)
    assert n <= 12  # passes, whatever the number of columns; AQE runs a pass as two or three jobs


def test_nan_and_null_are_left_out(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v DOUBLE")
    assert exact_quantiles(df, {"v": [0.5]}) == {("v", 0.5): 2.0}


def test_caps_of_the_clean_table(spark):
    pre = C.pre_cap(raw_transactions(spark, SF_SMALL)).cache()
    row = quantile_row(pre, "UnitPrice", [0.25, 0.75], ["q1", "q3"]).first()
    assert tuple(row) == tuple(pre.agg(F.percentile("UnitPrice", [0.25, 0.75])).first()[0])
    assert C.cap_values(pre).first().q_cap == pre.agg(F.percentile("Quantity", 0.995)).first()[0]
    pre.unpersist()
