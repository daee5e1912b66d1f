"""KLL quantiles against exact ranks."""

import random

from pyspark.sql import functions as F

from tillroll.operators import sketches as SK

PROBS = (0.0, 0.05, 0.5, 0.9, 0.99, 1.0)


def test_merged_cells_keep_the_rank_error(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["A", "A", "A", "B"]), rng.randrange(12), rng.lognormvariate(0, 3)) for _ in range(40_000)]
    df = spark.createDataFrame(rows + [("B", 3, None), ("B", 3, float("nan")), ("E", 1, None)], "c string, m int, v double").repartition(6)
    cells = SK.sketch_cells(df, ("c", "m"), ("v",)).cache()
    for part, keep in ((cells, lambda r: True), (cells.where("c = 'A' and m < 7"), lambda r: r[0] == "A" and r[1] < 7)):
        values = sorted(r[2] for r in rows if keep(r))
        for r in SK.approx_quantiles(part, ("v",), PROBS).collect():
            assert r.n == len(values)
            assert values.index(r.value) / r.n - 2 * SK.rank_error() <= r.q <= (values.index(r.value) + 1) / r.n + 2 * SK.rank_error()
            assert r.q > 0 or r.value == values[0]
            assert r.q < 1 or r.value == values[-1]
    got = SK.approx_quantiles(cells, ("v",), PROBS, by=("c",)).cache()
    assert {(r.n, r.value) for r in got.where("c = 'E'").collect()} == {(0, None)}
    misses = {r.c: r.miss for r in SK.rank_misses(df.where("not isnan(v)"), got.where("n > 0"), "c", "v", PROBS).collect()}
    assert set(misses) == {"A", "B"} and max(misses.values()) <= 2 * SK.rank_error()
    off = got.where("n > 0").withColumn("value", F.col("value") + 1000)           # a wrong table is told apart
    assert min(r.miss for r in SK.rank_misses(df.where("not isnan(v)"), off, "c", "v", (0.05, 0.5)).collect()) > 0.4


def test_few_values_are_exact_and_no_cells_give_none(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(100)], "g int, v double")
    cells = SK.sketch_cells(df, ("g",), ("v",))
    assert [r.value for r in SK.approx_quantiles(cells, ("v",), (0.25, 0.5, 1.0)).orderBy("q").collect()] == [24.0, 49.0, 99.0]
    assert [(r.n, r.value) for r in SK.approx_quantiles(cells.where("g > 9"), ("v",), (0.5,)).collect()] == [(0, None)]


def test_lines_are_read_once_for_all_columns_and_not_shuffled(spark):
    """the lines were shuffled and sorted by group, a column at a time."""
    from tillroll.session import settings
    rows = [("AAB"[i % 3], float(i % 50), float(i * i % 101), None if i % 2 else 1.0) for i in range(600)] + [("E", 1.0, None, None), (None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "c string, v double, w double, x double").repartition(3)
    got = SK.approx_quantiles(SK.sketch_cells(df, ("c",), ("v", "w", "x")), ("v", "w", "x"), PROBS, by=("c",)).where("n > 0").cache()
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        one = SK.rank_misses(df, got, "c", "w", PROBS)
        assert "SortMergeJoin" not in one._jdf.queryExecution().executedPlan().toString()
        every = SK.column_misses(df, got, "c", ("v", "w", "x"), PROBS)
        assert {(r.c, r.column): r.miss for r in every.collect()} == {
            (r.c, c): r.miss for c in ("v", "w", "x") for r in SK.rank_misses(df, got, "c", c, PROBS).collect()}
        assert {(r.c, r.column) for r in every.collect()} == {(g, c) for g in "AB" for c in "vwx"} | {("E", "v")}
    off = SK.column_misses(df, got.withColumn("value", F.when(F.col("column") == "w", F.col("value") + 1000).otherwise(F.col("value"))), "c", ("v", "w"), (0.05, 0.5))
    assert all((r.miss > 0.4) == (r.column == "w") for r in off.collect())
