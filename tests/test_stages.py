"""Tasks of stages and sinks are bounded by what they hold, whatever the session's partition settings."""

import pytest
from pyspark.sql import functions as F

from tillroll import session
from tillroll.plans import stages
from tillroll.sources import io

NAMES = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.fixture()
def small_tasks(monkeypatch):
    for name, size in (("TASK_BYTES", 1 << 20), ("SPLIT_BYTES", 1 << 20), ("INPUT_BYTES", 1 << 17)):
        monkeypatch.setattr(session, name, size, raising=False)


def test_tasks_of_a_stage_follow_the_data(spark, tmp_path, small_tasks):
    src = str(tmp_path / "src")
    spark.range(1_200_000).select(F.xxhash64("id").alias("v"), F.lit("x").alias("s")).coalesce(1).write.parquet(src)
    before = {n: spark.conf.get(n, None) for n in NAMES}
    out = stages.stage(spark, str(tmp_path / "out"), lambda: spark.read.parquet(src).dropDuplicates())
    assert out.count() == 1_200_000
    # some 11 MB are shuffled, a task gets 1; with four shuffle partitions, one a core, a task would hold a quarter of the rows at any size
    assert out.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 150_000
    assert {n: spark.conf.get(n, None) for n in NAMES} == before


def test_settings_come_back_after_an_error_and_smaller_ones_stay(spark, tmp_path, small_tasks):
    src = str(tmp_path / "a part, 100%")
    spark.range(10).write.parquet(src)
    df = spark.read.parquet(src)
    old = spark.conf.get(NAMES[1], None)
    spark.conf.set(NAMES[1], "64k")
    try:
        with pytest.raises(RuntimeError), session.bounded_tasks(spark, df):
            assert int(spark.conf.get(NAMES[1])) == 1 << 16
            assert int(spark.conf.get(NAMES[2])) == 1 << 20
            raise RuntimeError
        assert spark.conf.get(NAMES[1]) == "64k"
        assert spark.conf.get(NAMES[2], None) is None
    finally:
        if old is None:
            spark.conf.unset(NAMES[1])
        else:
            spark.conf.set(NAMES[1], old)


def test_a_task_of_a_partitioned_write_is_bounded(spark, tmp_path, small_tasks):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(0, 800_000, 1, 8).select(F.xxhash64("id").alias("v"), (F.col("id") % 3).alias("m")).write.parquet(src)
    io.write_parquet(spark.read.parquet(src), out, partition_by="m")
    back = spark.read.parquet(out)
    assert back.groupBy("m").count().agg(F.max("count")).first()[0] == 266_667
    # eight files of 0.8 MB: a task of four cores would read two of them, and sort 200,000 rows
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 33_334


def test_lines_of_an_invoice_stay_together_from_the_dedup_on(spark, tmp_path):
    """later groupings by invoice combine before they shuffle; equal rows meet in the one shuffle of the dedup."""
    from tests.conftest import SF_SMALL
    from tillroll.operators.cleaning import clean, dedup
    from tillroll.sources.fixture import raw_transactions
    raw = raw_transactions(spark, SF_SMALL)
    with session.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = stages.staged_clean(spark, raw, str(tmp_path / "lines"))
    assert got.exceptAll(clean(raw)).count() == 0 and clean(raw).exceptAll(got).count() == 0
    pre = spark.read.parquet(str(tmp_path / "lines-precap")).select("Invoice", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    assert pre.select("file").distinct().count() > 1
    seen = pre.groupBy("Invoice").agg(F.count_distinct("file").alias("files"), (F.max("at") - F.min("at") + 1 - F.count("at")).alias("between"))
    assert seen.agg(F.max("files"), F.max("between")).first()[:] == (1, 0)
    rows = [(i, d, q) for i in (None, "1") for d in range(40) for q in (0.0, -0.0, float("nan"), 1.0) for _ in (1, 2)]
    odd = spark.createDataFrame(rows, "Invoice string, d int, Quantity double").selectExpr("Invoice", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, d) AS InvoiceDate", "Quantity")
    one = dedup(odd)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert one.count() == 2 * 40 * 3
    with session.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert one.where("Invoice IS NULL").select(F.spark_partition_id()).distinct().count() > 1


def test_tasks_of_a_csv_sink_follow_the_data(spark, tmp_path, small_tasks):
    """the customers' lines are sorted in the tasks that the sink starts; they were as many as the session asks for."""
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(800_000).select(F.xxhash64("id").alias("v")).coalesce(1).write.parquet(src)
    io.write_csv(spark.read.parquet(src).dropDuplicates(), out)
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 800_000
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 150_000
