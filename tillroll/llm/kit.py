"""Spark helpers shared by the operators of this subpackage.

* tables are opened with Spark's own reader, so any path that Spark knows works;
* intermediate tables are written below ``spark.checkpoint.dir`` (``session.scratch_path``);
* a text is named by two 64-bit hashes, so copies can be told without moving texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import scratch_path

#: bytes of a batch that Spark hands to a Python task
BATCH_BYTES = 4 << 20
T1, T2 = "__text_1", "__text_2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes: whole texts are long, and 10,000 rows of them
    would put hundreds of MB into one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def write(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it back."""
    path = scratch_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables of :func:`write` whose readers are all written themselves."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def text_hash(col: str = "text") -> Column:
    return F.xxhash64(text_of(col))


def text_ids(col: str = "text") -> list[Column]:
    """Two independent 64-bit hashes that name a text (null counts as empty)."""
    return [text_hash(col).alias(T1), F.xxhash64(F.lit(20_011), text_of(col)).alias(T2)]


def text_name(docs: DataFrame, col: str = "text") -> Column:
    """One 64-bit name a different text. Hashes that two different texts share (about n^2 / 2^65 of n texts) are found by a second,
    independent hash in one pass over the table, and their texts are named by both."""
    a, b = text_ids(col)
    pairs = docs.select(a, b).groupBy(T1).agg(F.min(T2).alias("low"), F.max(T2).alias("high")).where("low <> high").select(T1)
    twins = [r[0] for r in pairs.collect()]
    one = text_hash(col)
    both = F.xxhash64(F.lit(20_011), text_of(col), one)
    return (F.when(one.isin(twins), both).otherwise(one) if twins else one).alias(T1)


def bit_rows(df: DataFrame, col: str, bits: int) -> np.ndarray:
    """Bitmap of the numbers 0 .. 2**bits - 1 in a column (little-endian bits), put together by Spark from pieces of 4 kB."""
    at = F.col(col) + 1  # bucket numbers begin with 1
    rows = df.groupBy(F.bitmap_bucket_number(at).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros((max(1, 1 << bits >> 15), 4096), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def distinct_texts(docs: DataFrame, extra: Iterable[Column] = ()) -> DataFrame:
    """(T1, T2, text, copies): one row per different text, hash-partitioned by its name.
    Copies collapse before the shuffle, so a text that a third of the rows share stays one row a task."""
    return (docs.select(*text_ids(), text_of().alias("text"), *extra)
            .groupBy(T1, T2).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")))


def keep_on_disk(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Persist on disk with the partitioning it has, so later joins on the same keys don't shuffle it again.
    Lost parts are computed anew by Spark; call ``unpersist`` when done."""
    from pyspark import StorageLevel

    conf = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"
    old = spark.conf.get(conf, "true")
    spark.conf.set(conf, "false")
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        spark.conf.set(conf, old)


#: a key that holds more than 1 / HOT of all rows is dealt over SALTS tasks by :func:`join_spread`
HOT, SALTS = 1000, 64
#: names (8 bytes each) that may be broadcast; more are joined by a shuffle
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """``df`` (one long a row, written before) with a broadcast hint if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join_spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``rows``, many to a key, with ``table``, one row a key. Keys that hold more than 1 / HOT of the rows (so fewer than
    HOT keys) are salted: their rows are dealt over SALTS tasks and their table row is copied to each."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    total = rows.count()
    hot = [r[0] for r in sizes.where((F.col("c") * HOT > total) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return rows.join(table, key, how)
    salted = F.col(key).isin(hot)
    left = rows.withColumn("__salt", F.when(salted, F.floor(F.rand(1) * SALTS).cast("int")).otherwise(0))
    right = table.withColumn("__salt", F.explode(F.when(salted, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "__salt"], how).drop("__salt")


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): connected components of ``edges`` (u, v), root = smallest node; roots are no rows of their own.

    Alternating large-star and small-star steps: each is one aggregate with map-side minimum and one join,
    so a hub with any number of neighbours is never gathered in one task. Ends when the edges are stars: each node has one
    parent, and no parent has one.
    """
    now = write(spark, edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(rounds):
        roles = now.select(F.col("u").alias("x"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(now.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("x").agg(F.sum("low").alias("low"), F.max("top").alias("top")).where("low > 1 or (low > 0 and top > 0)").limit(1).count() == 0:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct().select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        stars = (down.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*"))
        last, now = now, write(spark, stars.where("u <> v").distinct(), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components: no fixed point in {rounds} rounds")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.scratch = now.scratch
    return out


def grow(spark: SparkSession, known: DataFrame, edges: DataFrame) -> DataFrame:
    """The components ``known`` (node, root) with further ``edges`` (u, v): only edges between different components are followed."""
    of = known.withColumnRenamed("node", "u").withColumnRenamed("root", "ru")
    ends = edges.join(of, "u", "left").join(of.toDF("v", "rv"), "v", "left")
    new = write(spark, ends.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")).where("u <> v").distinct(), "joins")
    if new.isEmpty():
        discard(new)
        return known
    more = components(spark, new)
    moved = known.join(more.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = write(spark, moved.union(more.select("node", "root")), "roots")
    discard(new, more, known)
    return out
