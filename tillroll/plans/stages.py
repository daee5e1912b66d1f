"""Stage tables: the cleaned and featured lines, written once per session.

Every downstream result reads the featured table. Writing it as Parquet in
the shared checkpoint folder cuts the lineage (an executor loss replays
from the written files, not from the raw join) and lets each later query
prune to the columns it needs. ``stage`` is the read-through snapshot of
the reference's pipeline: read if complete, else build and write. A stage's
path names what it was built from (input files with length and time, plan,
configuration), so new input never meets an old stage.
"""

from __future__ import annotations

import hashlib
import threading

from pyspark.sql import DataFrame, SparkSession

from tillroll.config import DEFAULT, Config
from tillroll.operators.cleaning import finalize, judged, judged_report, kept, pre_cap, winsorize
from tillroll.operators.features import engineer
from tillroll.session import bounded_tasks, scratch_path
from tillroll.sources.fixture import raw_transactions

_MEMO: dict = {}
# stages are built once even when queries are submitted from several threads
LOCK = threading.RLock()


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def _listing(spark: SparkSession, folder: str) -> list[str]:
    """Path, length and time of the files below a folder (or of one file)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out, todo = [], [path] if fs.exists(path) else []
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                out.append(f"{s.getPath()}|{s.getLen()}|{s.getModificationTime()}")
    return sorted(out)


def identity(spark: SparkSession, df: DataFrame, cfg: Config = DEFAULT) -> str:
    """Names what a table is read from: its files (path, length, time), its plan and the configuration."""
    files = df.inputFiles()
    plan = df._jdf.queryExecution().analyzed()
    seen = [x for d in sorted({f.rpartition("/")[0] for f in files}) for x in _listing(spark, d)] if files else [str(df.semanticHash())]
    return hashlib.sha1("\n".join([*seen, plan.canonicalized().toString(), repr(cfg)]).encode()).hexdigest()[:16]


def stage(spark: SparkSession, path: str, build, partition_by: str | None = None) -> DataFrame:
    """Read ``path`` if a complete write exists there, else build, write and read it."""
    if not _exists(spark, path):
        df = build()
        w = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            w = w.partitionBy(partition_by)
        with bounded_tasks(spark, df):
            w.parquet(path)
    return spark.read.parquet(path)


def _key(spark: SparkSession, sf_dir: str, cfg: Config, name: str) -> str:
    app = spark.sparkContext.applicationId
    files = "\n".join(_listing(spark, sf_dir))
    h = hashlib.sha1(f"{app}|{sf_dir}|{files}|{cfg!r}|{name}".encode()).hexdigest()[:16]
    return f"{name}-{h}"


def raw_frame(spark: SparkSession, sf_dir: str, spaced_names: bool = False) -> DataFrame:
    """The raw export lines derived from ``sf_dir``, written once as Parquet (the
    export file a user would upload); ``spaced_names`` gives the export's
    ``Customer ID`` spelling."""
    key = _key(spark, sf_dir, DEFAULT, "raw")
    with LOCK:
        if key not in _MEMO:
            _MEMO[key] = stage(spark, scratch_path(spark, "stages", key), lambda: raw_transactions(spark, sf_dir))
    raw = _MEMO[key]
    return raw.withColumnsRenamed({"CustomerID": "Customer ID"}) if spaced_names else raw


def staged_clean(spark: SparkSession, raw: DataFrame, path: str, cfg: Config = DEFAULT) -> DataFrame:
    """Cleaning with the lines before the caps written once: the caps (a global
    aggregate) and the capped lines both read that stage, so the raw join and
    the whole-row dedup shuffle run once instead of once per consumer. The capped
    lines are a projection of it with two known numbers and are not written again.
    An invoice's lines lie side by side in it: later groupings by invoice combine before
    they shuffle, and what the lines of an invoice share takes little room."""
    pre = stage(spark, f"{path}-precap", lambda: pre_cap(raw, cfg).sortWithinPartitions("Invoice"))
    return finalize(winsorize(pre, cfg))


def staged_clean_report(spark: SparkSession, raw: DataFrame, path: str, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(clean lines, cleaning report): the raw input is read and deduplicated once for both, into a stage of judged rows; the report
    reads two columns of it."""
    rows = stage(spark, f"{path}-judged", lambda: judged(raw, cfg))
    return stage(spark, path, lambda: finalize(winsorize(kept(rows, cfg), cfg))), judged_report(rows)


def clean_frame(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    key = _key(spark, sf_dir, cfg, "clean")
    with LOCK:
        if key not in _MEMO:
            # read the raw source directly: the pre-cap stage already cuts the lineage
            _MEMO[key] = staged_clean(spark, raw_transactions(spark, sf_dir), scratch_path(spark, "stages", key),
                                      cfg)
    return _MEMO[key]


def featured_frame(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT) -> DataFrame:
    key = _key(spark, sf_dir, cfg, "featured")
    with LOCK:
        if key not in _MEMO:
            _MEMO[key] = stage(spark, scratch_path(spark, "stages", key),
                               lambda: engineer(clean_frame(spark, sf_dir, cfg), cfg))
    return _MEMO[key]


def customer_frame(spark: SparkSession, sf_dir: str, name: str, build, cfg: Config = DEFAULT) -> DataFrame:
    """A per-customer table derived from the featured lines, written once per session.

    Several results read the same per-customer table (guards, splits, status
    counts, histograms); staging it means the line table is scanned and
    shuffled by customer once, not once per consumer.
    """
    key = _key(spark, sf_dir, cfg, f"cust-{name}")
    with LOCK:
        if key not in _MEMO:
            _MEMO[key] = stage(spark, scratch_path(spark, "stages", key),
                               lambda: build(featured_frame(spark, sf_dir, cfg)))
    return _MEMO[key]
