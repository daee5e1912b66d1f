"""Session helpers: a local session for tests/bench, and the shared scratch folder.

Library operators never build a session; they take DataFrames. Only tests,
``bench.py`` and the command-line entry points call :func:`local_session`.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tillroll") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    builder = (builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TILLROLL_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` must point at shared storage and is
    used as is. Only on a local master (one machine, tests) a fresh folder is
    made if it is unset, so lineage cuts and staged tables still have a home.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(folder)
    spark.conf.set("spark.checkpoint.dir", folder)
    return sc.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the shared checkpoint folder (never a node-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, "tillroll", *parts])


@contextmanager
def settings(spark: SparkSession, new: dict):
    """The session with these settings for a while; afterwards they are as before."""
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: what one task of a write may get: shuffled bytes, bytes of its input files; and the input bytes that add a shuffle partition
TASK_BYTES = 24 << 20
SPLIT_BYTES = 64 << 20
INPUT_BYTES = 8 << 20


def _input_bytes(spark: SparkSession, df: DataFrame) -> int:
    """Length of the files that ``df`` is read from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]  # names come URL-encoded
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def _bytes(size: str) -> int:
    """A setting such as ``128MB``, ``16m`` or ``67108864b`` as a number."""
    number, unit = re.match(r"\s*(\d+)\s*([a-z]?)", size.lower()).groups()
    return int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0)


def bounded_tasks(spark: SparkSession, df: DataFrame):
    """While it lasts, shuffle partitions follow the input of ``df`` and are joined up to ``TASK_BYTES`` only, and a task reads ``SPLIT_BYTES``.

    Spark joins small partitions until each core has one, of up to 64 MB: some three million lines, which the sorts of two joins and
    the hash table of the whole-row dedup then hold in one task at once, and spill. A line takes some 20 bytes when shuffled or written and
    ten times as much in memory; a write by partition sorts all that a task reads. Settings of the session that ask for smaller tasks
    stay; all are as before afterwards.
    """
    first, split = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.files.maxPartitionBytes"
    joined = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    parts = max(_input_bytes(spark, df) // INPUT_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get(first, None) or 0))
    return settings(spark, {first: parts, split: min(_bytes(spark.conf.get(split)), SPLIT_BYTES),
                            joined: min(_bytes(spark.conf.get(joined)), TASK_BYTES)})


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Ship this package to the Python workers (``SparkContext.addPyFile``), once per
    application, so per-group Python functions (``applyInPandas``) can import it on
    every executor whatever the working directory or installation there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    target = scratch_path(spark, "pyfiles", f"tillroll-{sc.applicationId}.zip")
    path = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(packed.getvalue())
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
