"""Sources and sinks.

Readers return raw-export DataFrames (column names as exported); sinks write
any frame. CSV text is read as strings and converted by column name with
``try_cast`` so a bad value becomes NULL (and is dropped by cleaning)
instead of failing the job under ANSI mode.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import bounded_tasks

NUMERIC_RAW = ("Quantity", "Price", "UnitPrice", "Customer ID", "CustomerID")
SPREADSHEET = (".xlsx", ".xls")
PART_SUFFIXES = (".csv", ".parquet", ".pq", ".txt")


def _suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/").lower())[1]


def typed(df: DataFrame) -> DataFrame:
    """Numeric columns of an export by name; text that is no number becomes NULL."""
    conv = {c: F.trim(F.col(c)).try_cast("double") for c in df.columns if c in NUMERIC_RAW}
    return df.withColumns(conv) if conv else df


def _csv_reader(spark: SparkSession, encoding: str, multi_line: bool):
    """Quoted fields as the common CSV dialect has them: doubled quotes, commas and line feeds inside."""
    return (spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("multiLine", multi_line))


def read_csv(spark: SparkSession, path: str, encoding: str = "ISO-8859-1", multi_line: bool = True) -> DataFrame:
    """Header CSV in the export's encoding; numeric columns converted by name.

    ``multi_line`` reads quoted line feeds; a file is then one task. ``multi_line=False`` lets Spark split large files of exports
    that are known to have none; ``csv_records.read_split`` splits files that have some.
    """
    return typed(_csv_reader(spark, encoding, multi_line).csv(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S4."""
    return spark.read.parquet(path)


def read_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Dispatch on ``fmt`` or the path suffix; reject unsupported types."""
    kind = fmt or {".csv": "csv", ".parquet": "parquet", ".pq": "parquet"}.get(_suffix(path))
    if kind == "csv":
        return read_csv(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path)
    if _suffix(path) in SPREADSHEET:
        raise ValueError(f"{path}: spreadsheets are not read; save the sheets as CSV or Parquet parts")
    raise ValueError(f"{path}: neither CSV nor Parquet by its suffix; name the format with fmt=")


def list_parts(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(name, path) of the folders and files directly below ``root``; a file's known extension is no part of its name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = []
    for s in fs.listStatus(path):
        name = s.getPath().getName()
        if not name.startswith(("_", ".")):
            stem, ext = os.path.splitext(name)
            parts.append((stem if s.isFile() and ext.lower() in PART_SUFFIXES else name, s.getPath().toString()))
    return sorted(parts)


def read_tagged_parts(spark: SparkSession, root: str, fmt: str = "parquet", tag: str = "SourceSheet", encoding: str = "UTF-8",
                      multi_line: bool = True) -> DataFrame:
    """Read every part below ``root`` with its own header or schema and tag its rows with the part's name.

    Each immediate sub-folder (or file) of ``root`` is one part (one sheet of a multi-sheet export). Parts are united by
    column name; a column that a part lacks is NULL there.
    """
    parts = list_parts(spark, root)
    if not parts:
        raise ValueError(f"no parts below {root}")
    out = None
    for name, path in parts:
        part = (_csv_reader(spark, encoding, multi_line).option("recursiveFileLookup", True).csv(path) if fmt == "csv"
                else spark.read.option("recursiveFileLookup", True).format(fmt).load(path))
        part = part.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return typed(out) if fmt == "csv" else out


def write_parquet(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Overwrite a Parquet table (parents created), optionally partitioned. A task's rows, which are sorted by partition, are bounded."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    with bounded_tasks(df.sparkSession, df):
        w.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, UTF-8, timestamps as ``yyyy-MM-dd HH:mm:ss``, whitespace kept. What a task holds is bounded, as in :func:`write_parquet`."""
    w = (df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("quote", '"').option("escape", '"')
         .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").option("timestampFormat", "yyyy-MM-dd HH:mm:ss")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    with bounded_tasks(df.sparkSession, df):
        w.csv(path)


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    """Load a model saved by :func:`save_model` (``cls`` = the model class)."""
    return cls.load(path)
