"""File-stream landing of new export files (the upload path, run continuously).

New data arrives as new export files, often with back-dated lines. The stream only lands their rows, as text and unchanged, in a
Parquet table (exactly once, by the checkpoint); nothing is filtered, deduplicated or dropped by time. Cleaning, with whole-row dedup and
the global caps, is the batch stage's: :func:`landed` gives it the table with numeric columns converted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillroll.sources.io import typed

RAW_CSV_SCHEMA = ("Invoice STRING, StockCode STRING, Description STRING, Quantity STRING, InvoiceDate STRING, "
                  "Price STRING, `Customer ID` STRING, Country STRING")


def start_landing(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, available_now: bool = True,
                  encoding: str = "UTF-8") -> StreamingQuery:
    """Stream CSV export files from ``source_dir`` into a Parquet table of their rows."""
    raw = (spark.readStream.schema(RAW_CSV_SCHEMA).option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
           .option("multiLine", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(source_dir))
    w = raw.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start(sink_dir)


def landed(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The landed rows, for ``cleaning.clean``."""
    return typed(spark.read.parquet(sink_dir))
