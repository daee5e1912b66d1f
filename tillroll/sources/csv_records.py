"""CSV files with quoted line feeds, read in splits.

Spark reads the files as lines, many splits a file. Whether a split begins inside quotes is the parity of all quotes before it in
its file: one aggregate counts the quotes of each split, a running sum over the splits (rows, not lines) gives the parity, and
that small table goes back to the lines. Both readings take the settings that make the splits from a session of their own, so
they meet the same splits whatever is set, and however many executors there are, when the records are asked for. A task then joins the lines of a record; what is left open at a split's end meets the heads of
the splits after it in one grouped step over these pieces alone. Records are parsed by Spark's CSV parser (``from_csv``).

The dialect is that of ``io.read_csv``: quotes stand around a field and are doubled inside it. A record with quotes elsewhere is an error,
since it would shift the parity; ``io.read_csv`` reads such files, a file a task. A file whose last quote is never closed is an error too.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import scratch_path
from tillroll.sources.io import _csv_reader, typed

FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
LEGAL = re.compile(f"{FIELD}(?:,{FIELD})*", re.S)
SPLITS = 2_000_000   # rows of the parity table that may be broadcast, some 100 bytes each
WHOLE, OPEN, HEAD, TITLE = 0, 1, 2, 3   # TITLE: the header, left open at the end of its split
PIECES = "file string, start long, kind int, text string"


def _splitting(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` as they are now. A table that it reads keeps its splits: they follow the session that read it."""
    fixed = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            fixed.conf.set(name, value)
    least = "spark.sql.files.minPartitionNum"
    fixed.conf.set(least, str(spark.conf.get(least, None) or spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
                              or spark.sparkContext.defaultParallelism))
    return fixed


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Lines without their line feed, with the file and the start of the split that they begin in; a task has a split's lines in file order."""
    text = F.decode(F.col("value").cast("binary"), encoding)
    return _splitting(spark).read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), text.alias("line"))


def split_parity(lines: DataFrame) -> DataFrame:
    """A row per split: ``inside``, whether it begins within quotes."""
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"')))
    counts = lines.groupBy("file", "start").agg(F.sum(quotes).alias("quotes"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1).alias("inside"))


def _checked(record: str) -> str:
    record = record[:-1] if record.endswith("\r") else record
    if '"' in record and not LEGAL.fullmatch(record):
        raise ValueError(f"quotes within an unquoted field: {record[:200]!r}; io.read_csv reads such files")
    return record


def _join_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of each split: whole records, the head that ends an earlier split's record, and the record left open at the end.

    The first record of a file is its header and no piece.
    """
    at, held, inside, head, title = None, [], False, False, False

    def rest():
        # a split that ends within the quotes that it began in is a head as a whole
        return [(*at, HEAD if head else TITLE if title else OPEN, "\n".join(held))] if at and held else []

    for batch in batches:
        out = []
        for file, start, line, begins in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != at:
                out += rest()
                if begins is None:
                    raise ValueError(f"split {start} of {file} was not there when quotes were counted")
                at, held, inside, head, title = (file, start), [], begins, begins, start == 0
            held.append(line)
            inside ^= line.count('"') % 2 == 1
            if not inside:
                text = "\n".join(held)
                if head:
                    out.append((file, start, HEAD, text))
                elif title:
                    title = text in ("", "\r")
                else:
                    out.append((file, start, WHOLE, _checked(text)))
                held, head = [], False
        yield _pieces(out)
    yield _pieces(rest())


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "start", "kind", "text"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checks the records that were joined from several splits."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for text in texts:  # only the last record of a file can be open still
            if text.count('"') % 2:
                raise ValueError(f"a quote is never closed: {text[:200]!r}")
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([_checked(t) for t in texts], pa.string())],
                                         ["file", "start", "text"])


def records(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """(file, start, text): the records of CSV files, line feeds inside quotes kept; ``start`` is the split in which a record begins."""
    lines = _lines(spark, path, encoding)
    found = scratch_path(spark, "csv-splits", uuid.uuid4().hex)
    split_parity(lines).write.parquet(found)
    parity = spark.read.parquet(found)  # of the caller's session, as is all that is joined to it
    splits = parity.count()
    if splits > SPLITS:
        raise ValueError(f"{splits} splits of {path}; set spark.sql.files.maxPartitionBytes so that there are at most {SPLITS}")
    pieces = (F.broadcast(parity).join(lines, ["file", "start"], "right").select("file", "start", "line", "inside")
              .mapInArrow(_join_lines, PIECES))
    # pieces other than whole records: at most two a split; a record that is left open begins a new group of its file
    order = Window.partitionBy("file").orderBy("start", F.desc("kind"))
    opens = F.col("kind").isin(OPEN, TITLE)
    torn = pieces.where(F.col("kind") != WHOLE).withColumn("n", F.sum(opens.cast("int")).over(order))
    joined = torn.groupBy("file", "n").agg(F.min("start").alias("start"), F.max(F.col("kind") == TITLE).alias("title"),
                                           F.sort_array(F.collect_list(F.struct("start", "text"))).alias("p"))
    text = F.concat_ws("\n", F.transform("p", lambda x: x["text"]))
    closed = joined.where(~F.col("title")).select("file", "start", text.alias("text")).mapInArrow(_close, "file string, start long, text string")
    return pieces.where(F.col("kind") == WHOLE).select("file", "start", "text").unionByName(closed)


def read_split(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """S1 in splits: what ``io.read_csv`` returns (rows in another order), with as many tasks as the files have splits.

    The files have the same header. Blank lines are no records. A CR LF inside quotes stays as it is (the whole-file reader writes LF for it
    in files that end their lines by CR LF).
    """
    names = _csv_reader(spark, encoding, True).csv(path).columns
    fields = ", ".join("`{}` STRING".format(c.replace("`", "``")) for c in names)
    options = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = records(spark, path, encoding).where(F.col("text") != "").select(F.from_csv("text", fields, options).alias("r"))
    return typed(rows.select("r.*"))
