"""Best-fit packing of all documents into sequences of a fixed capacity, in bulk-synchronous supersteps.

Documents are tokenized where they are; only longer ones than the capacity are cut. The packing works on two sorted lists, the pieces by
length and the open sequences by gap. A length is a whole number up to the capacity, so both lists are kept run-length encoded:
a run of pieces is (length, how many), a run of sequences (gap, first number, how many), which bounds the lists by the capacity
whatever the number of documents. One superstep takes every piece of the largest length left: the sweep looks for the successor
of that length among the sorted gaps, pieces take the sequences there by rank, gaps are updated, and it
repeats with what is left; pieces without a successor open sequences. This is best fit decreasing, done for all pieces of a length at once.

What the supersteps return is a bounded plan (length, ranks -> sequences, offset). The pieces themselves never leave Spark: a piece gets
its rank among those of its length from counts over (length, salt) and a window inside one salt, so a
length that a third of all documents share is dealt over ``SALTS`` tasks, and finds its place in the plan by bisection.

Defined results: a null or empty text is one piece of the end id alone; repeated rows and null ids are packed like any other row;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import kit, tokens

CAPACITY = 2048
END_ID = 0
SALTS = 256


def piece_lengths(n: int, capacity: int) -> list[int]:
    """A document of n ids: one piece, or full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity or capacity
    return [first] + [capacity] * ((n - first) // capacity)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        turn = 0
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for r, ids in tokens.rows_of_ids(b.column("text"), path, added=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                at = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    doc.append(r), piece.append(k), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at:at + n]))
                    at += n
            salt = (turn + np.arange(len(doc))) % SALTS
            turn += len(doc)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(salt.astype(np.int32))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
    return run


def pack_runs(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best fit decreasing on runs. Returns the plan, rows (length, first rank, how many, first sequence, offset)
    in order of length and rank, and the number of sequences."""
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs of sequences (first, how many)
    gaps: list[int] = []
    plan, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            fit = gap // length
            full, rest = divmod(min(left, n * fit), fit)
            for layer in range(fit):
                m = full + (layer < rest)
                if m:
                    plan.append((length, rank, m, first, capacity - gap + layer * length))
                    rank += m
            left -= full * fit + rest
            leave(gap - fit * length, first, full)
            leave(gap - rest * length, first + full, int(rest > 0))
            leave(gap, first + full + (rest > 0), n - full - (rest > 0))
    return np.array(plan, np.int64).reshape(-1, 5), opened


def _places(plan: np.ndarray, bits: int = 42):
    """Sequence and offset of each piece from its length and rank."""
    order = np.lexsort((plan[:, 1], plan[:, 0]))
    plan = plan[order]
    keys = (plan[:, 0] << bits) + plan[:, 1]

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(keys, (length << bits) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(plan[k, 3] + rank - plan[k, 1]), pa.array(plan[k, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def best_fit_packing(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece of a row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    kit.small_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    cols = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = kit.write(spark, docs.select("doc_id", kit.text_of().alias("text"))
                       .mapInArrow(_pieces(path or tokens.default_path(), capacity, end_id), cols + ", salt int"), "pieces")
    counts = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row a length, capacity at most
    plan, _ = pack_runs(total, capacity)
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "salt", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    in_salt = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (pieces.withColumn("in_salt", F.row_number().over(in_salt) - 1).join(before, ["length", "salt"])
              .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("in_salt")).alias("rank")))
    return ranked.mapInArrow(_places(plan), cols + ", sequence_id long, offset long")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(kit.table(spark, sf_dir, "documents"))
