"""Token ids as packed binary matrices: best fit decreasing with a segment tree over capacities.

Every task packs the documents of its own partition, ``POOL`` ids at a time, so no text or id is shuffled and memory is
bounded; a pool leaves at most a few sequences partly filled. A segment tree over the capacities 0..C counts
the open sequences with each rest; the smallest rest that holds a piece is found in log2(C) steps. Overlong
documents are cut into pieces that together are the document (``start`` tells where each begins).

One row is one sequence: ``ids`` (C little-endian unsigned 32-bit ids, padded with the pad id), ``ends`` (cumulative segment lengths,
from 0), ``positions`` (C little-endian unsigned 32-bit positions, from 0 again in each segment and in the padding), and
doc_id, piece and start of each segment. ``write_packed`` stores the rows as Parquet; :func:`unpack` gives the documents back.

Defined results: a null or empty text is a segment of the end id alone; repeated rows and null ids stay; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, tokens
from tillroll.llm.op04_best_fit_packing import piece_lengths

CAPACITY = 2048
END_ID = 50256
PAD_ID = 50256
#: ids that a task packs at once
POOL = 2 << 20
SCHEMA = ("part int, sequence long, n_ids int, doc_ids array<long>, pieces array<int>, starts array<long>, "
          "ends array<int>, ids binary, positions binary")


class CapacityTree:
    """Counts of open sequences by rest, summed in a binary tree."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.size)

    def add(self, rest: int, by: int) -> None:
        i = self.size + rest
        while i:
            self.sums[i] += by
            i >>= 1

    def smallest(self, need: int) -> int:
        """The smallest rest of an open sequence that is at least ``need``; -1 if there is none."""
        i = self.size + need
        if self.sums[i]:
            return need
        while i > 1 and (i & 1 or not self.sums[i + 1]):
            i >>= 1
        if i <= 1:
            return -1
        i += 1
        while i < self.size:
            i = 2 * i if self.sums[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Sequences as lists of indexes into ``lengths``."""
    tree, bins = CapacityTree(capacity), []
    by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        rest = tree.smallest(n)
        if rest < 0:
            at, rest = len(bins), capacity
            bins.append([i])
        else:
            at = by_rest[rest].pop()
            tree.add(rest, -1)
            bins[at].append(i)
        by_rest[rest - n].append(at)
        tree.add(rest - n, 1)
    return bins


def _matrices(path: str, capacity: int, end_id: int, pad_id: int):
    names = ["sequence", "n_ids", "doc_ids", "pieces", "starts", "ends", "ids", "positions"]

    def flush(held, first):
        lengths = np.array([len(x[3]) for x in held], np.int64)
        rows = []
        for k, members in enumerate(best_fit_decreasing(lengths, capacity)):
            ids, positions = np.full(capacity, pad_id, "<u4"), np.empty(capacity, "<u4")
            ends = np.concatenate(([0], np.cumsum(lengths[members])))
            for m, lo, hi in zip(members, ends[:-1], ends[1:], strict=True):
                ids[lo:hi] = held[m][3]
                positions[lo:hi] = np.arange(hi - lo)
            positions[ends[-1]:] = np.arange(capacity - ends[-1])
            rows.append((first + k, int(ends[-1]), [held[m][0] for m in members], [held[m][1] for m in members],
                         [held[m][2] for m in members], ends.tolist(), ids.tobytes(), positions.tobytes()))
        return rows

    def batches_of(rows):
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for lo in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[lo:lo + 256], strict=True), kinds, strict=True)], names=names)

    def run(batches):
        held, size, done = [], 0, 0
        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for r, ids in tokens.rows_of_ids(b.column("text"), path, added=True):
                ids = np.append(ids, np.uint32(end_id))
                at = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    held.append((doc_ids[r], k, at, ids[at:at + n]))
                    at += n
                size += len(ids)
                if size >= POOL:
                    rows = flush(held, done)
                    held, size, done = [], 0, done + len(rows)
                    yield from batches_of(rows)
        if held:
            yield from batches_of(flush(held, done))
    return run


def packed_matrices(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = PAD_ID) -> DataFrame:
    """One row a packed sequence (see the module): part, sequence, n_ids, doc_ids, pieces, starts, ends, ids, positions."""
    kit.small_batches(docs.sparkSession)
    cols = SCHEMA.removeprefix("part int, ")
    return (docs.select(F.col("doc_id").cast("long"), kit.text_of().alias("text"))
            .mapInArrow(_matrices(path or tokens.default_path(), capacity, end_id, pad_id), cols)
            .select(F.spark_partition_id().alias("part"), "*"))


def write_packed(packed: DataFrame, path: str) -> None:
    packed.write.mode("overwrite").parquet(path)


def unpack(packed: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): the documents that a packed table holds; rows of one doc_id that are equal stay apart only
    if their ids are unique."""
    def run(batches):
        for b in batches:
            out = []
            for docs, pieces, starts, ends, raw in zip(*(b.column(c).to_pylist() for c in ("doc_ids", "pieces", "starts", "ends", "ids")), strict=True):
                ids = np.frombuffer(raw, "<u4")
                out += [(d, p, s, ids[lo:hi].tobytes()) for d, p, s, lo, hi in zip(docs, pieces, starts, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(
                zip(*out, strict=True) if out else [[]] * 4, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "part_ids"])
    parts = packed.mapInArrow(run, "doc_id long, piece int, start long, part_ids binary")
    return (parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "part_ids"))).alias("p"))
            .select("doc_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.part_ids))").alias("ids")))


def op8_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_matrices(kit.table(spark, sf_dir, "documents"))
