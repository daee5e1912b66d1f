"""Document fingerprints: content-defined chunks under a gear hash, as a set of digests weighted by length.

Chunk ends follow the bytes (normalised chunking: a stricter condition before the normal size, a laxer one after it, and a
largest size), so an inserted or deleted passage shifts no boundary but those near it. A fingerprint is the sorted set of
(48-bit digest, length) of the chunks, in base64. Likeness is the length of the shared chunks over that of the longer
set: containment in the longer text, 1 for equal texts, 0 if nothing is shared.

:func:`next_to` gives each document the one that follows it by id: ids are dealt into ranges by approximate quantiles (a bounded list),
the first row of each range is also sent to the range before it, and each range is read in order, one row held at a time. Texts cross the
network once.

Defined results: a null text is empty and has the empty fingerprint; two empty ones are alike (1), an empty and another are not (0);
null ids come first, repeated ids follow each other in the order of their text's hash; the last row's next is
the first (a single row's is itself); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan

SMALLEST, NORMAL, LARGEST = 24, 80, 320
#: zero bits asked of the hash before and after the normal size
STRICT, LAX = 8, 5
GEAR = (scan._splitmix(256, 6) >> np.uint64(32)).astype(np.uint32)
U = np.uint64


def _gear(buf: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint32(k))  # the right side is evaluated before it is stored
    return h


def chunk_ends(buf: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, the last is its length."""
    n = len(buf)
    lax = []
    for lo in range(0, n, scan.SLAB):
        a = max(0, lo - 31)
        h = _gear(buf[a:lo + scan.SLAB])[lo - a:]
        at = np.flatnonzero(h >> np.uint32(32 - LAX) == 0)
        lax.append(np.stack((at + lo + 1, h[at] >> np.uint32(32 - STRICT) == 0)))
    if not lax:
        return np.zeros(0, np.int64)
    ends, strict = np.concatenate(lax, axis=1)
    hard, soft = ends[strict > 0].tolist(), ends.tolist()
    out, at, i, j = [], 0, 0, 0
    while n - at > SMALLEST:
        i = bisect_left(hard, at + SMALLEST, i)
        if i < len(hard) and hard[i] <= at + NORMAL:
            at = hard[i]
        else:
            j = bisect_left(soft, at + NORMAL + 1, j)
            at = min(soft[j] if j < len(soft) else n, at + LARGEST, n)
        out.append(at)
    if at < n:
        out.append(n)
    return np.array(out, np.int64)


def fingerprint(raw: bytes) -> np.ndarray:
    """Sorted distinct (digest << 16 | length) of the chunks."""
    buf = np.frombuffer(raw, np.uint8)
    end = chunk_ends(buf)
    if not len(end):
        return np.zeros(0, U)
    start = np.concatenate(([0], end[:-1]))
    a, b = scan.spans_of(buf, start, end - start)
    x = np.sort(scan.mix(a + (b ^ (b << U(21)))) >> U(16) << U(16) | (end - start).astype(U))
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def encode(x: np.ndarray) -> str:
    return base64.b64encode(x.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Length of the shared chunks over that of the longer set."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    size = lambda z: int((z & U(0xFFFF)).sum())
    return size(x[y[at] == x]) / max(size(x), size(y))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


def next_to(docs: DataFrame) -> DataFrame:
    """Rows (range, tail, doc_id, text) sorted inside partitions: each range's rows by id, then (tail 1) the first row of the next range."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", kit.text_of().alias("text"), *kit.text_ids())
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = docs.select(F.percentile_approx(F.col("doc_id").cast("double"), F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(20 * parts)).alias("q"))
    cuts = sorted(set(spread.first().q or ()))
    if cuts:  # a null id goes before all others
        buckets = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="__id", outputCol="__range")
        rows = buckets.transform(rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))).withColumn("range", F.col("__range").cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    order = [F.col("doc_id").isNotNull().alias("known"), "doc_id", kit.T1, kit.T2]
    firsts = rows.groupBy("range").agg(F.min(F.struct(*order)).alias("f")).orderBy("range").collect()  # a row a range
    if not firsts:
        return rows.select("range", F.lit(0).alias("tail"), "doc_id", "text")
    tails = [(firsts[i - 1].range, r.f.doc_id, r.f[kit.T1], r.f[kit.T2]) for i, r in enumerate(firsts)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    tails = spark.createDataFrame(tails, f"to int, f0 {kind}, f1 long, f2 long")
    copies = (rows.join(F.broadcast(tails), rows.doc_id.eqNullSafe(tails.f0) & (rows[kit.T1] == tails.f1) & (rows[kit.T2] == tails.f2))
              .select(F.col("to").alias("range"), F.lit(1).alias("tail"), "doc_id", "text", kit.T1, kit.T2))
    both = rows.select("range", F.lit(0).alias("tail"), "doc_id", "text", kit.T1, kit.T2).union(copies)
    return (both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range", "tail", F.asc_nulls_first("doc_id"), kit.T1, kit.T2)
            .select("range", "tail", "doc_id", "text"))


def _prints(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = kind = None
    for b in batches:
        out, kind = [], b.schema.field("doc_id").type
        for bucket, tail, i, text in zip(*(b.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")), strict=True):
            if held is not None and held[0] == bucket:
                here = held[3] if tail and text == held[2] else fingerprint(text.encode())
                new = edited(held[2], text)
                raw = new.encode()
                changed = fingerprint(raw)
                out.append((held[1], len(held[2]), hashlib.sha256(raw).hexdigest(), encode(held[3]), encode(changed), likeness(held[3], changed), likeness(held[3], here)))
                held = None if tail else (bucket, i, text, here)
            elif not tail:
                held = (bucket, i, text, fingerprint(text.encode()))
        kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)], names=names)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    kit.small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return next_to(docs).mapInArrow(_prints, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                             "near_edited double, near_next double")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(kit.table(spark, sf_dir, "documents"))
