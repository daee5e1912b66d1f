"""Suffix-array dedup: remove every byte that a long repeated string covers, by distributed prefix doubling.

A string of ``length`` bytes (400) that starts at two places is found from the ranks of its positions: the rank of
2h bytes at p is the pair (rank of h bytes at p, rank of h bytes at p + h), longer strings pair ranks at a
growing offset. Spark sorts and groups the pairs; positions whose pair is unique are dropped, the rest go on to the
next length until they are unique or past the threshold. Sorting every byte position of the corpus is what makes
plain doubling dear, so the sort is sparse, without losing a position that matters:

1. 64 bytes: of each ``length``-byte string only its anchor enters, the smallest 64-byte rank in it. Equal strings
   have the same anchor at the same place, so a string whose anchor pair is unique is unique. Anchors whose name is unique by
   compact counts (``support``) never become rows.
2. 273, then 385 bytes: the strings that share an anchor are taken in cells of 128, then 16 neighbouring starts. The bytes
   common to all strings of a cell must repeat, else the cell is dropped; if the bytes that hold all of them repeat, all its strings do.
3. 400 bytes: what is left is compared start by start.

A cell goes on to the next length only if it may add a byte to what is known, or if such a cell needs it as a partner; of cells
that are equal as a whole one goes on for all.

Ranks are 64-bit names computed from the text inside the task that holds it, used in pairs (128 bits); only names and
places are shuffled. Whole texts are collapsed to distinct ones first (a copy counts as an occurrence), texts cross the
network once and stay on disk, partitioned by name. Groups are counted with map-side aggregation and joined back, so a
passage that a third of all documents hold is never gathered in one task.

Defined results: a null text is empty; an empty table gives no rows; texts shorter than ``length`` lose nothing;
rows with equal texts get equal results (each is the other's repeat); null or repeated ids are kept as they are; further columns
are not looked at. Bytes are removed from the UTF-8 form, so a cut may fall inside a character: ``kept_text`` drops such
broken characters, ``kept_sha256`` is of the exact remaining bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan, support

LENGTH = 400
GRAM = 64
#: bits of an anchor's name in the counts that leave out unique ones
NAME_BITS = 56
#: starts, and rows of an Arrow batch, that a task holds at once: both sides of the pipe keep their largest batch
STEP = 1 << 18
#: starts in a cell, by round
STEPS = (128, 16, 1)
KEYS = [kit.T1, kit.T2]


def _anchor_runs(buf: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the strings starting at lo..hi-1 of buf: anchor, first and last start of each run with one anchor."""
    piece = buf[lo:hi + length - 1]
    c = scan.running(piece)
    pos = np.arange(len(piece) - GRAM + 1)
    bits = np.uint64((1 << 22) - 1)
    key = (scan.span(c, pos, pos + GRAM) & ~bits) | pos.astype(np.uint64)
    w = length - GRAM + 1
    n = len(key)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    m = hi - lo
    anchor = (np.minimum(back[:m], ahead[w - 1:w - 1 + m]) & bits).astype(np.int64) + lo
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate(([0], cut))
    return anchor[first], first + lo, np.concatenate((cut, [m])) - 1 + lo


def _runs_of_rows(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor in row, smallest and largest distance of a start before its anchor), in bounded steps."""
    for i, j in scan.slabs(off, STEP):
        base, end = int(off[i]), int(off[j])
        if end - base < length:
            continue
        buf = data[base:end]
        rows, anchors, near, far = [], [], [], []
        edge = off[i:j + 1] - base
        for lo in range(0, len(buf) - length + 1, STEP):
            hi = min(lo + STEP, len(buf) - length + 1)
            a, s0, s1 = _anchor_runs(buf, lo, hi, length)
            # a slab holds many rows: cut the runs at row borders, leave out strings that cross one
            r0 = np.searchsorted(edge, s0, side="right") - 1
            r1 = np.searchsorted(edge, s1, side="right") - 1
            n = r1 - r0 + 1
            k = np.repeat(np.arange(len(a)), n)
            r = r0[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
            x0 = np.maximum(s0[k], edge[r])
            x1 = np.minimum(s1[k], edge[r + 1] - length)
            ok = x0 <= x1
            r, x0, x1, at = r[ok], x0[ok], x1[ok], a[k][ok]
            rows.append(r), anchors.append(at), near.append(at - x1), far.append(at - x0)
        r, at, d0, d1 = map(np.concatenate, (rows, anchors, near, far))
        if len(r) > 1 and len(rows) > 1:  # a run cut by a step of a long row is one run
            new = np.concatenate(([True], (r[1:] != r[:-1]) | (at[1:] != at[:-1])))
            g = np.flatnonzero(new)
            d0, d1 = np.minimum.reduceat(d0, g), np.maximum.reduceat(d1, g)
            r, at = r[g], at[g]
        yield r + i, at - edge[r], d0, d1


def _anchor_counts(length: int):
    """How often each anchor's first name occurs, a copy of a text counting as an occurrence."""
    def found(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            copies = b.column("copies").to_numpy(zero_copy_only=False)
            for r, at, _, _ in _runs_of_rows(data, off, length):
                k1, _ = scan.spans_of(data, off[r] + at, GRAM)
                yield k1 >> np.uint64(64 - NAME_BITS), copies[r]
    return lambda batches: support.blocks(found(batches), NAME_BITS)


def _anchors(length: int, repeated: np.ndarray):
    """The runs whose anchor may occur twice."""
    def run(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            ids = [b.column(x).to_numpy(zero_copy_only=False) for x in (*KEYS, "copies")]
            for r, at, d0, d1 in _runs_of_rows(data, off, length):
                k1, k2 = scan.spans_of(data, off[r] + at, GRAM)
                ok = support.has(repeated, k1 >> np.uint64(64 - NAME_BITS))
                k1, k2, r, at, d0, d1 = (x[ok] for x in (k1, k2, r, at, d0, d1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (scan.signed(k1), scan.signed(k2), ids[0][r], ids[1][r], at, d0, d1, ids[2][r])],
                    names=["k1", "k2", *KEYS, "a", "lo", "hi", "m"])
    return run


def _flat(col: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each element of a list<struct> column, and the struct's fields."""
    off = col.offsets.to_numpy()
    s = col.flatten()
    return (np.repeat(np.arange(len(col)), np.diff(off)),
            {f.name: s.field(k).to_numpy(zero_copy_only=False) for k, f in enumerate(s.type)})


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every (index, value) with lo[index] <= value <= hi[index]."""
    n = hi - lo + 1
    k = np.repeat(np.arange(len(lo)), n)
    return k, lo[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)


def _cells(length: int, step: int):
    """For each cell of the given starts: names of the bytes common to its strings (k) and of the bytes that hold all of them (u)."""
    def run(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            t1, t2 = (b.column(x).to_numpy(zero_copy_only=False) for x in KEYS)
            row, f = _flat(b.column("starts"))
            k, cell = _spread(f["lo"] // step, f["hi"] // step)
            for at in range(0, len(k), STEP):
                x, c = k[at:at + STEP], cell[at:at + STEP]
                r, a = row[x], f["a"][x]
                lo, hi = np.maximum(f["lo"][x], c * step), np.minimum(f["hi"][x], c * step + step - 1)
                k1, k2 = scan.spans_of(data, off[r] + a - c * step, length - step + 1)
                u1, u2 = scan.spans_of(data, off[r] + a - hi, length + hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in (scan.signed(k1), scan.signed(k2), scan.signed(u1), scan.signed(u2), t1[r], t2[r], a, lo, hi, f["m"][x])],
                    names=["k1", "k2", "u1", "u2", *KEYS, "a", "lo", "hi", "m"])
    return run


def _union(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of [left, right), touching ones joined, in order."""
    if not len(left):
        return left, right
    order = np.argsort(left, kind="stable")
    left, right = left[order], np.maximum.accumulate(right[order])
    g = np.flatnonzero(np.concatenate(([True], left[1:] > right[:-1])))
    return left[g], right[np.concatenate((g[1:], [len(left)])) - 1]


def _open_cells(length: int):
    """Names of the repeated cells that cells repeated as a whole don't already cover."""
    def run(batches):
        for b in batches:
            off = b.column("found").offsets.to_numpy()
            _, f = _flat(b.column("found"))
            off = off - off[0]
            out = []
            for i in range(b.num_rows):
                s = slice(off[i], off[i + 1])
                whole, lo, hi = f["whole"][s].astype(bool), (f["a"] - f["hi"])[s], (f["a"] - f["lo"])[s] + length
                left, right = _union(lo[whole], hi[whole])
                x = np.flatnonzero(~whole)
                if len(left):
                    k = np.searchsorted(left, lo[x], side="right") - 1
                    x = x[(k < 0) | (right[np.maximum(k, 0)] < hi[x])]
                out.append(x + off[i])
            x = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(f["k1"][x]), pa.array(f["k2"][x])], names=["k1", "k2"])
    return run


def _cut(length: int, with_text: bool):
    def run(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            m = b.column("copies").to_numpy(zero_copy_only=False)
            spans = b.column("cover")
            out = []
            for i in range(b.num_rows):
                lo, hi = int(off[i]), int(off[i + 1])
                n = hi - lo
                left = right = np.zeros(0, np.int64)
                if m[i] > 1 and n >= length:
                    left, right = np.array([0]), np.array([n])
                elif spans[i].is_valid:
                    v = spans[i].values
                    left, right = _union(*(v.field(x).to_numpy(zero_copy_only=False) for x in (0, 1)))
                sha, kept, at = hashlib.sha256(), [], 0
                raw = memoryview(data)[lo:hi]
                for x, y in zip([*left.tolist(), n], [*right.tolist(), n], strict=True):
                    sha.update(raw[at:x])
                    if with_text:
                        kept.append(bytes(raw[at:x]))
                    at = y
                row = [n, int((right - left).sum()), len(left), sha.hexdigest(),
                       [{"start": int(x), "end": int(y)} for x, y in zip(left, right, strict=True)]]
                out.append(row + [b"".join(kept).decode("utf-8", "ignore")] * with_text)
            cols = list(zip(*out, strict=True)) if out else [[]] * (5 + with_text)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(KEYS[0]), b.column(KEYS[1]), *(pa.array(list(c), k) for c, k in zip(cols, kinds, strict=False))],
                names=[*KEYS, "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"][:7 + with_text])
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per different text of ``docs`` (T1, T2): n_bytes, n_removed, n_spans, kept_sha256, spans (start, end), and kept_text if asked for."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    spark = docs.sparkSession
    kit.small_batches(spark)
    name = f"{kit.T1} long, {kit.T2} long"
    texts = kit.keep_on_disk(spark, kit.distinct_texts(docs))

    # most anchors occur once: what may occur twice is told by compact counts of their names, and only that is shuffled as rows
    repeated = support.reaching(spark, texts.mapInArrow(_anchor_counts(length), support.SCHEMA), 2)
    anchors = kit.write(spark, texts.mapInArrow(_anchors(length, repeated), f"k1 long, k2 long, {name}, a long, lo long, hi long, m long"), "anchors")
    # written before the join: both sides of it are then shuffled for it alone, and Spark can split a hot key
    twice = kit.write(spark, anchors.groupBy("k1", "k2").agg(F.sum("m").alias("n")).where("n > 1").select("k1", "k2"), "twice")
    todo = kit.write(spark, anchors.join(twice, ["k1", "k2"])
                     .groupBy(*KEYS).agg(F.collect_list(F.struct("a", "lo", "hi", "m")).alias("starts")), "todo")
    kit.discard(anchors, twice)
    covers = []
    for step in STEPS:
        cells = kit.write(spark, texts.join(todo.hint("shuffle_hash"), KEYS).mapInArrow(
            _cells(length, step), f"k1 long, k2 long, u1 long, u2 long, {name}, a long, lo long, hi long, m long"), "cells")
        kit.discard(todo)
        if step > 1:
            kinds = kit.write(spark, cells.groupBy("k1", "k2", "u1", "u2").agg(
                F.sum("m").alias("n"), F.min(F.struct(*KEYS, "a", "lo", "hi")).alias("one")), "kinds")
            twice = kit.write(spark, kinds.groupBy("k1", "k2").agg(F.sum("n").alias("all")).where("all > 1").select("k1", "k2"), "twice")
            live = kinds.join(twice, ["k1", "k2"]).select("k1", "k2", "u1", "u2", (F.col("n") > 1).alias("whole"))
        else:
            live = (cells.groupBy("k1", "k2", "u1", "u2").agg(F.sum("m").alias("n")).where("n > 1")
                    .select("k1", "k2", "u1", "u2", F.lit(True).alias("whole")))
        cell = F.struct("whole", "a", "lo", "hi", *((["k1", "k2"]) if step > 1 else []))
        found = kit.write(spark, cells.join(live, ["k1", "k2", "u1", "u2"]).groupBy(*KEYS).agg(F.collect_list(cell).alias("found")), "found")
        kit.discard(cells)
        covers.append(found.select(*KEYS, F.expr(f"transform(filter(found, f -> f.whole), f -> struct(f.a - f.hi as start, f.a - f.lo + {length}L as end))").alias("cover")))
        if step > 1:
            left = kit.write(spark, found.mapInArrow(_open_cells(length), "k1 long, k2 long").distinct(), "left")
            todo = kit.write(spark, kinds.join(left, ["k1", "k2"]).select("one.*", F.least("n", F.lit(2)).alias("m"))
                             .groupBy(*KEYS).agg(F.collect_list(F.struct("a", "lo", "hi", "m")).alias("starts")), "todo")
            kit.discard(kinds, twice, left)
    cover = reduce(DataFrame.union, covers).groupBy(*KEYS).agg(F.flatten(F.collect_list("cover")).alias("cover"))
    out = f"{name}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    done = kit.write(spark, texts.join(cover.hint("shuffle_hash"), KEYS, "left").mapInArrow(
        _cut(length, with_text), out + ", kept_text string" * with_text), "spans")
    texts.unpersist()
    return done


def suffix_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done = repeated_spans(docs, length).drop("spans")
    return (docs.select("doc_id", *kit.text_ids()).join(done, KEYS, "left")
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with its repeated strings cut out of ``text``; n_chars follows where the table has it. No row goes."""
    done = repeated_spans(docs, length, with_text=True).select(*KEYS, "n_removed", "kept_text")
    cut = F.col("__row.text").isNotNull() & (F.col("n_removed") > 0)
    text = F.when(cut, F.col("kept_text")).otherwise(F.col("__row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("__row.n_chars"))
    return (docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), *kit.text_ids())
            .join(done, KEYS, "left")
            .select(*(new[c].alias(c) if c in new else F.col(f"__row.`{c}`").alias(c) for c in docs.columns)))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(kit.table(spark, sf_dir, "documents"))
