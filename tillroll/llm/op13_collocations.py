"""Phrase collocation mining by top-order marginalisation: only the longest windows are counted, shorter phrases are their ROLLUP sums.

Every word occurrence leads one window: itself and the next ``longest`` - 1 words of its piece, in lead columns w1 .. w4, padded with empty
words behind the piece's end. A phrase of k words occurs wherever it fills the first k columns of a window, so its count is the sum over
windows with that prefix: one ROLLUP (lang, w1, .. w4) gives the counts of all lengths, and its (lang) level all word occurrences.

Most long windows of a corpus occur once. They would be all of the shuffle, so windows are cut (padded) before a word with which they cannot
reach ``least`` occurrences any more. What can is told by upper bounds, length by length: phrases of k words whose parts may reach ``least``
are counted by a 40-bit hash of their words. Those that reach ``least`` are a Bloom filter (``support``). A collision or a full
filter can only leave a window longer than needed. A phrase that does reach ``least`` is never cut, so its count, and all counts
used of its parts, are exact counts of the words themselves.

Defined results: a null lang is ``und``, a null text is empty; repeated rows and ids each count; a language without candidates has no rows; a document
of any length is read in steps of 1 MB cut behind a piece; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm import kit, scan, support

LEAST, LONGEST, TOP, INSIDE = 30, 4, 2000, 80
U = np.uint64
#: bits of a phrase's hash
HASH_BITS = 40
#: parts of a language's candidates that are ranked on their own first
SHARES = 64
#: fixed values: bytes that end a piece, bytes that end a word
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_ENDS = b" \t"

_ENDS = np.zeros(256, bool)
_ENDS[list(PIECE_ENDS)] = True
_GAP = _ENDS.copy()
_GAP[list(WORD_ENDS)] = True


def _steps(data: np.ndarray, off: np.ndarray):
    """(first row, byte range, offsets) of bounded steps; a longer text is cut behind a piece."""
    for i, j in scan.slabs(off):
        lo, hi = int(off[i]), int(off[j])
        if hi - lo <= 2 * scan.SLAB or j - i > 1:
            yield i, data[lo:hi], off[i:j + 1] - lo
            continue
        while lo < hi:
            end = min(lo + scan.SLAB, hi)
            while end < hi and not _ENDS[data[end - 1]]:
                ahead = np.flatnonzero(_ENDS[data[end:end + scan.SLAB]])
                end = end + int(ahead[0]) + 1 if len(ahead) else min(end + scan.SLAB, hi)
            yield i, data[lo:end], np.array([0, end - lo])
            lo = end


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row (of off) and piece number of each word."""
    gap = _GAP[buf]
    border = np.zeros(len(buf) + 1, bool)
    border[off] = True
    ink = ~gap
    first, last = ink.copy(), ink.copy()
    first[1:] &= gap[:-1] | border[1:-1]
    last[:-1] &= gap[1:] | border[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.cumsum(_ENDS[buf])
    row = np.searchsorted(off, start, side="right") - 1
    return start, end, row, (ends[start] if len(buf) else start) + row


def _phrases(names: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position (of the first len - k + 1 positions)."""
    n = max(len(names) - k + 1, 0)
    h = names[:n].copy()
    for i in range(1, k):
        h = scan.mix(h * U(0xD6E8FEB86659FD93)) + names[i:i + n]
    return scan.mix(scan.mix(h + U(k))) >> U(64 - HASH_BITS)


def _reach(names: np.ndarray, piece: np.ndarray, blooms: dict[int, np.ndarray], longest: int) -> np.ndarray:
    """Words of each position's window: 0 if its word cannot reach the least count, else up to where a phrase of the window cannot."""
    n = len(names)
    words = np.zeros(n, np.int8)
    go = support.has(blooms.get(1), _phrases(names, 1))
    alive = go.copy()
    held: dict[int, np.ndarray] = {1: go}
    for k in range(2, longest + 1):  # phrases of k words that fit in a piece and may reach the count
        fit = np.zeros(n, bool)
        if n >= k:
            same = piece[k - 1:] == piece[:n - k + 1]
            fit[:n - k + 1] = same & held[k - 1][:n - k + 1] & held[k - 1][1:n - k + 2]
            if k in blooms:
                at = np.flatnonzero(fit)
                fit[at] = support.has(blooms[k], _phrases(names, k)[at])
        held[k] = fit
    for k in range(1, longest + 1):
        alive &= held[k]
        words[alive] = k
    return words


def _langs(col: pa.Array) -> tuple[list[str], np.ndarray]:
    d = pc.fill_null(col, "und").dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.dictionary.to_pylist(), d.indices.to_numpy(zero_copy_only=False)


def _named(batches):
    """(languages, language of each word, word names, pieces, start, end, bytes) of each step."""
    for b in batches:
        data, off = scan.text_buffer(b.column("text"))
        langs, code = _langs(b.column("lang"))
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U)
        for i, buf, edge in _steps(data, off):
            start, end, row, piece = _words(buf, edge)
            if len(start):
                lang = code[i + row]
                yield langs, lang, scan.span(scan.running(buf, scan.BYTE_LOWER), start, end) + (end - start).astype(U) + salt[lang], piece, start, end, buf


def _support(k: int, blooms: dict[int, np.ndarray]):
    """Hash counts of the phrases of k words whose parts all may reach the least count; words and pairs (k = 2) go together."""
    def found(batches):
        for _, _, names, piece, *_ in _named(batches):
            reach = _reach(names, piece, blooms, k)
            parts = [_phrases(names, k)[np.flatnonzero(reach[:len(names) - k + 1] >= k)]] if len(names) >= k else []
            if k == 2:
                parts.append(_phrases(names, 1))
            yield np.unique(np.concatenate(parts) if parts else np.zeros(0, U), return_counts=True)
    return lambda batches: support.blocks(found(batches), HASH_BITS)


def _windows(blooms: dict[int, np.ndarray], longest: int):
    """(lang, w1 .. , n): the windows of each step, equal ones as one row. Positions that lead no phrase are one all-padded window."""
    def run(batches):
        for langs, lang, names, piece, start, end, buf in _named(batches):
            reach = _reach(names, piece, blooms, longest)
            at = np.flatnonzero(reach)
            used = np.zeros(len(start) + longest, bool)
            for k in range(longest):
                used[at[reach[at] > k] + k] = True
            pick = np.flatnonzero(used[:len(start)])  # words that stand in some window, as codes of this step
            ink = np.zeros(len(buf) + 1, np.int8)
            np.add.at(ink, start[pick], 1)
            np.add.at(ink, end[pick], -1)
            inside = np.cumsum(ink[:-1], dtype=np.int8).astype(bool)
            low = scan.LOWER[buf[inside]].astype(np.uint8)
            edges = np.concatenate(([0], np.cumsum(end[pick] - start[pick])))
            d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pick), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(low)]).dictionary_encode()
            code = np.zeros(len(start) + longest, np.int64)
            code[pick] = d.indices.to_numpy() + 1
            cols = [lang[at], *(np.where(reach[at] > k, code[at + k], 0) for k in range(longest))]
            rest = np.bincount(lang[reach == 0], minlength=len(langs))
            cols = [np.concatenate((c, x)) for c, x in zip(cols, [np.arange(len(langs)), *[np.zeros(len(langs), np.int64)] * longest], strict=True)]
            n = np.concatenate((np.ones(len(at), np.int64), rest))
            order = np.lexsort(cols[::-1])
            cols, n = [c[order] for c in cols], n[order]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in cols], axis=0)))
            n = np.add.reduceat(n, np.flatnonzero(new))
            cols = [c[new] for c in cols]
            words = pa.concat_arrays([pa.array([b""], pa.large_binary()), d.dictionary]).cast(pa.binary())
            text = [words.take(pa.array(c)).cast(pa.string()) for c in cols[1:]]
            out = [pa.array(langs).take(pa.array(cols[0])), *text, pa.array(n)]
            yield pa.RecordBatch.from_arrays(out, names=["lang", *(f"w{k}" for k in range(1, longest + 1)), "n"]).filter(pa.array(n > 0))
    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words array<string>, f): every phrase of 1 .. ``longest`` words with f >= ``least``, and per lang an empty phrase whose
    f counts all words."""
    spark = docs.sparkSession
    kit.small_batches(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), kit.text_of().alias("text"))
    blooms: dict[int, np.ndarray] = {}
    for k in range(2, longest + 1):
        blooms[k] = support.reaching(spark, rows.mapInArrow(_support(k, blooms), support.SCHEMA), least)
        if k == 2:
            blooms[1] = blooms[2]
    ws = [f"w{k}" for k in range(1, longest + 1)]
    windows = rows.mapInArrow(_windows(blooms, longest), "lang string, " + ", ".join(f"{w} string" for w in ws) + ", n long")
    level = F.col("level")
    # equal windows become one row first, so that the ROLLUP multiplies different windows only
    whole = windows.groupBy("lang", *ws).agg(F.sum("n").alias("n"))
    sums = whole.rollup("lang", *ws).agg(F.sum("n").alias("f"), F.grouping_id().alias("id"))
    sums = sums.withColumn("level", F.lit(longest) - F.bit_count("id"))  # words of the prefix; -1 is the grand total
    words = F.slice(F.array(*ws), F.lit(1), F.greatest(level, F.lit(0)))
    wanted = F.when(level < 0, F.lit(False)).when(level == 0, F.lit(True)).otherwise((F.element_at(F.array(*ws), F.greatest(level, F.lit(1))) != "") & (F.col("f") >= least))
    return sums.where(wanted).select("lang", words.alias("words"), "f")


def _ratio(a: Column, parts: Column) -> Column:
    """floor(2000000 a / parts) in whole numbers of any size (both positive)."""
    wide = a.cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    return F.call_function("div", wide, parts.cast("decimal(38,0)"))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """The ``top`` phrases of 2 .. ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    counts = kit.write(spark, phrase_counts(docs, least, longest), "phrases")
    found = counts.where(F.size("words") >= 2)
    parts = counts.where(F.size("words") >= 1)
    cuts = found.select("lang", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"head": F.slice("words", F.lit(1), F.col("k")), "tail": F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))})
    cuts = (cuts.join(parts.select("lang", F.col("words").alias("head"), F.col("f").alias("l")), ["lang", "head"])
            .join(parts.select("lang", F.col("words").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]))
    cuts = cuts.withColumn("score", _ratio(F.col("a"), F.col("l").cast("decimal(20,0)") + F.col("r").cast("decimal(20,0)")))
    best = cuts.groupBy("lang", "words").agg(F.min_by(F.struct("a", "l", "r", "score"), F.struct("score", "k")).alias("x")).select("lang", "words", "x.*")
    longer = found.where(F.size("words") > 2).select("lang", "f", F.explode(F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> slice(words, i, k))))")).alias("words"))
    around = longer.groupBy("lang", "words").agg(F.max("f").alias("around"))
    free = F.col("around").isNull() | (F.lit(100) * F.col("around").cast("decimal(20,0)") < F.lit(inside) * F.col("a").cast("decimal(20,0)"))
    total = counts.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    order = F.desc("score"), F.desc("a"), "phrase"
    kept = best.join(around, ["lang", "words"], "left").where(free).select("lang", F.array_join("words", " ").alias("phrase"), "a", "l", "r", "score")
    share = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).orderBy(*order))
    first = kept.withColumn("at", share).where(F.col("at") <= top)  # at most SHARES * top rows of a language meet in a task
    listed = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return listed.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(kit.table(spark, sf_dir, "documents"))
