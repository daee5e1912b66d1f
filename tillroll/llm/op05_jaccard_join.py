"""N-gram Jaccard join: documents whose sets of five-word shingles are at least 80 % alike, as linked classes.

Sets are compared in size-banded tiles: a tile holds the documents of two neighbouring size bands that share one
shingle of their prefix. In a tile, hashed parity bitmaps bound the overlap from above by counting bits
(|A n B| <= (|A| + |B| - bits that differ) / 2); pairs that pass are compared exactly by intersecting sorted arrays.

No link is lost and no group is expanded into its pairs:

* prefix: sets with J >= t share k shingles among the first n - ceil(t n) + k of each in any common order. With
  k = 1 + n // ``SPARE``, a set that shares fewer than max(1, n // SPARE) of them with any others (one less than k, as sizes of a pair may lie
  on both sides of a multiple) links with nothing and goes; twice, as others then lose their shared shingles. The order puts
  shingles last that are common in some part of the input (a bitmap of 2**20 bits, whatever the size of the
  corpus), so passages that many documents hold don't make tiles; it changes the work, never the result;
* keys with the same members make one tile; a tile's smallest and largest member are compared with all others first
  (two pairs a member), which links almost all copies; classes are then known, and only pairs between different classes of a tile are
  looked at, a few best ones a member first, then all that are left, until no class can grow;
* tiles over ``BLOCK`` members are dealt out as pairs of blocks over many tasks; blocks of the tile's largest class meet those of other classes only.

Texts are named by a 64-bit hash, those whose hash another text shares by two; equal texts are one set. Defined results: null or wordless text: no shingles, linked with
nothing; fewer than five words: the whole sequence is one shingle; repeated rows and null ids: each row stays,
component_id is the smallest id of its class (null if the class has none); an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan

WORDS = 5
PERCENT = 80
#: buckets of the bitmap of common shingles, and the part of a hash that names one
COMMON_BITS = 20
#: a set of n shingles looks at n // SPARE more of them than it must, to be sure of sharing more than one
SPARE = 20
#: members of a tile that one task compares with each other
BLOCK = 2048
#: best candidates of a member in a round; the last round has no limit
ROUNDS = (4, 64, 0)


def _common(words: int):
    """Buckets that hold clearly more shingles of a partition than chance puts there."""
    def run(batches):
        count, total = np.zeros(1 << COMMON_BITS, np.int64), 0
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            for i, j in scan.slabs(off):
                g = scan.grams(scan.row_words(data, off, i, j)[0], words)
                count += np.bincount((g >> np.uint64(64 - COMMON_BITS)).astype(np.int64), minlength=1 << COMMON_BITS)
                total += len(g)
        mean = total / len(count)
        hot = np.flatnonzero(count > mean + 8 * np.sqrt(mean) + 8)
        yield pa.RecordBatch.from_arrays([pa.array(hot)], names=["bucket"])
    return run


def _prefix(x: np.ndarray, common: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a sorted set in the common order, and which of it is common."""
    n = len(x)
    p = min(n, n - -(-percent * n // 100) + 1 + n // SPARE)
    hot = common[(x >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]
    cold = x[~hot]
    if len(cold) >= p:
        return cold[:p], np.zeros(p, bool)
    return np.concatenate((cold, x[hot][:p - len(cold)])), np.arange(p) >= len(cold)


def _keys(packed: bytes, words: int, percent: int):
    """(key, salt, t): a row for each prefix shingle; common ones are salted; salt -1 - n tells a set's size."""
    def run(batches):
        common = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        seen: set[int] = set()
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            t = b.column(kit.T1).to_numpy(zero_copy_only=False)
            keys, salts, ids = [], [], []
            for i, j in scan.slabs(off):
                for r, x in enumerate(scan.shingle_sets(data, off, i, j, words), i):
                    if not len(x) or int(t[r]) in seen:
                        continue
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(int(t[r]))
                    k, hot = _prefix(x, common, percent)
                    keys += [t[r:r + 1], scan.signed(k)]
                    salts += [np.array([-1 - len(x)]), np.where(hot, 1 + (t[r] & 15), 0)]
                    ids.append(np.full(len(k) + 1, t[r]))
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), pa.array(np.concatenate(salts).astype(np.int32)), pa.array(np.concatenate(ids))],
                    names=["key", "salt", "t"])
    return run


def _shared(batches):
    """Of rows sorted by (key, salt, t): those whose key another text has too; salted rows all stay. Repeats go."""
    held = None  # last row so far, and whether its key was seen before
    for b in batches:
        k, s, t = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if held is not None:
            k, s, t = (np.concatenate(([h], x)) for h, x in zip(held, (k, s, t), strict=False))
        if not len(k):
            continue
        group = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
        new = np.concatenate(([True], ~group | (t[1:] != t[:-1])))
        before = held[3] if held is not None else False
        k, s, t = k[new], s[new], t[new]
        like = (k[1:] == k[:-1]) & (s[1:] == s[:-1])
        many = np.concatenate(([before], like)) | np.concatenate((like, [False])) | (s != 0)
        out = np.flatnonzero(many[:-1])
        held = (k[-1], s[-1].astype(np.int32), t[-1], bool(like[-1]) if len(like) else before)
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(s[out].astype(np.int32)), pa.array(t[out])], names=["key", "salt", "t"])
    if held is not None and (held[3] or held[1] != 0):
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int32()), pa.array([held[2]], pa.int64())],
                                         names=["key", "salt", "t"])


def _width(n: int) -> int:
    """Bits of the bitmap of a set of n shingles: the power of two from 2 n, 64 at least."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(x: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each bit; folding halves by xor gives the bitmap of half the width."""
    w = _width(len(x))
    odd = np.bincount((x & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _fold(rows: np.ndarray, width: int) -> np.ndarray:
    while rows.shape[1] * 64 > width:
        h = rows.shape[1] // 2
        rows = rows[:, :h] ^ rows[:, h:]
    return rows


def _sets(words: int):
    """Bitmap and sorted array of each text's set."""
    def run(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            sets = [x for i, j in scan.slabs(off) for x in scan.shingle_sets(data, off, i, j, words)]
            yield pa.RecordBatch.from_arrays([b.column(kit.T1), pa.array([bitmap(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())],
                                             names=["t", "bits", "shingles"])
    return run


def _alike(inter, both, percent: int):
    """100 * intersection >= percent * union, where ``both`` is the sum of the two sizes."""
    return 100 * inter >= percent * (both - inter)


def _may_link(percent: int):
    """Pairs that the bit counts allow."""
    def run(batches):
        for b in batches:
            n = b.column("nx").to_numpy(zero_copy_only=False) + b.column("ny").to_numpy(zero_copy_only=False)
            ok = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(b.column("bx").to_pylist(), b.column("by").to_pylist(), strict=True)):
                p, q = np.frombuffer(p, np.uint64)[None], np.frombuffer(q, np.uint64)[None]
                w = 64 * min(p.shape[1], q.shape[1])
                far = int(np.bitwise_count(_fold(p, w) ^ _fold(q, w)).sum())
                ok[i] = _alike((n[i] - far) // 2, n[i], percent)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(ok))
    return run


def _links(percent: int):
    """Pairs that are links, by exact intersection of the sorted arrays."""
    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            for i, (p, q) in enumerate(zip(b.column("sx").to_pylist(), b.column("sy").to_pylist(), strict=True)):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                ok[i] = _alike(int(np.count_nonzero(q[at] == p)), len(p) + len(q), percent)
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["u", "v"]).filter(pa.array(ok))
    return run


def _tile_pairs(rows: list[np.ndarray], bits: list[bytes], percent: int, limit: int):
    """Candidate pairs of one tile: other class, larger one in the tile's band, bit counts allow it."""
    t, root, n, blk, band, key = rows
    order = np.lexsort((t, n))
    t, root, n, blk, band = (x[order] for x in (t, root, n, blk, band))
    bits = [bits[i] for i in order]
    cross = blk.min() != blk.max()
    width = np.array([8 * len(x) for x in bits])
    grids: dict[int, tuple[int, np.ndarray]] = {}
    last = np.searchsorted(n, 100 * n // percent, side="right")
    for p in range(len(t)):
        q = np.arange(p + 1, last[p])
        q = q[(root[q] != root[p]) & (band[q] == key) & ((blk[q] != blk[p]) if cross else True)]
        if not len(q):
            continue
        w = int(width[p])
        if w not in grids:
            first = int(np.searchsorted(width, w))
            grids[w] = first, np.concatenate([_fold(np.frombuffer(b"".join(bits[i:j]), np.uint64).reshape(j - i, -1), w)
                                              for i, j in _equal(width, first)])
        first, grid = grids[w]
        far = np.bitwise_count(grid[q - first] ^ grid[p - first]).sum(axis=1, dtype=np.int64)
        top = (n[p] + n[q] - far) // 2
        ok = _alike(top, n[p] + n[q], percent)
        q, top = q[ok], top[ok]
        more = bool(limit) and len(q) > limit
        if more:
            q = q[np.lexsort((t[q], n[q] - 2 * top))[:limit]]
        yield np.full(len(q), t[p]), t[q], np.full(len(q), more)


def _equal(x: np.ndarray, first: int):
    """Ranges of equal values of the sorted x[first:]."""
    cut = [first, *(np.flatnonzero(np.diff(x[first:])) + 1 + first), len(x)]
    return zip(cut[:-1], cut[1:], strict=True)


def _tiles(percent: int, limit: int):
    """Candidates of all tiles of a partition that is sorted by tile."""
    names = ["t", "root", "n", "blk", "own", "g"]

    def flush(parts):
        rows = [np.concatenate([p[0][c] for p in parts]) for c in range(len(names))]
        rows[-1] = int(rows[-1][0])
        return list(_tile_pairs(rows, [x for p in parts for x in p[1]], percent, limit))

    def run(batches):
        held, at = [], None
        for b in batches:
            if not b.num_rows:
                continue
            tile = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "g", "i", "j")])
            cols, bits = [b.column(c).to_numpy(zero_copy_only=False) for c in names], b.column("bits").to_pylist()
            cut = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1), b.num_rows]
            found = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                now = tuple(tile[:, lo])
                if held and now != at:
                    found += flush(held)
                    held = []
                at = now
                held.append(([c[lo:hi] for c in cols], bits[lo:hi]))
            if found:
                yield _pairs(found)
        if held and (found := flush(held)):
            yield _pairs(found)
    return run


def _pairs(found):
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["x", "y", "more"])


def jaccard_classes(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, Column]:
    """(t, n, root): each different text with shingles, its set size, and the smallest text name of its class; and the name of a text as a column."""
    spark = docs.sparkSession
    kit.small_batches(spark)
    scratch: list[DataFrame] = []

    def put(df: DataFrame, name: str) -> DataFrame:
        scratch.append(kit.write(spark, df, name))
        return scratch[-1]

    named = kit.text_name(docs)
    rows = docs.select(named, kit.text_of().alias("text"))
    common = kit.bit_rows(rows.select("text").mapInArrow(_common(words), "bucket long"), "bucket", COMMON_BITS)
    shared = put(rows.mapInArrow(_keys(common.tobytes(), words, percent), "key long, salt int, t long")
                       .repartition("key", "salt").sortWithinPartitions("key", "salt", "t")
                       .mapInArrow(_shared, "key long, salt int, t long"), "keys")
    sizes = put(shared.where("salt < 0").select("t", (-1 - F.col("salt")).cast("long").alias("n")).distinct(), "sizes")
    keys = shared.where("salt >= 0").select("key", "t")
    need = F.greatest(F.lit(1), F.floor(F.col("n") / SPARE))
    for turn in range(2):
        if turn:
            twice = put(keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "twice")
            keys = keys.join(twice, "key")
        enough = put(keys.groupBy("t").agg(F.count(F.lit(1)).alias("k")).join(sizes, "t").where(F.col("k") >= need).select("t"), "enough")
        keys = put(keys.join(enough, "t"), "keys")
    sets = (keys.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("t")).alias("x"),
                                    F.bit_xor(F.xxhash64(F.lit(1), "t")).alias("y")).where("c > 1")
            .groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key"))
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(126 / percent)).cast("int")  # neighbours hold all that may link
    tiles = put(keys.join(sets, "key").join(sizes, "t").withColumn("own", band)
                      .select("key", "t", "n", "own", F.explode(F.array("own", F.col("own") + 1)).alias("g")), "tiles")
    # bitmaps and sorted arrays of the texts that stand in some tile: made once, then only these are moved
    member = kit.small(put(tiles.select(F.col("t").alias(kit.T1)).distinct(), "members"))
    texts = rows.join(member, kit.T1, "left_semi").groupBy(kit.T1).agg(F.first("text").alias("text"))
    made = put(texts.mapInArrow(_sets(words), "t long, bits binary, shingles binary"), "sets")
    bits = made.select("t", "bits").join(sizes, "t")

    def links(pairs: DataFrame) -> DataFrame:
        ends = kit.small(put(pairs.select(F.col("x").alias("t")).union(pairs.select("y")).distinct(), "ends"))
        arrays = made.select("t", "shingles").join(ends, "t", "left_semi")
        both = pairs.join(arrays.toDF("x", "sx"), "x").join(arrays.toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
        return put(both.mapInArrow(_links(percent), "u long, v long"), "links")

    ends = tiles.groupBy("key", "g").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi")
    star = (tiles.join(ends, ["key", "g"]).select(F.col("t").alias("x"), F.explode(F.array("lo", "hi")).alias("y")).where("x <> y").distinct())
    left, right = bits.toDF("x", "bx", "nx"), bits.toDF("y", "by", "ny")
    star = star.join(left, "x").join(right, "y").where(f"100 * nx >= {percent} * ny and 100 * ny >= {percent} * nx")
    known = kit.components(spark, links(put(star.select("x", "y", "nx", "ny", "bx", "by").mapInArrow(_may_link(percent), "x long, y long"), "pairs")))
    left_over = tiles  # tiles with a member whose candidates were cut; in all others every candidate is compared
    for limit in ROUNDS:
        now = left_over.join(known.withColumnRenamed("node", "t"), "t", "left").withColumn("root", F.coalesce("root", "t"))
        sizes_of = now.groupBy("key", "g", "root").agg(F.count(F.lit(1)).alias("c"), F.max("own").alias("top"))
        mixed = (sizes_of.groupBy("key", "g").agg(F.count(F.lit(1)).alias("classes"), F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("main"), F.max("top").alias("top"))
                 .where("classes > 1 and top = g")
                 .select("key", "g", F.when(F.col("all") > BLOCK, F.col("main.root")).alias("main"),
                         F.when(F.col("all") > BLOCK, F.ceil(F.col("main.c") / BLOCK)).otherwise(0).cast("long").alias("d"),
                         F.ceil((F.col("all") - F.when(F.col("all") > BLOCK, F.col("main.c")).otherwise(0)) / BLOCK).cast("long").alias("o")))
        # a large tile: the d blocks of its largest class meet the o blocks of all others, but never each other
        main = F.coalesce(F.col("root") == F.col("main"), F.lit(False))
        parts = (now.join(mixed, ["key", "g"]).join(bits.select("t", "bits"), "t")
                 .withColumn("blk", F.when(main, F.pmod(F.xxhash64("t"), "d")).otherwise(F.col("d") + F.pmod(F.xxhash64("t"), "o")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.when(main, F.col("d")).otherwise(0).cast("int"), (F.col("d") + F.col("o") - 1).cast("int"))))
                 .select("key", "g", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "t", "root", "n", "blk", "own", "bits"))
        cand = put(parts.repartition("key", "g", "i", "j").sortWithinPartitions("key", "g", "i", "j")
                         .mapInArrow(_tiles(percent, limit), "x long, y long, more boolean")
                         .groupBy("x", "y").agg(F.max("more").alias("more")), "pairs")
        state = cand.agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).first()
        if state.n:
            known = kit.grow(spark, known, links(cand))
        if not state.more:
            break
        cut = cand.where("more").select(F.col("x").alias("t")).distinct()
        left_over = put(tiles.join(put(tiles.join(cut, "t").select("key", "g").distinct(), "again"), ["key", "g"]), "tiles")
    out = kit.write(spark, sizes.join(known.withColumnRenamed("node", "t"), "t", "left").select("t", "n", F.coalesce("root", "t").alias("root")), "classes")
    kit.discard(*scratch, known)
    return out, named


def jaccard_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    classes, named = jaccard_classes(docs, words, percent)
    rows = kit.write(spark, docs.select("doc_id", named), "rows")
    texts = rows.groupBy(kit.T1).agg(F.min("doc_id").alias("low")).join(classes.withColumnRenamed("t", kit.T1), kit.T1).select(kit.T1, "n", "root", "low")
    texts = kit.write(spark, texts, "texts")
    low = texts.groupBy("root").agg(F.min("low").alias("least"))
    found = texts.join(low, "root").select(kit.T1, "n", F.lit(True).alias("found"), "least")
    return (kit.join_spread(rows, found, kit.T1, "left")
            .select("doc_id", F.coalesce("n", F.lit(0)).alias("n_shingles"), F.when(F.col("found"), F.col("least")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class (smallest doc_id, nulls last); rows without shingles all stay."""
    classes, named = jaccard_classes(docs, words, percent)
    rows = (docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), named)
            .join(classes.select(F.col("t").alias(kit.T1), "root"), kit.T1, "left").select("__row", F.col("root").alias("__root")))
    first = F.struct(F.col("__row.doc_id").isNull(), F.col("__row.doc_id"), F.xxhash64("__row"))
    best = rows.where("__root is not null").groupBy("__root").agg(F.min_by("__row", first).alias("__row"))
    return rows.where("__root is null").select("__row").union(best.select("__row")).select("__row.*")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(kit.table(spark, sf_dir, "documents"))
