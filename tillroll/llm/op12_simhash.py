"""SimHash near-duplicates by pivot distance tables: fingerprints within 4 differing bits, as linked classes.

A document's fingerprint has a bit set where over half of the XXH64 values of its 4-word shingles have it. For each different fingerprint the
distances to 16 reference fingerprints (pivots) are computed once and travel with it as a table row of 16 bytes. As |d(x, p) - d(y, p)| is at most
the distance of x and y, a pair whose rows differ by more than 4 in any column is discarded; only survivors are compared themselves. The
pivots are Walsh codes, 32 bits from each other: for them the squared differences over all 64 sum to 64 times the distance of a pair,
so unlike fingerprints stand out in some column.

Which pairs meet: of five blocks of the 64 bits, one at least is equal in fingerprints that differ in four bits. A tile holds the
fingerprints that share such a block. Tiles over ``TILE`` members are dealt out again by five blocks of the bits that they don't share yet, until they are
smaller; a tile that shares all but four bits has 16 members at most, so this ends. Nothing is dropped on the way, and a tile's pairs stay in its task: what
leaves it is one link from each member to the smallest one that it reaches there.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer than four words are one shingle; equal
fingerprints are one node; repeated rows and null ids each stay, component_id being the smallest id of the class (null if it has
none); a text of any length is hashed in steps of 1 MB; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan

WORDS, SEED, BITS, NEAR = 4, 42, 64, 4
PIVOTS = 16
#: members of a tile that one task compares with each other, and rows compared at once
TILE, ROWS = 4096, 256
#: keys of oversized tiles that may be broadcast (24 bytes each); more are joined by a shuffle
BROADCAST_ROWS = 500_000
U = np.uint64


def shingle_hashes(raw: bytes, words: int = WORDS) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the text's shingles, in steps of bounded memory."""
    tail: list[bytes] = []
    some, at = False, 0
    while at < len(raw):
        end = min(at + scan.SLAB, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        tail += raw[at:end].lower().split()
        at = end
        if len(tail) >= words:
            size = np.fromiter(map(len, tail), np.int64, len(tail)) + 1
            stop = np.cumsum(size)
            text, h = b" ".join(tail), xxhash.xxh64_intdigest
            lo, hi = (stop - size)[:len(tail) - words + 1].tolist(), (stop - 1)[words - 1:].tolist()
            yield np.fromiter((h(text[a:b], SEED) for a, b in zip(lo, hi, strict=True)), U, len(lo))
            some, tail = True, tail[-(words - 1):] if words > 1 else []
    if tail and not some:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], U)


def fingerprint(raw: bytes, words: int = WORDS) -> int:
    votes, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(raw, words):
        for i in range(0, len(h), 1 << 16):
            part = np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes += part.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(U)[0])


def _fingerprints(words: int):
    def run(batches):
        for b in batches:
            data, off = scan.text_buffer(b.column(b.num_columns - 1))
            raw = memoryview(data)
            fp = np.array([fingerprint(bytes(raw[i:j]), words) for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], U)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scan.signed(fp))], names=[*b.schema.names[:-1], "fp"])
    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), words: int = WORDS) -> DataFrame:
    """(*keep, fp): the 64-bit fingerprint of each row's text."""
    kit.small_batches(docs.sparkSession)
    rows = docs.select(*keep, kit.text_of().alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_fingerprints(words), f"{kept}, fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Walsh codes: bit i of code j is the parity of the bits that i and j share."""
    codes = [sum(((i & j).bit_count() & 1) << i for i in range(BITS)) for j in range(1, n + 1)]
    return [c - (1 << 64) if c >> 63 else c for c in codes]


def _distances(fp: Column) -> list[Column]:
    """The distance table's row of a fingerprint: eight distances, a byte each, in every long."""
    codes = pivots()
    return [reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(c))).cast("long"), 8 * k) for k, c in enumerate(codes[i:i + 8])))
            .alias(f"d{i // 8}") for i in range(0, PIVOTS, 8)]


def blocks(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` nearly equal blocks of its free bits added."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    cut = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _deal(near: int):
    """Each row of an oversized tile, once for each of its smaller tiles; what shares all but ``near`` bits stays."""
    def run(batches):
        for b in batches:
            mask, fp = b.column("mask").to_numpy(zero_copy_only=False).view(U), b.column("fp").to_numpy(zero_copy_only=False).view(U)
            rows, masks = [], []
            for m in np.unique(mask):
                at = np.flatnonzero(mask == m)
                for x in blocks(int(m), near + 1):
                    rows.append(at)
                    masks.append(np.full(len(at), x, U))
            r, m = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((rows, np.int64), (masks, U)))
            yield pa.RecordBatch.from_arrays([pa.array(scan.signed(m)), pa.array(scan.signed(fp[r] & m)), *(b.column(c).take(pa.array(r)) for c in ("fp", "d0", "d1"))],
                                             names=["mask", "value", "fp", "d0", "d1"])
    return run


def tile_links(fp: np.ndarray, table: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member that it reaches) for the members of a tile that reach a smaller one."""
    label = np.arange(len(fp))
    order = np.lexsort((fp, table[:, 0]))
    fp, table = fp[order], table[order]
    last = np.searchsorted(table[:, 0], table[:, 0].astype(np.int64) + near, side="right")
    for i in range(0, len(fp), ROWS):
        j = min(i + ROWS, len(fp))
        hi = int(last[j - 1])
        far = np.ones((j - i, hi - i), bool)
        for c in range(4):
            far &= (table[i:j, c][:, None] - table[i:hi, c][None] + np.uint8(near)) <= 2 * near
        p, q = np.nonzero(far)
        p, q = p[q > p] + i, q[q > p] + i
        for c in range(4, table.shape[1]):
            ok = (table[p, c] - table[q, c] + np.uint8(near)) <= 2 * near
            p, q = p[ok], q[ok]
        ok = (np.bitwise_count(fp[p] ^ fp[q]) <= near) & (label[p] != label[q])
        p, q = p[ok], q[ok]
        while len(p):  # the smaller label wins, until linked members agree
            low = np.minimum(label[p], label[q])
            np.minimum.at(label, label[p], low)
            np.minimum.at(label, label[q], low)
            while (label[label] != label).any():
                label = label[label]
            ok = label[p] != label[q]
            p, q = p[ok], q[ok]
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[at], fp[label[at]]


def _links(near: int):
    """Links of all tiles of a partition that is sorted by tile."""
    def flush(held):
        fp = np.concatenate([x[0] for x in held])
        if len(fp) < 2:
            return []
        return [tile_links(fp.view(U), np.concatenate([x[1] for x in held]), near)]

    def run(batches):
        held, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            mask, value, fp, d0, d1 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "value", "fp", "d0", "d1"))
            table = np.stack([d0, d1], axis=1).view(np.uint8)
            cut = [0, *(np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1), len(fp)]
            found = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if held and (mask[lo], value[lo]) != now:
                    found += flush(held)
                    held = []
                now = (mask[lo], value[lo])
                held.append((fp[lo:hi], table[lo:hi]))
            if found:
                yield _edges(found)
        if held and (found := flush(held)):
            yield _edges(found)
    return run


def _edges(found):
    u, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(scan.signed(u)), pa.array(scan.signed(v))], names=["u", "v"])


def _oversized(tiles: DataFrame) -> DataFrame:
    """Keys of the tiles to deal out again."""
    return (tiles.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("c"))
            .where((F.col("c") > TILE) & (F.lit(BITS) - F.bit_count("mask") > NEAR)).select("mask", "value"))


def links(nodes: DataFrame, near: int = NEAR) -> DataFrame:
    """(u, v): edges between different fingerprints ``nodes`` (fp); two are connected by edges just if a chain of pairs within ``near`` bits joins them."""
    spark = nodes.sparkSession
    fp = F.col("fp")
    start = [F.lit(m - (1 << 64) if m >> 63 else m) for m in blocks(0, near + 1)]
    tiles = (nodes.select("fp", *_distances(fp)).select("*", F.explode(F.array(*start)).alias("mask"))
             .select("mask", fp.bitwiseAND(F.col("mask")).alias("value"), "fp", "d0", "d1"))
    found, scratch, layout = [], [], "mask long, value long, fp long, d0 long, d1 long"
    while True:
        large = kit.write(spark, _oversized(tiles), "oversized")
        scratch.append(large)
        n = large.count()
        key = F.broadcast(large) if n <= BROADCAST_ROWS else large
        fit = tiles.join(key, ["mask", "value"], "left_anti") if n else tiles
        found.append(kit.write(spark, fit.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(_links(near), "u long, v long").distinct(), "links"))
        if not n:
            break
        tiles = kit.write(spark, tiles.join(key, ["mask", "value"], "left_semi").mapInArrow(_deal(near), layout).distinct(), "tiles")
        scratch.append(tiles)
    edges = kit.write(spark, reduce(DataFrame.union, found).distinct(), "links")
    kit.discard(*scratch, *found)
    return edges


def near_duplicates(docs: DataFrame, near: int = NEAR, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    spark = docs.sparkSession
    rows = kit.write(spark, fingerprints(docs, words=words), "fingerprints")
    nodes = kit.write(spark, rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    edges = links(nodes.select("fp"), near)
    stars = kit.components(spark, edges)
    roots = stars.union(stars.select("root", "root")).distinct().toDF("fp", "root")
    linked = kit.write(spark, nodes.join(roots, "fp").select("fp", "root", "low"), "linked")
    best = linked.groupBy("root").agg(F.min("low").alias("least"))
    low = (nodes.join(linked.join(best, "root").select("fp", "least", F.lit(True).alias("found")), "fp", "left")
           .select("fp", F.when(F.col("found"), F.col("least")).otherwise(F.col("low")).alias("component_id")))
    both = kit.join_spread(rows, low, "fp")
    return both.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(kit.table(spark, sf_dir, "documents"))
