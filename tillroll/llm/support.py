"""Which hashes occur at least so many times in all tasks: compact counting, and the answer as a Bloom filter.

A task sorts its hashes and hands them on as blocks of differences and counts, one row a hash range, in byte planes that compress to four to six
bytes an entry; a range is summed in one task at a time. The filter's size follows the number of hashes found up to 2^28 bits. It
holds every hash that reaches the count, so what it does not hold may be left out; a fuller filter only leaves out less.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import kit, scan

SCHEMA = "part int, hashes binary, counts binary"
#: hash ranges, and entries that a task holds before it hands them on
RANGES, HELD = 1024, 1 << 21
BLOOM_BITS = 28
#: largest single count that is handed on; a task's count over it is handed on as this
MOST = 0xFFFF
_PROBES = (0, 19)
U = np.uint64


def pack(h: np.ndarray, n: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sorted hashes below 2**bits with counts as one row a hash range."""
    part = (h >> U(bits - RANGES.bit_length() + 1)).astype(np.int64)
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(h)]
    planes = lambda x: x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    rows = [(int(part[i]), planes(np.diff(h[i:j], prepend=U(0))), planes(np.minimum(n[i:j], MOST).astype(np.uint16))) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    kinds = [pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "hashes", "counts"])


def unpack(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    def whole(x, t):
        return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(t).itemsize, -1).T).view(t).ravel()
    return np.cumsum(whole(hashes, U), dtype=U), whole(counts, np.uint16).astype(np.int64)


def _merge(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[at], np.add.reduceat(n, at)


def blocks(found: Iterable[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's (hashes, counts), in bounded memory."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for h, n in found:
        if len(h):
            held.append((h, n))
        if sum(len(x) for x, _ in held) > HELD:
            held = [_merge(held)]
            if len(held[0][0]) > HELD // 2:
                yield pack(*held[0], bits)
                held = []
    if held:
        yield pack(*_merge(held), bits)


def _enough(least: int):
    """Of blocks sorted by range: the hashes whose sum reaches ``least``, range by range."""
    def run(batches):
        part, held = None, []

        def sums():
            h, n = _merge(held)
            return pa.RecordBatch.from_arrays([pa.array(scan.signed(h[n >= least]))], names=["h"])
        for b in batches:
            for p, h, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if p != part and held:
                    yield sums()
                    held = []
                part = p
                held.append(unpack(h, n))
                if sum(len(x) for x, _ in held) > 4 * HELD:
                    held = [_merge(held)]
        if held:
            yield sums()
    return run


def _places(h: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for shift in _PROBES:
        x = (h * U(0x9E3779B97F4A7C15) >> U(shift)) & U(bits - 1)
        yield (x >> U(3)).astype(np.int64), (x & U(7)).astype(np.uint8)


def has(bloom: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each hash; no filter holds all."""
    found = np.ones(len(h), bool)
    if bloom is not None:
        for at, bit in _places(h, 8 * len(bloom)):
            found &= (bloom[at] >> bit & 1).astype(bool)
    return found


def _bits(size: int):
    """The filter's set bits of a task's hashes, as one row a piece of 2^16 bytes."""
    def run(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            for at, bit in _places(b.column("h").to_numpy(zero_copy_only=False).view(U), 8 * size):
                np.bitwise_or.at(bits, at, np.left_shift(np.uint8(1), bit))
        for at in range(0, size, 1 << 16):
            if bits[at:at + (1 << 16)].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([bits[at:at + (1 << 16)].tobytes()], pa.binary())], names=["at", "bits"])
    return run


def reaching(spark: SparkSession, counted: DataFrame, least: int) -> np.ndarray:
    """Bloom filter of the hashes whose counts in ``counted`` (rows of :func:`blocks`) sum to ``least`` or more."""
    if least > MOST:
        raise ValueError(f"least must be at most {MOST}")
    enough = kit.write(spark, counted.repartition("part").sortWithinPartitions("part").mapInArrow(_enough(least), "h long"), "support")
    size = (1 << min(BLOOM_BITS, max(10, (16 * enough.count()).bit_length()))) // 8
    bits = np.zeros(size, np.uint8)
    few = enough.coalesce(16).mapInArrow(_bits(size), "at long, bits binary")  # at most 16 copies of a filter, 32 MB each
    for r in few.toLocalIterator():
        bits[r.at:r.at + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    kit.discard(enough)
    return bits
