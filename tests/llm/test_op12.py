"""SimHash classes against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tillroll.llm import op12_simhash as op

SCHEMA = "doc_id long, text string, fp string, mask int"


def plain(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    s = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64(x, seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, ids, near=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= near:
                root[find(i)] = find(j)
    low = {}
    for i, x in enumerate(ids):
        if x is not None:
            low[find(i)] = min(low.get(find(i), x), x)
    return [low.get(find(i)) for i in range(len(fps))]


def texts(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["The", "É", "ß"]
    out = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([2, 5, 40, 300, 900]))]
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out + [None, "", " \n", "one two", "ONE two", "One\ttwo  three four", out[0], out[0].upper()]


@pytest.mark.parametrize("seed,tile,slab", [(1, 4096, 1 << 20), (2, 40, 50)])
def test_equals_all_pairs(spark, monkeypatch, seed, tile, slab):
    """Also with small tiles, and with texts hashed in small steps."""
    monkeypatch.setattr(op, "TILE", tile)
    monkeypatch.setattr(op.scan, "SLAB", slab)
    data = [(None if i % 17 == 3 else i // 2, t, "x", 1) for i, t in enumerate(texts(seed))]
    fps = [plain(t) for _, t, *_ in data]
    want = sorted(((d[0], f"{f:016x}", c) for d, f, c in zip(data, fps, classes(fps, [d[0] for d in data]), strict=True)), key=repr)
    got = op.near_duplicates(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_empty(spark):
    assert op.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def clustered(seed, n):
    """Fingerprints about the threshold from each other, in chains and balls."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n // 4)] + [0, (1 << 64) - 1, 1 << 63]
    while len(out) < n:
        out.append(rng.choice(out) ^ sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 3, 4, 5, 6]))) & (1 << 64) - 1)
    return sorted(set(out))


@pytest.mark.parametrize("tile", [4096, 60])
def test_links_of_any_fingerprints(spark, monkeypatch, tile):
    monkeypatch.setattr(op, "TILE", tile)
    fps = clustered(tile, 700)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = [(r.u % (1 << 64), r.v % (1 << 64)) for r in op.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all((u ^ v).bit_count() <= 64 for u, v in edges)
    index = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for u, v in edges:
        root[find(index[u])] = find(index[v])
    want = classes(fps, range(len(fps)))
    low = {}
    for i in range(len(fps)):
        low.setdefault(find(i), i)
    assert [low[find(i)] for i in range(len(fps))] == want


def test_hot_tile_of_near_copies():
    """Twenty thousand different fingerprints around one: each within two bits of it, all in a few tiles."""
    rng = np.random.default_rng(3)
    centre = np.uint64(0x0123456789ABCDEF)
    a, b = rng.integers(0, 64, (2, 60_000), dtype=np.uint64)
    fp = np.unique(centre ^ (np.uint64(1) << a) ^ (np.uint64(1) << b))
    fp = np.concatenate([fp, fp ^ np.uint64(0xFFFF0000FFFF0000)])
    table = np.stack([np.bitwise_count(fp ^ np.uint64(p % (1 << 64))) for p in op.pivots()], axis=1)
    u, v = op.tile_links(fp, table)
    assert len(u) == len(fp) - 2 and len(np.unique(v)) == 2


def test_pivot_columns_never_discard_a_link():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    for p in op.pivots():
        p = np.uint64(p % (1 << 64))
        assert np.abs(np.bitwise_count(x ^ p).astype(int) - np.bitwise_count(y ^ p)).max() <= 4
    assert len({((a ^ b) % (1 << 64)).bit_count() for a in op.pivots() for b in op.pivots() if a != b}) == 1


def test_sql_of_the_query(spark):
    """The SQL is text, and equals the operator on shingles of all lengths, null texts and null ids."""
    import duckdb

    from tillroll.llm import catalog
    assert all(isinstance(sql, str) for sql in catalog.ORACLES.values())
    rng = random.Random(3)
    data = [(None if i % 17 == 3 else i // 2, t, "x", 1) for i, t in enumerate([
        *texts(3)[:60], None, "", " \n", "a", "É" * 9, "One\ttwo  three four", "one two three FOUR", *("x" * n for n in range(1, 100)),
        *(" ".join("yzé"[rng.randrange(3)] * rng.randint(1, 30) for _ in range(9)) for _ in range(40))])]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [d[:2] for d in data])
    got = op.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(con.execute(catalog.ORACLES["op12_simhash"]).fetchall(), key=repr)
