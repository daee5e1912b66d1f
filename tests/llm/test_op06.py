"""Fingerprints: order and edits against plain Python, chunking against a byte-by-byte loop, resistance to shifts."""

import hashlib
import random

import numpy as np

from tillroll.llm import op06_fingerprints as op

DOC = "doc_id long, text string, range string"


def slow_ends(raw):
    h, at, out = 0, 0, []
    hashes = []
    for k in range(len(raw)):
        h = sum(int(op.GEAR[raw[k - j]]) << j for j in range(min(32, k + 1))) & 0xFFFFFFFF
        hashes.append(h)
    while len(raw) - at > op.SMALLEST:
        end = min(at + op.LARGEST, len(raw))
        for e in range(at + op.SMALLEST, min(at + op.LARGEST, len(raw)) + 1):
            bits = op.STRICT if e <= at + op.NORMAL else op.LAX
            if hashes[e - 1] >> (32 - bits) == 0:
                end = e
                break
        at = end
        out.append(at)
    return out + ([len(raw)] if at < len(raw) else [])


def text(rng, n):
    return "".join(rng.choice("abcdefgh ijklé\n") for _ in range(n))


def test_chunks(monkeypatch):
    rng = random.Random(1)
    for n in (0, 1, 24, 25, 300, 5000):
        raw = text(rng, n).encode()
        assert op.chunk_ends(np.frombuffer(raw, np.uint8)).tolist() == slow_ends(raw)
    raw = text(rng, 6000).encode() + b"a" * 2000
    want = op.chunk_ends(np.frombuffer(raw, np.uint8)).tolist()
    monkeypatch.setattr(op.scan, "SLAB", 700)
    assert op.chunk_ends(np.frombuffer(raw, np.uint8)).tolist() == want


def test_likeness_resists_shifts():
    rng = random.Random(2)
    a, b = text(rng, 20000), text(rng, 20000)
    p = [op.fingerprint(x.encode()) for x in (a, "new words in front " + a, a[:9000] + "middle" + a[9000:], b, a[:10000])]
    assert op.likeness(p[0], p[0]) == 1.0 and op.likeness(p[0], p[1]) > 0.98 and op.likeness(p[0], p[2]) > 0.98
    assert op.likeness(p[0], p[3]) == 0.0 and 0.45 < op.likeness(p[0], p[4]) < 0.55
    assert (op.decode(op.encode(p[0])) == p[0]).all()


def test_rows(spark):
    rng = random.Random(3)
    data = [(3 * i, text(rng, rng.choice([0, 3, 200, 3000])), "r") for i in range(200)]
    data += [(600, None, None), (601, "x" * 500_000, "r"), (602, "é😀 " * 50, "r"), (30, data[10][1], "r"), (603, data[5][1], "r"), (None, "null id comes first " * 30, "r")]
    rng.shuffle(data)
    rows = {(r.doc_id, r.n_chars): r for r in op.fingerprints(spark.createDataFrame(data, DOC).repartition(5)).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(rows) == len(data) - 1  # one row is repeated whole
    for (i, t, _), (_, u, _) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        q = len(t) // 4
        e = t[:len(t) - q] + u[:q]
        r = rows[i, len(t)]
        if i == 30:
            continue  # of equal rows one is followed by the other
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b, c = (op.fingerprint(x.encode()) for x in (t, e, u))
        assert (r.fingerprint, r.edited_fingerprint) == (op.encode(a), op.encode(b))
        assert (r.near_edited, r.near_next) == (op.likeness(a, b), op.likeness(a, c))


def test_small_tables(spark):
    assert op.fingerprints(spark.createDataFrame([], DOC)).collect() == []
    one = op.fingerprints(spark.createDataFrame([(5, "abcdefgh" * 20, "")], DOC)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert sorted(r.near_next for r in op.fingerprints(spark.createDataFrame([(None, None, ""), (None, None, ""), (1, "a", "")], DOC)).collect()) == [0.0, 0.0, 1.0]
