"""Suffix dedup against a brute-force scan of every string."""

import hashlib
import random

import pytest

from tillroll.llm import op01_suffix_dedup as op

SCHEMA = "doc_id long, text string, source string"


def brute(rows, length):
    seen = {}
    for r, (_, t, *_) in enumerate(rows):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], []).append((r, s))
    cut = [[False] * len((t or "").encode()) for _, t, *_ in rows]
    for places in seen.values():
        if len(places) > 1:
            for r, s in places:
                cut[r][s:s + length] = [True] * length
    out = []
    for (i, t, *_), c in zip(rows, cut, strict=True):
        b = (t or "").encode()
        kept = bytes(x for x, gone in zip(b, c, strict=True) if not gone)
        spans = sum(g and (k == 0 or not c[k - 1]) for k, g in enumerate(c))
        out.append((i, len(b), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def text(rng, n, alphabet="abcdefghij klmé\n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def rows(seed):
    rng = random.Random(seed)
    base = text(rng, 3000)
    out = [(i, text(rng, rng.randint(0, 1500)), "s") for i in range(25)]
    for i in range(25, 60):  # passages about the threshold, at many places, some touching or overlapping
        a = rng.randint(0, 2000)
        p = base[a:a + rng.choice([127, 128, 129, 130, 140, 200, 260, 700])]
        out.append((i, text(rng, rng.randint(0, 90)) + p + text(rng, rng.choice([0, 0, 1, 50])) + base[a + 60:a + 60 + rng.randint(90, 180)], "s"))
    out += [(60, base, "s"), (61, base, "s"), (61, base, "s"), (62, base[:1500] + "#" + base[1501:], "s"), (63, None, None), (None, "", "s"),
            (64, "a" * 700, "s"), (65, "ab" * 200 + "z", "s"), (66, "x" * 128, "s"), (67, "x" * 127, "s"), (68, "line one\n" * 60, "s")]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    data = rows(seed)
    got = [tuple(r) for r in op.suffix_dedup(spark.createDataFrame(data, SCHEMA), length=128).collect()]
    assert sorted(got, key=repr) == brute(data, 128)


def test_steps_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(op.scan, "SLAB", 300)  # this process only: the functions are pure, so call them directly
    import numpy as np
    rng = random.Random(5)
    b = text(rng, 4000).encode()
    data, off = np.frombuffer(b, np.uint8), np.array([0, len(b)])
    small = [np.concatenate(x) for x in zip(*op._runs_of_rows(data, off, 128), strict=True)]
    monkeypatch.setattr(op.scan, "SLAB", 1 << 20)
    large = [np.concatenate(x) for x in zip(*op._runs_of_rows(data, off, 128), strict=True)]
    assert all((x == y).all() for x, y in zip(small, large, strict=True))


def test_empty_and_extra_columns(spark):
    assert op.suffix_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "".join(chr(97 + i * i % 23) for i in range(900))
    df = spark.createDataFrame([(1, long, 5, "x"), (2, "intro " + long, 6, None), (3, "short", 7, "y")],
                               "doc_id long, text string, n_chars long, n_bytes string")
    kept = {r.doc_id: r for r in op.without_repeats(df).collect()}
    assert kept[1].text == "" and kept[1].n_chars == 0 and kept[2].text == "intro " and kept[3].text == "short" and kept[3].n_chars == 7
    assert kept[1].n_bytes == "x"


def test_cells_come_in_small_batches():
    import pyarrow as pa

    from tillroll.llm import op01_suffix_dedup as OP
    text = pa.array(["ab" * 400_000])
    starts = pa.array([[{"a": 600_000, "lo": 0, "hi": 599_000, "m": 2}]], pa.list_(pa.struct([(c, pa.int64()) for c in ("a", "lo", "hi", "m")])))
    batch = pa.RecordBatch.from_arrays([text, pa.array([1]), pa.array([2]), starts], ["text", *OP.KEYS, "starts"])
    sizes = [b.num_rows for b in OP._cells(400, 1)([batch])]
    assert sum(sizes) == 599_001 and max(sizes) <= 1 << 18
