"""Tokenizer against the library; packing against its own rules, a brute-force best fit, and an exact round trip."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tillroll.llm import op04_best_fit_packing as op4
from tillroll.llm import op08_packed_matrices as op8
from tillroll.llm import tokens

SCHEMA = "doc_id long, text string, length string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def documents(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    out = [(i, " ".join(word() for _ in range(rng.choice([1, 5, 40, 300, 900]))), "x") for i in range(80)]
    out += [(80, None, None), (81, "", "x"), (None, "no id", "x"), (3, out[3][1], "x"), (82, "a " * 9000, "x"), (83, out[4][1], "x")]
    return out


def test_ids_equal_the_library(library):
    rng = random.Random(7)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "é", "1", "²", "_", "-", "!", "中", "😀", "\x1c", "​", " ", "'S", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, ""]
    got = [list(map(int, ids)) for _, ids in tokens.rows_of_ids(pa.array(texts), tokens.default_path())]
    assert got == [library(x) for x in texts]


def test_spelled_out_added_tokens(spark, tmp_path):
    """Against the library as it stands: <|endoftext|> in a text is one id, also beside other text, white space and row borders."""
    t = Tokenizer.from_file(tokens.default_path())
    plain = lambda x: t.encode(x or "", add_special_tokens=False).ids
    rng = random.Random(8)
    parts = ["<|endoftext|>", "<|endoftext|>", "<|endof", "text|>", "<", "|>", "'", "s", "re", " ", "  ", "\n", "a", "é", "1", "!", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + ["x<|endof", "text|>y", None, "", "a<|endoftext|>b"]
    got = [list(map(int, ids)) for _, ids in tokens.rows_of_ids(pa.array(texts), tokens.default_path(), added=True)]
    assert got == [plain(x) for x in texts] and got[-1] == [64, 50256, 65]
    data = [(i, x, "x") for i, x in enumerate(texts[-300:])]
    rows = op4.best_fit_packing(spark.createDataFrame(data, SCHEMA)).collect()
    want = [(i, len(plain(x)) + 1, zlib.crc32(np.array(plain(x) + [0], "<u4").tobytes())) for i, x, _ in data]
    assert sorted((r[0], r[3], r[4]) for r in rows) == want
    op8.write_packed(op8.packed_matrices(spark.createDataFrame(data, SCHEMA)), str(tmp_path / "packed"))
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in op8.unpack(spark.read.parquet(str(tmp_path / "packed"))).collect()}
    assert back == {i: plain(x) + [op8.END_ID] for i, x, _ in data}


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= n]
        if fit:
            bins[min(fit, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, rng.choice([10, 60, 100])) for _ in range(rng.choice([1, 50, 700]))] + [33] * rng.choice([0, 400])
    plan, n = op4.pack_runs(Counter(lengths), 100)
    assert n == brute_best_fit(lengths, 100) == len(op8.best_fit_decreasing(np.array(lengths), 100))
    fill = defaultdict(list)
    for length, _, m, first, offset in plan.tolist():
        for s in range(first, first + m):
            fill[s].append((offset, length))
    assert Counter(x for v in fill.values() for _, x in v) == Counter(lengths) and len(fill) == n
    for v in fill.values():
        v.sort()
        assert [o for o, _ in v] == [sum(x for _, x in v[:k]) for k in range(len(v))] and sum(x for _, x in v) <= 100


def test_best_fit_packing(spark, library):
    data = documents()
    rows = op4.best_fit_packing(spark.createDataFrame(data, SCHEMA)).collect()
    want = []
    for i, t, _ in data:
        ids = np.array(library(t) + [0], "<u4")
        at = 0
        for k, n in enumerate(op4.piece_lengths(len(ids), 2048)):
            want.append((i, k, at, n, zlib.crc32(ids[at:at + n].tobytes())))
            at += n
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(want, key=repr)
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for v in fill.values():
        v.sort()
        assert [o for o, _ in v] == [sum(x for _, x in v[:k]) for k in range(len(v))] and sum(x for _, x in v) <= 2048
    assert len(fill) == brute_best_fit([w[3] for w in want], 2048)
    assert op4.best_fit_packing(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packed_matrices_round_trip(spark, library, tmp_path, monkeypatch):
    data = [r for r in documents(2) if r[0] not in (3, None)]
    op8.write_packed(op8.packed_matrices(spark.createDataFrame(data, SCHEMA)), str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in op8.unpack(packed).collect()}
    assert got == {i: library(t) + [op8.END_ID] for i, t, _ in data}
    for r in packed.collect():
        assert r.ends[0] == 0 and r.ends[-1] == r.n_ids and len(r.ids) == len(r.positions) == 4 * 2048
        pos = np.frombuffer(r.positions, "<u4")
        assert all(pos[lo:hi].tolist() == list(range(hi - lo)) for lo, hi in zip(r.ends[:-1], r.ends[1:], strict=True))
    assert len({(r.part, r.sequence) for r in packed.collect()}) == packed.count()
    assert op8.packed_matrices(spark.createDataFrame([], SCHEMA)).collect() == []
