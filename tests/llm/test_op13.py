"""Collocations against counts of every phrase."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import op13_collocations as op

SCHEMA = "doc_id long, text string, lang string, w1 string, n int"


def brute(data, least, longest=4, top=2000, inside=80):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in data:
        lang = "und" if lang is None else lang
        low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang] += len(w)
            f.update((lang, w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    gone = set()
    for (lang, w), c in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if 100 * c >= inside * f[lang, w[i:i + k]]:
                    gone.add((lang, w[i:i + k]))
    out = []
    for lang in n:
        rows = []
        for (g, w), a in cand.items():
            if g == lang and (g, w) not in gone:
                score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
                rows.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def rows(seed, docs=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["The", "the", "of", "É", "straße", "a", "a b", "x'y"]
    fixed = [["in", "spite", "of", "the"], ["New", "York"], ["a", "a", "a"], ["one", "two", "three", "four", "five"]]
    out = []
    for i in range(docs):
        w = []
        for _ in range(rng.randint(0, 60)):
            w += rng.choice(fixed) if rng.random() < 0.2 else [rng.choice(vocab)]
        text = "".join(x + rng.choice([" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "; "]) for x in w)
        out.append((i, text, rng.choice(["en", "en", "de", None, "und", "É"]), "x", 1))
    return out + [(docs, None, "en", None, 1), (None, "", "fr", None, 1), (None, "a a a a a a a", "en", "", 1), (3, out[3][1], out[3][2], "", 1)]


@pytest.mark.parametrize("seed,least,slab,bits", [(1, 5, 1 << 20, 28), (2, 3, 64, 28), (3, 8, 200, 5)])
def test_equals_counts_of_every_phrase(spark, monkeypatch, seed, least, slab, bits):
    """Also with texts cut into small steps, and with a filter so full that it holds everything."""
    data = rows(seed)
    monkeypatch.setattr(op.scan, "SLAB", slab)
    monkeypatch.setattr(op.support, "BLOOM_BITS", bits)
    got = op.collocations(spark.createDataFrame(data, SCHEMA).repartition(7), least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(data, least)


def test_top_and_ties(spark):
    data = rows(4)
    got = op.collocations(spark.createDataFrame(data, SCHEMA), 4, top=9)
    assert sorted(map(tuple, got.collect())) == brute(data, 4, top=9)


def test_empty_and_long(spark):
    assert op.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "red car " * 400_000 + "blue car, " * 40
    data = [(1, text, "en", "", 0)]
    assert sorted(map(tuple, op.collocations(spark.createDataFrame(data, SCHEMA)).collect())) == brute(data, 30)


def test_support_blocks_round_trip():
    h = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    n = np.arange(len(h))
    b = op.support.pack(h, n, 40)
    back = [op.support.unpack(x, y) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert (np.concatenate([x for x, _ in back]) == h).all() and (np.concatenate([y for _, y in back]) == n).all()
