"""Jaccard join against all pairs of a small table."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tillroll.llm import op05_jaccard_join as op

SCHEMA = "doc_id long, text string, source string"


def shingles(t):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=repr)


def rows(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["Élan", "the", "OF"]
    line = " ".join(rng.choice(vocab) for _ in range(40))
    out, n = [], 0
    for _ in range(25):  # families of copies with edits about the threshold, sharing a passage between families
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 30, 90, 250]))] + (line.split() if rng.random() < 0.6 else [])
        for _ in range(rng.choice([1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], "new"]]) or ["x"]
            out.append((n, rng.choice([" ", "\n", "  "]).join(w), "s"))
            n += 1
    chain = [rng.choice(vocab) for _ in range(120)]
    for i in range(30):  # each is like the next, the ends are not alike
        out.append((n, " ".join(chain), "chain"))
        n += 1
        chain[(7 * i) % 120] = f"c{i}"
    out += [(n, None, None), (n + 1, "", "s"), (n + 2, " \n\t", "s"), (n + 3, "one two", "s"), (n + 4, "ONE  two", "s"), (n + 5, "two one", "s"),
            (None, "one two", "s"), (None, "lone null id words here now", "s"), (0, out[0][1], "s"), (n + 6, out[3][1], None)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed,block", [(1, 2048), (2, 3)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(op, "BLOCK", block)
    data = rows(seed)
    got = [tuple(r) for r in op.jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=repr) == brute(data)


def test_texts_with_equal_hashes_are_told_apart(spark, monkeypatch):
    """Names of five bits: all texts share their first hash with others."""
    monkeypatch.setattr(op.kit, "text_hash", lambda col="text": F.pmod(F.xxhash64(op.kit.text_of(col)), F.lit(32)))
    data = rows(3)
    got = [tuple(r) for r in op.jaccard_join(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(got, key=repr) == brute(data)


def test_tile_of_twenty_thousand_members(spark):
    """A hot group of near copies, and a few texts of other classes that share its passage: no task gets more than two blocks."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    data = [(i, " ".join([*base, f"x{i}"]), "hot") for i in range(20_000)]
    data += [(30_000 + i, " ".join(base[:45] + [f"y{i}v{rng.randrange(9)}{j}" for j in range(25)]), "other") for i in range(40)]
    data += [(40_000 + i, " ".join(base[:45] + [f"z{j}" for j in range(25)] + [f"u{i}"]), "third") for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.jaccard_join(spark.createDataFrame(data, SCHEMA).repartition(8)).collect()}
    assert len(got) == len(data)
    assert all(got[i] == (67, 0) for i in range(20_000)) and all(got[i] == (66, i) for i in range(30_000, 30_040)) and all(got[i] == (67, 40_000) for i in range(40_000, 40_030))


def test_components_grow(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    df = lambda e: spark.createDataFrame(e, "u long, v long")
    root = {}
    for u, v in edges:
        seen, todo = {u, v}, [u, v]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        root.update({x: min(seen) for x in seen if x != min(seen)})
    known = op.kit.components(spark, df(edges[:90]))
    got = op.kit.grow(spark, op.kit.grow(spark, known, df(edges[90:])), df(edges[50:100]))
    assert {r.node: r.root for r in got.collect()} == root


def test_empty(spark):
    assert op.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []
    assert op.one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(5, long, "a", 1), (2, long + " end", "b", 2), (2, long + " end", "b", 2), (7, "", "c", 3), (None, None, "d", 4), (None, long, "e", 5)],
                               "doc_id long, text string, root string, t int")
    got = op.one_of_each(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.root) for r in got.collect()) == [(False, 2, "b"), (False, 7, "c"), (True, 0, "d")]
