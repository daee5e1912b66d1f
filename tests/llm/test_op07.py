"""Co-training: measures against plain Python, held-out accuracy, and defined results of odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tillroll.llm import op07_quality_cotraining as op

DOC, LABEL = "doc_id long, text string, lang string, source string, score long", "doc_id long, quality int, toxic int"


def table(n=1500, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 120))]
        if not good:
            w = rng.choice([[x + "!!" for x in w], [w[0]] * 60, [x.upper() for x in w], [x + " |" for x in w]])
        docs.append((i, " ".join(w), "en", rng.choice(["a", "b"] if good else ["b", "c"]), 5))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = table()
    odd = [(5000, None, None, None, None), (5001, "", "en", "a", 1), (None, "Hello there", "en", "s", 1), (3, docs[3][1], "en", "a", 1), (5002, "word " * 300_000, "xx", None, 0)]
    d, y = spark.createDataFrame(docs + odd, DOC), spark.createDataFrame([x for x in labels if x[0] % 2 or x[0] < 900] + [(7, labels[7][1], 0), (None, 1, 1), (9999, 1, 1)], LABEL)
    rows = op.quality(d, y).collect()
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == len(docs) + len(odd) and len(held) > 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert np.mean([r.keep == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in rows)


def test_no_labels_and_empty(spark):
    d, none = spark.createDataFrame([(1, "a b", "en", "s", 1)], DOC), spark.createDataFrame([], LABEL)
    assert [tuple(r) for r in op.quality(d, none).select("doc_id", "score", "keep").collect()] == [(1, 0.5, True)]
    assert op.quality(spark.createDataFrame([], DOC), none).collect() == []
    assert op.quality(d, spark.createDataFrame([(1, 0, 1)], LABEL)).count() == 1


def test_measures():
    x = op.measures(pa.array(["aa bb aa aa\nCC dd!", None, "", "line\nline\nline"]))
    m = {k: x[:, i] for i, k in enumerate(op.MEASURES)}
    assert m["words"][0] == np.log1p(6) and m["different"][0] == 4 / 6 and m["most_repeated"][0] == 0.5 and m["capitals"][0] == 2 / 18
    assert m["repeated_lines"][3] == 1 - 1 / 3 and m["stops"][0] == 1 / 18 and (x[1] == 0).all() and (x[2] == 0).all()


def test_all_unlabelled_rows_are_searched(spark):
    """The bound on labelled rows is none on the others, and sources beyond those with a column of their own can be told apart."""
    docs, labels = table(900)
    docs = [(*x[:3], f"{x[3]}{i % 60}", x[4]) for i, x in enumerate(docs)]
    known = [x for x in labels if x[0] < 160 and zlib.crc32(str(x[0]).encode()) % 4 != 2]
    model = op.CoTraining.fit(spark.createDataFrame(docs, DOC), spark.createDataFrame(known, LABEL).select("doc_id", "quality"), rows=100)
    assert max(map(sum, model.handed.values())) > 400
    one = spark.createDataFrame([(f"new {i}", "en", [0.0] * len(op.MEASURES)) for i in range(20)], "source string, lang string, a array<double>")
    assert len({r.vb for r in model.features(one).collect()}) > 5


def test_repeated_and_null_ids(spark):
    """Unlabelled rows of one id or none are all searched; of a labelled id's rows one, whatever their order."""
    docs, labels = table(900)
    known = [x for x in labels if x[0] < 300 and zlib.crc32(str(x[0]).encode()) % 4 != 2]
    docs = [x if x[0] < 300 else (None if x[0] % 2 else 1, *x[1:]) for x in docs]
    y = spark.createDataFrame(known, LABEL).select("doc_id", "quality")
    blank = [x if x[0] != 1 else (10_001, *x[1:]) for x in docs]                  # id 10001 has no label
    fits = [op.CoTraining.fit(spark.createDataFrame(rows, DOC).repartition(n), y) for rows, n in ((blank, 2), (blank[::-1], 5))]
    assert zlib.crc32(b"10001") % 4 != 2 and fits[0].mean == fits[1].mean
    assert all(max(map(sum, f.handed.values())) > 400 for f in fits)
    model = op.CoTraining.fit(spark.createDataFrame(docs, DOC), y)                # id 1 is labelled: one of its rows
    assert model.mean == np.mean([q for i, q, _ in known])
