"""Toxicity: held-out accuracy on a fixture, feature rules, and defined results of odd tables."""

import random
import zlib

import numpy as np
import pyarrow as pa

from tillroll.llm import op10_toxicity as op

RUDE = ["blorgface", "snarfling", "quizzlump"]


def table(n=1600, seed=4):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randint(0, len(w)), rng.choice(RUDE) + rng.choice(["", "s", "ing", "er"]))
        docs.append((i, " ".join(w).capitalize(), "en", "s", 5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


DOC, LABEL = "doc_id long, text string, lang string, source string, score long", "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs, labels = table()
    odd = [(5000, None, None, None, None), (5001, "", "en", "s", 1), (None, "Hello there", "en", "s", 1), (3, docs[3][1], "en", "s", 1),
           (5002, "You are such a BLORGFACE, quizzlump! " * 3, "xx", None, 0), (5003, "word " * 30000 + "snarfling", "en", "s", 0)]
    d, y = spark.createDataFrame(docs + odd, DOC), spark.createDataFrame(labels + [(7, 1, labels[7][2]), (None, 1, 1), (9999, 1, 1)], LABEL)
    rows = op.toxicity(d, y).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 300
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[5002].predicted == 1 and by[5000].predicted == by[5001].predicted == 0 and by[5000].score == by[5001].score and not by[None].held_out
    kept = op.without_toxic(d, y)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.predicted == 0)


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a b", "en", "s", 1)], DOC)
    none = spark.createDataFrame([], LABEL)
    assert [tuple(r) for r in op.toxicity(d, none).select("doc_id", "score", "predicted").collect()] == [(1, 0.0, 0)]
    assert op.toxicity(spark.createDataFrame([], DOC), none).collect() == []
    assert op.toxicity(d, spark.createDataFrame([(1, 1, 1)], LABEL)).count() == 1


def test_features():
    lexicon = np.sort(np.array([op._name("blorgface")], np.uint64))
    x = op.features(pa.array(["you blorgface", "BLORGFACE a b c d e f g h you", "b10rgface now", None, "1234", "x" * 3_000_000]), lexicon)
    f = {k: x[:, i] for i, k in enumerate(op.FEATURES)}
    assert f["learned"].tolist() == [0.5, 0.1, 0, 0, 0, 0] and f["near_you"].tolist() == [1, 0, 0, 0, 0, 0]
    assert f["odd_lexicon"][2] > 0 and f["capitals"][1] == 9 / len("BLORGFACE a b c d e f g h you") and (x[3] == 0).all() and f["digits"][4] == 1


def test_one_text_of_a_repeated_id_is_learned_from(spark):
    """Rows of one id with different texts: the fit is the same whatever their order and partitions."""
    docs, labels = table(700)
    other = [(i, f"other text {i} you moron", "en", "s", 1) for i, *_ in docs[:200]]
    y = spark.createDataFrame(labels, LABEL)
    probe = spark.createDataFrame(docs[:50], DOC).selectExpr("doc_id as key", "text")
    got = [sorted(map(tuple, op.fit_on(spark.createDataFrame(rows, DOC).repartition(n), y).score(probe).collect()))
           for rows, n in ((docs + other, 2), (other + docs, 5))]
    assert got[0] == got[1]


def test_long_words_can_mark(spark):
    """A word of any length enters the lexicon."""
    long = "sn" + "a" * 60 + "rf"
    rows = [(i, f"some words {long if i % 4 == 0 else 'quiet'} {i}", int(i % 4 == 0)) for i in range(200)]
    assert op._name(long) in op.learn_lexicon(spark.createDataFrame(rows, "key long, text string, label int")).tolist()
