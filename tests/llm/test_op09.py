"""Decontamination: planted leaks, re-parameterised questions, inconsistent slots, clean texts, and a brute-force scan of literal windows."""

import random
import re

from tillroll.llm import op09_decontamination as op

DOC, ITEM = "doc_id long, text string, key string", "item_id long, text string, key int"
QUESTION = "A train leaves for the town where Alice works at 60 km per hour and meets Alice after 3 hours of travel near the old bridge"
AGAIN = "A train leaves for the town where Bob works at 75 miles per hour and meets Bob after 4 days of travel near the old bridge"
MIXED = "A train leaves for the town where Bob works at 75 km per hour and meets Carol after 4 hours of travel near the old bridge"


def noise(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_leaks(spark):
    rng = random.Random(1)
    items = [(i, noise(rng, 30).capitalize() + ".", 0) for i in range(20)] + [(20, QUESTION, 0), (21, "tiny item", 0), (22, "five little words stand here", 0),
                                                                              (None, items_text := noise(rng, 25), 0), (24, None, 0), (25, "", 0)]
    docs = [(i, noise(rng, 80), "k") for i in range(30)]
    docs += [(100, noise(rng, 40) + " " + items[3][1] + " " + noise(rng, 9), "k"), (101, noise(rng, 5) + "\n" + AGAIN, "k"), (102, QUESTION.upper(), "k"),
             (103, items[5][1][:len(items[5][1]) * 2 // 3], "k"), (104, "so five little words, stand HERE now", "k"), (105, items_text, "k"),
             (106, " ".join(items[6][1].split()[:9]) + " " + noise(rng, 60), "k"), (107, "tiny item", "k"), (108, None, None), (109, "", "k"),
             (100, noise(rng, 3) + " " + items[4][1], "k"), (None, items[7][1], "k"), (110, noise(rng, 200_000) + " " + items[8][1], "k")]
    got = {(r.doc_id, r.item_id): r for r in op.decontamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert set(got) == {(100, 3), (101, 20), (102, 20), (103, 5), (104, 22), (105, None), (100, 4), (None, 7), (110, 8)}
    assert got[101, 20].changed and not got[102, 20].changed and got[100, 3].covered == 1.0
    kept = op.without_leaks(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM))
    assert kept.columns == ["doc_id", "text", "key"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [*range(30), 106, 107, 108, 109]))


def test_slots_must_agree(spark):
    items = spark.createDataFrame([(1, QUESTION, 0)], ITEM)
    assert op.decontamination(spark.createDataFrame([(1, AGAIN, "")], DOC), items).count() == 1
    votes = "Mr Jones met Carol at 5 km and Jones met Carol at 5 km while Jones met Carol at 5 km again and again"
    other = "Mr Smith met Dora at 6 km and Brown met Erna at 7 km while White met Fred at 8 km again and again"
    same = "Mr Smith met Dora at 6 km and Smith met Dora at 6 km while Smith met Dora at 6 km again and again"
    df = spark.createDataFrame([(1, other, ""), (2, same, "")], DOC)
    assert [r.doc_id for r in op.decontamination(df, spark.createDataFrame([(1, votes, 0)], ITEM)).collect()] == [2]


def test_each_occurrence_is_judged_by_itself(spark):
    """A worksheet asks a question several times, each with its own values; accidental frames elsewhere don't excuse a copy."""
    rng = random.Random(5)
    once = AGAIN
    more = AGAIN.replace("Bob", "Carl").replace("75", "80").replace("4 days", "6 days")
    half = len(QUESTION.split()) // 2
    gap = [" ".join(x.split()[:half]) + ". " + noise(rng, 60) + " " + " ".join(x.split()[half:]) for x in (once, more)]
    docs = [(1, f"{once}. {noise(rng, 5)}. {more}", ""), (2, ". ".join(once.replace("Bob", x).replace("75", str(i)) for i, x in enumerate(["Ada", "Ben", "Cy", "Di"] * 10)), ""),
            (3, f"{noise(rng, 30)}. {once}. {MIXED}. {MIXED.replace('Bob', 'Dan')}", ""), (4, f"{MIXED}. {MIXED.replace('Bob', 'Dan')}", ""),
            (5, f"{once}. {noise(rng, 5)}. {once}", ""), (6, MIXED, ""), (7, f"{gap[0]}. {gap[1]}", "")]
    items = spark.createDataFrame([(1, QUESTION, 0)], ITEM)
    got = {r.doc_id: r for r in op.decontamination(spark.createDataFrame(docs, DOC), items).collect()}
    assert set(got) == {1, 2, 3, 5, 7}
    assert got[1].covered == got[5].covered and got[1].longest_run == got[5].longest_run and got[1].changed
    kept = op.without_leaks(spark.createDataFrame(docs, DOC), items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 6]


def test_empty(spark):
    d, b = spark.createDataFrame([(1, QUESTION, "")], DOC), spark.createDataFrame([(1, QUESTION, 0)], ITEM)
    none_d, none_b = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert op.decontamination(none_d, b).count() == op.decontamination(d, none_b).count() == 0
    assert op.without_leaks(d, none_b).count() == 1


def test_literal_windows_equal_brute_force(spark):
    """Texts without slots: a leak is half of the item's words, or 13 in a row, in literal windows of eight."""
    rng = random.Random(9)
    items = [(i, noise(rng, rng.randint(8, 40)), 0) for i in range(15)]
    docs = []
    for i in range(150):
        w = rng.choice(items)[1].split()
        a = rng.randint(0, len(w) - 1)
        cut = w[a:a + rng.randint(5, 30)]
        if rng.random() < 0.5:
            cut[rng.randrange(len(cut))] = "changed"
        docs.append((i, noise(rng, 20) + " " + " ".join(cut) + " " + noise(rng, 20), ""))
    want = set()
    for d, text, _ in docs:
        w = re.findall(r"\w+", text)
        have = {tuple(w[k:k + 8]) for k in range(len(w) - 7)}
        for i, item, _ in items:
            x = item.split()
            good = {p for k in range(len(x) - 7) if tuple(x[k:k + 8]) in have for p in range(k, k + 8)}
            run = max((len(s) for s in "".join("x" if k in good else " " for k in range(len(x))).split()), default=0)
            if good and (len(good) >= 0.5 * len(x) or run >= 13):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in op.decontamination(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()}
    assert got == want and want


def test_bitmap_grows_with_the_benchmark(spark, monkeypatch):
    """It only keeps rows from the join: results are the same at any size."""
    assert [op.bits_for(n) for n in (0, 1, 1 << 18, (1 << 18) + 1, 1 << 23, 1 << 24, 1 << 30)] == [22, 22, 22, 23, 27, 28, 28]
    rng = random.Random(3)
    items = spark.createDataFrame([(i, noise(rng, 30), 0) for i in range(10)], ITEM)
    docs = items.selectExpr("100 + item_id as doc_id", "concat('before it ', text) as text", "'' as key").union(
        spark.createDataFrame([(i, noise(rng, 200), "") for i in range(40)], DOC))
    want = sorted(map(tuple, op.decontamination(docs, items).collect()))
    assert len(want) == 10
    for bits in ((15, 15), (16, 28)):
        monkeypatch.setattr(op, "BITS", bits)
        assert sorted(map(tuple, op.decontamination(docs, items).collect())) == want
