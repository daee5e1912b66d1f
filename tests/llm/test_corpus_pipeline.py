"""The pipeline's stages, each on what the one before kept, against brute-force versions; registration of the queries."""

import random

import corpus_pipeline
from test_op05 import brute as classes

import __spark_entry__ as E
from tillroll.llm import op04_best_fit_packing as op4

RUDE = ["blorgface", "snarfling"]
NAMES = ["op1_suffix_dedup", "op2_html_extraction", "op3_url_filter", "op4_best_fit_packing", "op5_jaccard_join", "op6_fingerprints",
         "op7_quality_cotraining", "op8_packed_matrices", "op9_decontamination", "op10_toxicity", "op11_whitening", "op12_simhash", "op13_collocations"]


def test_registered():
    q = E.queries()
    assert all(n in q for n in [*NAMES, "pipeline"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeated_passages", "decontamination", "packing"]


def cut(texts, length=corpus_pipeline.PASSAGE):
    """Texts without the bytes that a string covers which starts at two places."""
    seen = {}
    for r, t in enumerate(texts):
        b = t.encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], []).append((r, s))
    gone = [bytearray(len(t.encode())) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for r, s in places:
                gone[r][s:s + length] = b"\1" * length
    return [bytes(x for x, g in zip(t.encode(), m, strict=True) if not g).decode("utf-8", "ignore") for t, m in zip(texts, gone, strict=True)]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    docs, labels = [], []
    for i in range(500):
        w, toxic = words(rng.randint(20, 120)), rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(RUDE))
        docs.append([i, " ".join(w), "en", "s", 0])
        labels.append((i, 1, int(toxic)))
    clean = [d for d, (_, _, t) in zip(docs, labels, strict=True) if not t]
    passage, item = " ".join(words(51)), " ".join(words(30))
    for d in clean[:6]:
        d[1] += " " + passage
    for d in clean[6:9]:
        d[1] += " " + item
    for k, d in enumerate(clean[9:15]):
        docs.append([1000 + k, d[1] + " end", "en", "s", 0])
    docs += [[2000, None, None, None, None], [2001, "", "en", "s", 0], [clean[9][0], clean[9][1], "en", "s", 0]]
    for d in docs:
        d[4] = None if d[1] is None else len(d[1])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(d) for d in docs], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, " ".join(words(25)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    table, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, table, str(tmp_path))
        if k < 4:
            assert out.columns == table.columns
        out.write.parquet(str(tmp_path / name))
        table = spark.read.parquet(str(tmp_path / name))
        kept[name] = sorted(map(tuple, table.collect()), key=repr)

    bad = {i for i, _, t in labels if t}
    assert {r[0] for r in kept["toxicity"]} == {d[0] for d in docs} - bad
    low = {(i, n, c) for i, n, c in classes([r[:2] for r in kept["toxicity"]])}
    assert sorted(r[0] for r in kept["near_copies"]) == sorted({c for _, n, c in low if n} | {i for i, n, _ in low if not n})
    before = kept["near_copies"]
    want = dict(zip([r[0] for r in before], cut([r[1] or "" for r in before]), strict=True))
    assert {r[0]: r[1] or "" for r in kept["repeated_passages"]} == want
    assert all(r[4] == (None if r[1] is None else len(r[1])) for r in kept["repeated_passages"])
    leak = {r[0] for r in kept["repeated_passages"] if item in (r[1] or "")}
    assert leak == {d[0] for d in clean[6:9]}
    assert kept["decontamination"] == [r for r in kept["repeated_passages"] if r[0] not in leak]
    rows = kept["packing"]
    assert {r[0] for r in rows} == {r[0] for r in kept["decontamination"]}
    fill = {}
    for r in rows:
        fill[r[5]] = fill.get(r[5], 0) + r[3]
    assert max(fill.values()) <= 2048 and len(fill) == op4.pack_runs({n: [r[3] for r in rows].count(n) for n in {r[3] for r in rows}}, 2048)[1]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(rows)
