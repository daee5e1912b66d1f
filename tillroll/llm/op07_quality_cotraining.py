"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

The text view sees measures of the words (lengths, repetition, capitals, signs, digits, function words, lines), the metadata
view sees language, source and length. Both start from the same labelled rows. In each round either forest scores all unlabelled rows
and hands all that it is sure of, as pseudo-labels weighted to the proportion of the classes, to the other. At the end both are calibrated
(isotonic) on labelled rows that neither was trained on, and a logistic model of the two calibrated log-odds scores all documents.

Labels come from a bounded sample: ``SAMPLE`` labelled rows, those of the smallest hash of their id; unlabelled rows are not
bounded. All that a view hands over in a round weighs at most ``HANDED`` of the labelled rows. Whole texts are measured where they are. Rows whose crc32(doc_id as text) mod 4 is 2 are never learned from.

Defined results: a null or empty text has all measures 0; a null language or source is a value of its own; repeated labels of an id count once (the lowest); of several labelled
rows of an id the one of the smallest text hash is learned from, unlabelled rows are all searched, repeated and null ids too;
repeated rows and null ids stay; without labels of both classes every score is their mean, or 0.5;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan
from tillroll.llm.op10_toxicity import is_held_out

SAMPLE = 20_000
ROUNDS = 2
#: weight of all pseudo-labels that a view hands over in a round, as part of the labelled rows, and how sure it must be of them
HANDED = 0.25
SURE = 0.9
KEEP = 0.5
#: values of language and source that get a column each: the most frequent ones; if there are more, they share columns, by HASHES hashes
VALUES = 40
BUCKETS, HASHES = 16, 2
MEASURES = ["words", "chars_per_word", "long_words", "different", "most_repeated", "lines", "repeated_lines", "short_lines", "capitals", "signs", "digits", "stops", "bars",
            "non_ascii", "sentence_words", "spaces", "doubled", "odd_controls"]


def measures(col: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text."""
    data, off = scan.text_buffer(col)
    out = np.zeros((len(col), len(MEASURES)))
    for i, j in scan.slabs(off):
        lo, hi = int(off[i]), int(off[j])
        raw, edge = data[lo:hi], off[i:j + 1] - lo
        w, first = scan.row_words(data, off, i, j)
        size = np.maximum(np.diff(edge), 1)

        def rate(mask, edge=edge, size=size):
            c = np.concatenate(([0], np.cumsum(mask)))
            return (c[edge[1:]] - c[edge[:-1]]) / size
        flat = [rate((raw >= 65) & (raw <= 90)), rate((raw >= 33) & (raw <= 47) | (raw >= 58) & (raw <= 64) | (raw >= 91) & (raw <= 96) | (raw >= 123) & (raw <= 126)),
                rate((raw >= 48) & (raw <= 57)), rate((raw == 46) | (raw == 33) | (raw == 63)), rate((raw == 124) | (raw == 60) | (raw == 123)), rate(raw >= 128),
                rate(scan.SPACE[raw]), rate(raw < 9)]
        for r in range(j - i):
            x = w[first[r]:first[r + 1]]
            n = len(x)
            if not n:
                continue
            names, count = np.unique(x, return_counts=True)
            body = raw[edge[r]:edge[r + 1]].tobytes()
            lines = [s for s in body.split(b"\n") if s.strip()]
            letters = size[r] * (1 - flat[6][r])
            out[i + r] = (np.log1p(n), letters / n, np.mean(x[1:] == x[:-1]) if n > 1 else 0, len(names) / n, count.max() / n, np.log1p(len(lines)),
                          1 - len(set(lines)) / max(len(lines), 1), sum(len(s) < 30 for s in lines) / max(len(lines), 1), flat[0][r], flat[1][r], flat[2][r], flat[3][r],
                          flat[4][r], flat[5][r], n / max(1.0, flat[3][r] * size[r]), flat[6][r], np.log(n / max(len(names), 1)), flat[7][r])
    return out


def _measured():
    def run(batches):
        for b in batches:
            x = measures(b.column("text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), flat], names=[*(c for c in b.schema.names if c != "text"), "a"])
    return run


def measured(rows: DataFrame) -> DataFrame:
    """``rows`` with the text replaced by its measures (a)."""
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(_measured(), ", ".join([*rest, "a array<double>"]))


class CoTraining:
    """Two forests, their calibrations and the model that combines them."""

    def __init__(self, mean: float, langs=(), sources=(), views=None, scales=None, top=None):
        self.mean, self.langs, self.sources, self.views, self.scales, self.top = mean, list(langs), list(sources), views, scales, top
        self.handed: dict[str, tuple[int, int]] = {}  # pseudo-labels that each view was handed, by class

    def features(self, rows: DataFrame) -> DataFrame:
        """Vectors of both views (va, vb) from the measures and lang, source."""
        def one_hot(c: str, values: list) -> list[Column]:
            out = [F.col(c).eqNullSafe(F.lit(v)).cast("double") for v in values[:VALUES]]
            if len(values) > VALUES:
                own = F.coalesce(F.col(c).isin([v for v in values[:VALUES] if v is not None]), F.lit(None in values[:VALUES]))
                for k in range(HASHES):
                    bucket = F.pmod(F.xxhash64(F.lit(k), F.col(c)), F.lit(BUCKETS))
                    out += [(~own & (bucket == b)).cast("double") for b in range(BUCKETS)]
            return out
        meta = [*one_hot("lang", self.langs), *one_hot("source", self.sources), F.element_at("a", 1), F.pow(F.element_at("a", 1), 2)]
        return rows.withColumns({"va": array_to_vector("a"), "vb": array_to_vector(F.array(*meta))})

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, rounds: int = ROUNDS, seed: int = 7) -> CoTraining:
        """``docs`` (doc_id, text, lang, source); ``labels`` (doc_id, quality) of training rows."""
        spark = docs.sparkSession
        kit.small_batches(spark)
        order = F.xxhash64(F.lit(seed), "key")
        known = (labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("key")).agg(F.min("quality").cast("double").alias("label")))
        known = kit.write(spark, known.orderBy(order, "key").limit(rows), "labels")
        columns = [F.col("doc_id").alias("key"), "lang", "source", kit.text_hash().alias("t"), kit.text_of().alias("text")]
        some = docs.select(*columns).join(F.broadcast(known), "key", "left").where(F.col("label").isNotNull() | ~is_held_out("key"))
        data = kit.write(spark, measured(some), "sample")
        one = data.where("label is not null").groupBy("key", "label").agg(F.min(F.struct("t", "lang", "source", "a")).alias("r"))
        one = kit.write(spark, one.select("key", "label", "r.lang", "r.source", "r.a"), "labelled")
        stats = one.agg(F.avg("label"), F.countDistinct("label")).first()
        if stats[1] < 2:
            return cls(0.5 if stats[0] is None else float(stats[0]))
        top = {c: [r[0] for r in data.groupBy(c).count().orderBy(F.desc("count"), c).limit(VALUES + 1).collect()] for c in ("lang", "source")}
        model = cls(float(stats[0]), top["lang"], top["source"])
        one = one.withColumn("spare", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(4)) == 0)
        labelled = model.features(one).select("label", "spare", "va", "vb").cache()
        train, spare = labelled.where("not spare"), labelled.where("spare")
        none = F.lit(None).cast("double")
        pool = data.where("label is null").select("a", "lang", "source", none.alias("given_va"), none.alias("given_vb"))  # all unlabelled rows
        written = None
        weights: dict[str, Column] = {}
        try:
            n_train = train.count()
            for turn in range(rounds + 1):
                views = {}
                for v in ("va", "vb"):
                    rows_v = train.select(v, "label", F.lit(1.0).alias("weight"))
                    if v in weights:
                        given = model.features(pool.where(f"given_{v} is not null"))
                        rows_v = rows_v.union(given.select(v, F.col(f"given_{v}"), weights[v]))
                    forest = RandomForestClassifier(featuresCol=v, labelCol="label", weightCol="weight", numTrees=24, maxDepth=6, seed=seed + turn, subsamplingRate=0.8)
                    views[v] = forest.fit(rows_v).setRawPredictionCol(f"raw_{v}").setProbabilityCol(f"p_{v}").setPredictionCol(f"c_{v}")
                if turn < rounds:
                    sure = model.features(pool)
                    for v in ("va", "vb"):
                        sure = views[v].transform(sure).withColumn(f"s_{v}", vector_to_array(f"p_{v}")[1])
                    for v, w in (("va", "vb"), ("vb", "va")):
                        new = F.when(F.col(f"s_{v}") >= SURE, 1.0).when(F.col(f"s_{v}") <= 1 - SURE, 0.0)
                        sure = sure.withColumn(f"given_{w}", F.coalesce(f"given_{w}", new))
                    last, written = written, kit.write(spark, sure.select(*pool.columns), "handed")
                    pool = written
                    if last is not None:
                        kit.discard(last)
                    n = pool.agg(*(F.count(F.when(F.col(f"given_{v}") == y, 1)) for v in ("va", "vb") for y in (1, 0))).first()
                    mass = HANDED * n_train * (turn + 1)
                    for v, good, bad in (("va", n[0], n[1]), ("vb", n[2], n[3])):
                        model.handed[v] = good, bad
                        share = min(1.0, mass * model.mean / max(good, 1)), min(1.0, mass * (1 - model.mean) / max(bad, 1))
                        weights[v] = F.when(F.col(f"given_{v}") == 1, share[0]).otherwise(share[1]).alias("weight")
            model.views = views
            held = model.raw(spare).select("label", "ma", "mb")
            held = kit.write(spark, held, "held")
            model.scales = {}
            if held.groupBy("label").count().count() == 2:
                for m in ("ma", "mb"):
                    model.scales[m] = IsotonicRegression(featuresCol=m, labelCol="label", predictionCol=f"q_{m}").fit(held)
                both = model.calibrated(held)
                model.top = LogisticRegression(featuresCol="both", labelCol="label", maxIter=30, regParam=0.01).fit(both)
        finally:
            labelled.unpersist()
        return model

    def raw(self, rows: DataFrame) -> DataFrame:
        for v in ("va", "vb"):
            rows = self.views[v].transform(rows)
        return rows.withColumns({"ma": vector_to_array("p_va")[1], "mb": vector_to_array("p_vb")[1]})

    def calibrated(self, rows: DataFrame) -> DataFrame:
        def odds(m: str) -> Column:
            p = 0.9 * F.col(f"q_{m}") + 0.1 * F.col(m)  # the calibrated step, ordered within by the view itself
            p = F.least(F.greatest(p, F.lit(0.005)), F.lit(0.995))
            return F.log(p / (1 - p))
        for m in ("ma", "mb"):
            rows = self.scales[m].transform(rows)
        return rows.withColumn("both", array_to_vector(F.array(odds("ma"), odds("mb"))))

    def score(self, rows: DataFrame) -> DataFrame:
        """(key, score) of ``rows`` (key, text, lang, source)."""
        kit.small_batches(rows.sparkSession)
        if self.views is None:
            return rows.select("key", F.lit(self.mean).alias("score"))
        out = self.raw(self.features(measured(rows)))
        if self.top is None:
            return out.select("key", ((F.col("ma") + F.col("mb")) / 2).alias("score"))
        out = self.top.setRawPredictionCol("raw_top").setProbabilityCol("p_top").setPredictionCol("c_top").transform(self.calibrated(out))
        return out.select("key", vector_to_array("p_top")[1].alias("score"))


def quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, held_out, score (1: good), keep."""
    model = CoTraining.fit(docs, labels.select("doc_id", "quality").where(~is_held_out()))
    rows = docs.select(F.struct("doc_id", is_held_out().alias("held_out")).alias("key"), "lang", "source", kit.text_of().alias("text"))
    return model.score(rows).select("key.doc_id", "key.held_out", "score", (F.col("score") >= keep).alias("keep"))


def op7_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "labels"))
