"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned and of a written lexicon, how close its words stand to a second-person word,
capitals, punctuation, and how many words are spelled with signs or digits inside (and turn into a lexicon word without them).

The learned lexicon holds words and word beginnings (4 to 8 bytes) that stand in clearly more toxic than other labelled texts. It, the trees
and the calibration are fitted on a bounded sample of labelled rows (``SAMPLE`` rows of the smallest hash of their
id); three quarters of it grow the trees, one quarter calibrates them. Labels, lang, source and ids are
no inputs of a score. Counting and fitting are Spark jobs; whole texts are scanned once, where they are.

Defined results: a null or empty text has all features 0 and gets the model's score for that; repeated rows and null ids stay (a null id
is not held out); repeated labels of an id count once, the highest; of several texts of an id the one of
the smallest hash is learned from; without labels of both classes every score is their mean, or 0;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan

#: labelled rows that models are fitted on, at most
SAMPLE = 20_000
#: learned lexicon entries, at most, and candidates that are counted in other texts
LEXICON = 512
CANDIDATES = 60_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6, 7, 8)
WHOLE = 99
WRITTEN = ("idiot idiots idiotic moron morons stupid dumb loser losers trash garbage scum worthless pathetic disgusting clown fool jerk "
           "hate ugly kill shut crap bastard dummkopf dumm trottel abschaum widerlich idiotin hässlich connard imbécile stupide crétin "
           "salaud ordure dégoûtant idiota estúpido imbécil basura asqueroso tonto cabrón").split()
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes su sus vosotros").split()
LEET = [str.maketrans("013457@$!|", x) for x in ("oieastasii", "oleastasll")]
FEATURES = ["words", "learned", "learned_hits", "learned_kinds", "written", "near_you", "second_person", "capitals", "shouted", "marks", "exclaimed", "odd_spelling", "odd_lexicon", "digits"]
U = np.uint64

INK = np.zeros(256, bool)
INK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SIGN = np.zeros(256, bool)
SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: a word with signs or digits between its letters
ODD = re.compile(r"[^\W\d_](?:[013457@$!|*.\-_]{1,3}[^\W\d_]+)+")


def _terms(c: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the beginnings of k bytes (WHOLE: of whole words), and of which words."""
    n = end - start
    at = np.flatnonzero(n >= (PREFIXES[0] if k == WHOLE else k))
    return scan.mix(scan.span(c, start[at], end[at] if k == WHOLE else start[at] + k) + U(k)), at


def _name(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(_terms(scan.running(raw), np.array([0]), np.array([len(raw)]), WHOLE)[0][0])


def _short(words) -> np.ndarray:
    """Names of whole words of any length."""
    raws = [np.frombuffer(w.encode(), np.uint8) for w in words]
    return np.sort(np.array([scan.span(scan.running(r), np.array([0]), np.array([len(r)]))[0] + U(len(r)) for r in raws], U))


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


class Page:
    """Words of the lower-cased rows of a slab."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        text = raw.tobytes().decode("utf-8", "replace")
        low = text.lower()
        self.buf = np.frombuffer(low.encode(), np.uint8)
        if len(self.buf) != len(raw):  # lower case of other length: row by row
            parts = [raw[a:b].tobytes().decode("utf-8", "replace").lower().encode() for a, b in zip(off[:-1], off[1:], strict=True)]
            self.buf = np.frombuffer(b"".join(parts), np.uint8)
            off = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.off = off
        ink = INK[self.buf]
        first, last = ink.copy(), ink.copy()
        first[1:] &= ~ink[:-1]
        last[:-1] &= ~ink[1:]
        inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(self.buf))]
        first[inner], last[inner - 1] = ink[inner], ink[inner - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(off, self.start, side="right") - 1
        self.c = scan.running(self.buf)


def _pages(col):
    data, off = scan.text_buffer(col)
    for i, j in scan.slabs(off):
        lo, hi = int(off[i]), int(off[j])
        raw = data[lo:hi]
        yield i, j, raw, off[i:j + 1] - lo, Page(raw, off[i:j + 1] - lo)


def _per_row(n: int, row: np.ndarray, weight=None) -> np.ndarray:
    return np.bincount(row, weight, n)[:n] if len(row) else np.zeros(n)


def _sum_of(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask)))
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def features(col: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; ``lexicon``: sorted names of learned entries."""
    written, second = np.sort(np.array([_name(w) for w in WRITTEN if len(w.encode()) >= PREFIXES[0]], U)), _short(SECOND_PERSON)
    out = np.zeros((len(col), len(FEATURES)))
    for i, j, raw, off, page in _pages(col):
        n = j - i
        words = _per_row(n, page.row)
        per = np.maximum(words, 1)
        hit, kinds, seed = np.zeros(len(page.start), bool), np.zeros(n), np.zeros(len(page.start), bool)
        found = []
        for k in (*PREFIXES, WHOLE):
            h, at = _terms(page.c, page.start, page.end, k)
            ok = _in(h, lexicon)
            hit[at[ok]] = True
            found.append(np.stack((page.row[at[ok]].astype(U), h[ok])))
            if k == WHOLE:
                seed[at[_in(h, written)]] = True
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        kinds = _per_row(n, pairs[0].astype(np.int64))
        size = page.end - page.start
        you = _in(scan.span(page.c, page.start, page.end) + size.astype(U), second)
        near = np.zeros(len(hit), bool)
        at = np.flatnonzero(you)
        hits = np.flatnonzero(hit | seed)
        if len(at) and len(hits):
            for side in (np.searchsorted(at, hits) - 1, np.searchsorted(at, hits)):
                q = at[np.clip(side, 0, len(at) - 1)]
                near[hits] |= (np.abs(q - hits) <= 5) & (page.row[q] == page.row[hits])
        caps = CAPITAL[raw]
        length = np.maximum(np.diff(off), 1)
        both = np.zeros(len(raw), bool)
        both[1:] = caps[1:] & caps[:-1]
        odd, odd_lex = _odd_words(raw, off, lexicon, written)
        out[i:j] = np.stack((
            np.log1p(words), _per_row(n, page.row, hit) / per, np.log1p(_per_row(n, page.row, hit)), kinds, _per_row(n, page.row, seed) / per,
            _per_row(n, page.row, near) / np.maximum(_per_row(n, page.row, hit | seed), 1), _per_row(n, page.row, you) / per,
            _sum_of(caps, off) / length, _sum_of(both, off) / length, _sum_of(SIGN[raw], off) / length, _sum_of(raw == 33, off) / length,
            odd / per, odd_lex / per, _sum_of((raw >= 48) & (raw <= 57), off) / length), axis=1)
    return out


def _odd_words(raw: np.ndarray, off: np.ndarray, lexicon: np.ndarray, written: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with signs or digits between letters, and how many are in a lexicon without them; by row."""
    n = len(off) - 1
    odd, lex = np.zeros(n), np.zeros(n)
    letter = ((raw | 32) >= 97) & ((raw | 32) <= 122) | (raw >= 128)
    sign = np.zeros(256, bool)
    sign[[ord(x) for x in "013457@$!|*.-_"]] = True
    mid = sign[raw]
    mid[1:] &= letter[:-1] | sign[raw[:-1]]
    at = np.flatnonzero(mid[:-1] & letter[1:]) if len(raw) > 1 else np.zeros(0, np.int64)
    rows = np.unique(np.searchsorted(off, at, side="right") - 1)
    for r in rows.tolist():
        text = raw[off[r]:off[r + 1]].tobytes().decode("utf-8", "replace").lower()
        for m in ODD.finditer(text):
            odd[r] += 1
            for word in {*(m[0].translate(x) for x in LEET), re.sub(r"[\W\d_]", "", m[0])}:
                word = re.sub(r"[\W_]", "", word).encode()
                if len(word) >= PREFIXES[0]:
                    b = np.frombuffer(word, np.uint8)
                    c, s, e = scan.running(b), np.array([0]), np.array([len(b)])
                    if any(len(x := _terms(c, s, e, k)[0]) and (_in(x, lexicon)[0] or (k == WHOLE and _in(x, written)[0])) for k in (*PREFIXES, WHOLE)):
                        lex[r] += 1
                        break
    return odd, lex


def _term_rows(only: np.ndarray | None):
    """(label, term) of each text once; ``only``: sorted names to keep."""
    def run(batches):
        for b in batches:
            label = b.column("label").to_numpy(zero_copy_only=False)
            for i, j, _, _, page in _pages(b.column("text")):
                rows, names = [], []
                for k in (*PREFIXES, WHOLE):
                    h, at = _terms(page.c, page.start, page.end, k)
                    if only is not None:
                        ok = _in(h, only)
                        h, at = h[ok], at[ok]
                    rows.append(page.row[at]), names.append(h)
                pairs = np.unique(np.stack((np.concatenate(rows).astype(U), np.concatenate(names))), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(label[i + pairs[0].astype(np.int64)].astype(np.int64)), pa.array(scan.signed(pairs[1]))],
                                                 names=["label", "term"])
    return run


def _featured(lexicon: np.ndarray):
    def run(batches):
        for b in batches:
            x = features(b.column("text"), lexicon)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("key"), flat], names=["key", "x"])
    return run


def learn_lexicon(sample: DataFrame, limit: int = LEXICON) -> np.ndarray:
    """Sorted names of words and beginnings that mark toxic texts of ``sample`` (label, text)."""
    sizes = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return np.zeros(0, U)
    least = max(3, toxic // 400)
    found = (sample.where("label = 1").mapInArrow(_term_rows(None), "label long, term long").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(CANDIDATES).collect())
    names = np.sort(np.array([r.term for r in found], np.int64).view(U))
    if not len(names):
        return names
    seen = {r.term: r.n for r in sample.where("label = 0").mapInArrow(_term_rows(names), "label long, term long")
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = sorted(((r.n, r.term) for r in found if r.n / toxic >= 20 * (seen.get(r.term, 0) + 0.5) / other), reverse=True)[:limit]
    return np.sort(np.array([t for _, t in odds], np.int64).view(U))


class ToxicityModel:
    """Lexicon, trees and calibration; :meth:`score` adds a score to any table with a text column."""

    def __init__(self, lexicon: np.ndarray, trees, scale, mean: float):
        self.lexicon, self.trees, self.scale, self.mean = lexicon, trees, scale, mean

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, seed: int = 10) -> ToxicityModel:
        """``docs`` (doc_id, text); ``labels`` (doc_id, toxic) of training rows alone."""
        spark = docs.sparkSession
        kit.small_batches(spark)
        chosen = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
                  .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows))
        chosen = kit.write(spark, chosen.withColumnRenamed("doc_id", "key"), "labels")
        texts = docs.select(F.col("doc_id").alias("key"), kit.text_of().alias("text")).join(F.broadcast(chosen), "key")
        sample = kit.write(spark, texts.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "sample")
        mean, least = sample.agg(F.avg("label"), F.min("label")).first()
        if mean is None or mean in (0.0, 1.0):
            return cls(np.zeros(0, U), None, None, float(mean or 0.0))
        grow = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(4)) > 0
        lexicon = learn_lexicon(sample.where(grow))
        data = sample.mapInArrow(_featured(lexicon), _key_type(sample) + ", x array<double>").join(F.broadcast(chosen), "key")
        data = kit.write(spark, data.select("key", "x", F.col("label").cast("double").alias("label")), "features")
        data = data.withColumn("features", array_to_vector("x"))
        part = {r[0] for r in data.where(grow).select("label").distinct().collect()}
        if len(part) < 2:
            return cls(lexicon, None, None, float(mean))
        train = data.where(grow).select("features", "label").repartition(6).cache()
        trees = GBTClassifier(maxIter=24, maxDepth=3, stepSize=0.25, maxBins=32, subsamplingRate=1.0, seed=seed, cacheNodeIds=False).fit(train)
        train.unpersist()
        held = trees.transform(data.where(~grow)).select(vector_to_array("rawPrediction")[1].alias("margin"), "label")
        if held.count() >= 50:
            scale = IsotonicRegression(featuresCol="margins", labelCol="label").fit(
                VectorAssembler(inputCols=["margin"], outputCol="margins").transform(held))
        else:
            scale = None
        return cls(lexicon, trees, scale, float(mean))

    def score(self, rows: DataFrame) -> DataFrame:
        """(key, score) of ``rows`` (key, text)."""
        kit.small_batches(rows.sparkSession)
        if self.trees is None:
            return rows.select("key", F.lit(self.mean).alias("score"))
        out = rows.mapInArrow(_featured(self.lexicon), _key_type(rows) + ", x array<double>").withColumn("features", array_to_vector("x"))
        out = self.trees.transform(out).withColumn("margin", vector_to_array("rawPrediction")[1])
        smooth = 1 / (1 + F.exp(-2 * F.col("margin")))
        if self.scale is None:
            return out.select("key", smooth.alias("score"))
        out = self.scale.setPredictionCol("level").transform(VectorAssembler(inputCols=["margin"], outputCol="margins").transform(out))
        # the calibrated step, and within a step the order of the margins
        return out.select("key", F.least(F.greatest(0.998 * F.col("level") + 0.002 * smooth, F.lit(0.0)), F.lit(1.0)).alias("score"))


def _key_type(df: DataFrame) -> str:
    return f"key {df.schema['key'].dataType.simpleString()}"


def is_held_out(col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    return ToxicityModel.fit(docs, labels.select("doc_id", "toxic").where(~is_held_out()))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted."""
    model = fit_on(docs, labels)
    scored = model.score(docs.select(F.struct("doc_id", is_held_out().alias("held_out")).alias("key"), kit.text_of().alias("text")))
    return scored.select("key.doc_id", "key.held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that are predicted toxic."""
    model = fit_on(docs, labels)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("key"), kit.text_of().alias("text"))
    return model.score(rows).where(F.col("score") < threshold).select("key.*")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "labels"))
