"""URL filter: rules first, then the ratio of two character language models; DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's; the longest rule wins. Urls that
rules allow or block teach two smoothed variable-order Markov models (contexts of 0 to ``ORDER`` characters,
Witten-Bell interpolation: a context counts as much as it was seen against the number of different characters after it, an unseen
one leaves all to the shorter one). A url without a rule is allowed if the difference of its log-likelihoods, divided by its length, is at
least a threshold, calibrated on a quarter of the labelled urls that no model was trained on (largest sum of both rates of right verdicts).

Each different spelling is counted and scored once, with its number of rows. Characters are mapped to an alphabet of 40, so the table of
weights has at most 40**4 rows; it is broadcast if it has no more than ``BROADCAST_ROWS``, and joined by hash beyond.

Defined results: null or no ``://``: host and path empty, no rule; a url without a character has score 0 and is allowed unless
the threshold is above 0; with urls of one class only, or none, every score and the threshold are 0; repeated rows and null ids stay; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit

#: (host, path, verdict)
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 3
ALPHABET = 40
BROADCAST_ROWS = 200_000
CLASSES = ("allow", "block")


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the last wrapped is the longest
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def spelling(url: Column) -> Column:
    """The url in the alphabet of the models: a-z, 0 for digits, ten signs, ~ for everything else."""
    return F.regexp_replace(F.regexp_replace(_lower(F.coalesce(url, F.lit(""))), r"[0-9]", "0"), r"[^a-z0./:?=&_#%\-]", "~")


def is_spare() -> Column:
    """The quarter of the spellings that calibrates and is not trained on."""
    return F.substring(F.md5("spelled"), 1, 1).isin(*"0123")


def _grams(text: str = "spelled") -> Column:
    """Each character with the ORDER characters before it; ^ fills up at the start, $ is the end."""
    padded = F.concat(F.lit("^" * ORDER), F.col(text), F.lit("$"))
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(padded) - ORDER),
                                                  lambda i: F.substring(padded, i, F.lit(ORDER + 1)))).otherwise(F.array().cast("array<string>"))


def gram_weights(grams: DataFrame) -> DataFrame:
    """(gram, weight): log P(last character | those before it) under allow minus the same under block.
    ``grams``: gram, allow, block (counts), a row for each gram that will be asked for."""
    out = grams
    steps = []
    for k in range(ORDER + 1):
        seq = F.substring("gram", ORDER - k + 1, k + 1)
        by_seq = grams.groupBy(seq.alias("seq")).agg(*(F.sum(c).alias(f"{c}_n") for c in CLASSES))
        by_ctx = by_seq.groupBy(F.substring("seq", 1, k).alias("ctx")).agg(
            *(F.sum(f"{c}_n").alias(f"{c}_all") for c in CLASSES), *(F.sum((F.col(f"{c}_n") > 0).cast("long")).alias(f"{c}_kinds") for c in CLASSES))
        step = (by_seq.withColumn("ctx", F.substring("seq", 1, k)).join(by_ctx, "ctx")
                .select(F.col("seq").alias(f"seq{k}"), *(F.struct(f"{c}_n", f"{c}_all", f"{c}_kinds").alias(f"{c}{k}") for c in CLASSES)))
        steps.append((seq, step))
    for k, (seq, step) in enumerate(steps):
        out = out.withColumn(f"seq{k}", seq).join(step, f"seq{k}")

    def likelihood(c: str) -> Column:
        p = F.lit(1.0 / ALPHABET)
        for k in range(ORDER + 1):
            n, total, kinds = (F.col(f"{c}{k}.{c}_{x}") for x in ("n", "all", "kinds"))
            p = F.when(total > 0, (n + kinds * p) / (total + kinds)).otherwise(p)
        return p
    return out.select("gram", (F.log(likelihood("allow")) - F.log(likelihood("block"))).alias("weight"))


def scores(urls: DataFrame) -> DataFrame:
    """(spelled, score) of ``urls`` (spelled, verdict, n): different spellings with their verdict by rule (null: none) and rows."""
    spark = urls.sparkSession
    train = F.col("verdict").isNotNull() & ~is_spare()
    counted = urls.select(F.explode(_grams()).alias("gram"), *(F.when(train & (F.col("verdict") == c), F.col("n")).otherwise(0).alias(c) for c in CLASSES))
    grams = kit.write(spark, counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in CLASSES)), "grams")
    rows, allow, block = grams.agg(F.count(F.lit(1)), F.sum("allow"), F.sum("block")).first()
    if not allow or not block:
        return urls.select("spelled", F.lit(0.0).alias("score")).distinct()
    weights = kit.write(spark, gram_weights(grams), "weights")
    weights = F.broadcast(weights) if rows <= BROADCAST_ROWS else weights
    each = urls.select("spelled").distinct().select("spelled", F.explode_outer(_grams()).alias("gram"))
    return (each.join(weights, "gram", "left").groupBy("spelled")
            .agg((F.coalesce(F.sum("weight"), F.lit(0.0)) / F.greatest(F.count("gram"), F.lit(1))).alias("score")))


def calibrated(scored: DataFrame) -> Column:
    """The threshold with the largest sum of both rates on ``scored`` (score, verdict, n), over steps of 0.01, half way
    to the step below; a row a step, so the
    running sums are over a bounded list."""
    step = F.least(F.greatest(F.round(F.col("score") * 100), F.lit(-2000)), F.lit(2000))
    hist = scored.groupBy(step.alias("step")).agg(*(F.sum(F.when(F.col("verdict") == c, F.col("n")).otherwise(0)).alias(c) for c in CLASSES)).collect()
    allow, block = sum(r.allow for r in hist), sum(r.block for r in hist)
    if not allow or not block:
        return F.lit(0.0)
    best, at, below_a, below_b, last = -1.0, 0.0, 0, 0, None
    for r in sorted(hist):
        rate = (allow - below_a) / allow + below_b / block
        if rate > best + 1e-12:
            best, at = rate, (r.step - 0.5 if last is None else (last + r.step) / 2) / 100
        below_a, below_b, last = below_a + r.allow, below_b + r.block, r.step
    return F.lit(float(at))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, score."""
    spark = pages.sparkSession
    url = F.col("url").cast("string")
    host, path = host_and_path(url)
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), spelling(url).alias("spelled"))
    name, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "ruled": verdict})
    urls = kit.write(spark, rows.groupBy("spelled", F.col("ruled").alias("verdict")).agg(F.count(F.lit(1)).alias("n")), "urls")
    scored = kit.write(spark, scores(urls), "scores")
    held = urls.where("verdict is not null").where(is_spare())
    threshold = calibrated(held.join(scored, "spelled"))
    return (rows.join(scored, "spelled", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(kit.table(spark, sf_dir, "pages")).drop("score")
