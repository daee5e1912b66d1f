"""Registered queries: RFM, segmentation, churn."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, SEGMENT_LABELS
from tillroll.functions.numeric import money_sum_sql
from tillroll.operators import churn as CH
from tillroll.operators import customers as CU
from tillroll.operators import segments as SG
from tillroll.operators import silhouette as SI
from tillroll.operators import stats as ST
from tillroll.operators.features import snapshot_row
from tillroll.plans.models import churn_model, segmentation
from tillroll.plans.oracle import with_chain
from tillroll.plans.registry import cmp_round, query, rounded
from tillroll.plans.stages import customer_frame, featured_frame
from tillroll.session import scratch_path
from tillroll.sources import io

MS = money_sum_sql("TotalPrice")
D = "CAST({} AS DOUBLE)".format
INACT = DEFAULT.churn_inactivity_days


def _f(spark, sf):
    return featured_frame(spark, sf)


def _rfm(spark, sf):
    return customer_frame(spark, sf, "rfm", CU.rfm)


def _labels(spark, sf):
    return customer_frame(spark, sf, "labels", CH.churn_labels)


def _training(spark, sf):
    return customer_frame(spark, sf, "training", CH.training_set)


def _split(spark, sf):
    return customer_frame(spark, sf, "split", lambda f: CH.stratified_split(_training(spark, sf)))


# --- RFM and segments -----------------------------------------------------------

RFM_SQL = f"""rfm AS (
 SELECT CustomerID, date_sub('day', max(InvoiceDate), snapshot) AS Recency, count(DISTINCT Invoice) AS Frequency,
        {MS} AS Monetary
 FROM featured CROSS JOIN snap GROUP BY CustomerID, snapshot HAVING {MS} > 0)"""


@query("rfm", with_chain("featured", "SELECT * FROM rfm", extra=RFM_SQL))
def q_rfm(spark, sf):
    return _rfm(spark, sf)


@query("rfm_scaled", with_chain("featured", """
SELECT CustomerID, round((r - avg(r) OVER ()) / stddev_pop(r) OVER (), 6) AS R_z,
       round((f - avg(f) OVER ()) / stddev_pop(f) OVER (), 6) AS F_z,
       round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS M_z
FROM (SELECT CustomerID, CAST(Recency AS DOUBLE) AS r, ln(1 + Frequency) AS f, ln(1 + Monetary) AS m FROM rfm)""",
                                extra=RFM_SQL))
def q_rfm_scaled(spark, sf):
    s = SG.rfm_scaled(_rfm(spark, sf))
    return rounded(s.select("CustomerID", "R_z", "F_z", "M_z"), ratio=("R_z", "F_z", "M_z"))


@query("segments")
def q_segments(spark, sf):
    """KMeans segments (rows-only: cluster ids depend on the initialisation)."""
    return segmentation(spark, sf)[0]


@query("silhouette")
def q_silhouette(spark, sf):
    segs, sil, _ = segmentation(spark, sf)
    return segs.agg(F.count(F.lit(1)).alias("customers")).withColumns(
        {"k": F.lit(DEFAULT.clusters), "silhouette_sq_euclidean": F.lit(sil).cast("double")})


@query("segment_labels")
def q_segment_labels(spark, sf):
    segs = segmentation(spark, sf)[0]
    return SG.segment_labels(segs)


@query("segment_summary")
def q_segment_summary(spark, sf):
    return SG.segment_summary(segmentation(spark, sf)[0])


# given centres in the space of R_z, F_z, M_z
CENTERS = ((-0.6, 1.1, 1.0), (-0.3, 0.2, 0.1), (0.2, -0.9, -0.6), (1.6, -0.8, -1.1))
_SLOTS = (0, 2, 4, 6)  # four clusters take every second label of the pool


def _near_sql() -> str:
    dist = ", ".join("(r - {0}) * (r - {0}) + (f - {1}) * (f - {1}) + (m - {2}) * (m - {2})".format(*(D(f"'{v}'") for v in c)) for c in CENTERS)
    return f"list_position([{dist}], list_min([{dist}])) - 1"


def _mean_rank_sql(col: str, order: str) -> str:
    return f"rank() OVER (ORDER BY {col} {order}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0"


_LABEL = " ".join(f"WHEN {i} THEN '{SEGMENT_LABELS[slot]}'" for i, slot in enumerate(_SLOTS))


@query("segments_applied", with_chain("featured", "SELECT * FROM near JOIN named USING (Cluster)", extra=RFM_SQL + f""",
logs AS (SELECT CustomerID, CAST(Recency AS DOUBLE) AS r, ln(1 + Frequency) AS f, ln(1 + Monetary) AS m FROM rfm),
near AS (SELECT CustomerID, {_near_sql()} AS Cluster
 FROM (SELECT CustomerID, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS r, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS f,
              (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS m FROM logs)),
means AS (SELECT Cluster, avg(Recency) AS r, avg(Frequency) AS f, avg(Monetary) AS m FROM near JOIN rfm USING (CustomerID) GROUP BY 1),
score AS (SELECT Cluster, ({_mean_rank_sql("r", "ASC")} + {_mean_rank_sql("f", "DESC")} + {_mean_rank_sql("m", "DESC")}) / 3.0 AS s FROM means),
named AS (SELECT Cluster, CASE row_number() OVER (ORDER BY s, Cluster) - 1 {_LABEL} END AS Segment FROM score)"""))
def q_segments_applied(spark, sf):
    """A segmentation with given centres: scaler and labels taken from the customers, saved, loaded again and applied."""
    path = scratch_path(spark, "models", f"segmenter-{uuid.uuid4().hex[:12]}")
    io.save_model(SG.segmenter(_rfm(spark, sf), CENTERS), path)
    return io.load_model(PipelineModel, path).transform(_rfm(spark, sf)).select("CustomerID", "Cluster", "Segment")


@query("silhouette_euclidean", with_chain("featured", """
SELECT Cluster, count(*) AS Customers, round(avg(s), 6) AS Silhouette, round(min(s), 6) AS Lowest
FROM (SELECT id, Cluster, CASE WHEN size = 1 THEN 0 ELSE coalesce((b - i) / nullif(greatest(b, i), 0), 0) END AS s
      FROM (SELECT id, Cluster, max(CASE WHEN o = Cluster THEN n END) AS size, max(CASE WHEN o = Cluster THEN d / nullif(n - 1, 0) END) AS i,
                   min(CASE WHEN o <> Cluster THEN d / n END) AS b FROM far GROUP BY id, Cluster)) GROUP BY Cluster""", extra=RFM_SQL + f""",
logs AS (SELECT CustomerID, CAST(Recency AS DOUBLE) AS r, ln(1 + Frequency) AS f, ln(1 + Monetary) AS m FROM rfm),
z AS (SELECT CustomerID AS id, (r - avg(r) OVER ()) / stddev_pop(r) OVER () AS r, (f - avg(f) OVER ()) / stddev_pop(f) OVER () AS f,
             (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS m FROM logs),
near AS (SELECT *, {_near_sql()} AS Cluster FROM z),
far AS (SELECT x.id, x.Cluster, y.Cluster AS o, count(*) AS n, sum(sqrt((x.r - y.r) ** 2 + (x.f - y.f) ** 2 + (x.m - y.m) ** 2)) AS d
        FROM near x CROSS JOIN near y GROUP BY ALL)"""))
def q_silhouette_euclidean(spark, sf):
    """Euclidean silhouette of every customer among all, by cluster, for clusters with given centres."""
    rfm = _rfm(spark, sf)
    scored = PipelineModel([SG.scaling_stage(rfm), SG.nearest_stage(CENTERS)]).transform(rfm)
    return rounded(SI.silhouette_by_cluster(SI.silhouette_widths(scored)), ratio=("Silhouette", "Lowest"))


QSEG_SQL = RFM_SQL + """,
qq AS (SELECT quantile_cont(Monetary, 0.25) AS q1, quantile_cont(Monetary, 0.5) AS q2,
              quantile_cont(Monetary, 0.75) AS q3 FROM rfm),
qseg AS (SELECT rfm.*, CASE WHEN Monetary <= q1 THEN 'Lost' WHEN Monetary <= q2 THEN 'At Risk'
                            WHEN Monetary <= q3 THEN 'Potential Loyalists' ELSE 'Champions' END AS Segment
         FROM rfm CROSS JOIN qq)"""
SEG_MS = money_sum_sql("Monetary")


@query("segment_summary_quartiles", with_chain("featured", f"""
SELECT Segment, count(*) AS Customers, sum(Recency) / count(*) AS AvgRecencyDays,
       sum(Frequency) / count(*) AS AvgFrequency, {SEG_MS} / count(*) AS AvgMonetary, {SEG_MS} AS TotalMonetary,
       {D('100.0')} * count(*) / (SELECT count(*) FROM qseg) AS PctOfCustomers,
       {D('100.0')} * {SEG_MS} / (SELECT {SEG_MS} FROM qseg) AS PctOfRevenue
FROM qseg GROUP BY Segment""", extra=QSEG_SQL))
def q_segment_summary_quartiles(spark, sf):
    return SG.segment_summary(SG.quartile_segments(_rfm(spark, sf)))


# --- churn ------------------------------------------------------------------------

CF_SQL = f"""s1 AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS s FROM featured),
cf AS (
 SELECT CustomerID, date_sub('day', max(InvoiceDate), s) AS Recency, count(DISTINCT Invoice) AS Frequency,
        {MS} AS Monetary, coalesce({MS} / nullif(count(DISTINCT Invoice), 0), 0) AS AvgOrderValue,
        greatest(date_sub('day', min(InvoiceDate), s), 1) AS TenureDays
 FROM featured CROSS JOIN s1 WHERE InvoiceDate <= s GROUP BY CustomerID, s),
labels AS (
 SELECT *, Recency > {INACT} AS IsChurned,
        CASE WHEN Recency > {INACT} THEN 'Churned' WHEN Recency > {INACT * DEFAULT.at_risk_factor} THEN 'At Risk'
             ELSE 'Active' END AS ChurnRiskLabel
 FROM cf)"""


@query("customer_features_at", with_chain("featured", "SELECT * FROM cf", extra=CF_SQL))
def q_customer_features_at(spark, sf):
    f = _f(spark, sf)
    return CU.customer_features_at(f, snapshot_row(f, 1))


@query("churn_labels", with_chain("featured", "SELECT * FROM labels", extra=CF_SQL))
def q_churn_labels(spark, sf):
    return _labels(spark, sf)


@query("churn_status", with_chain("featured", f"""
SELECT ChurnRiskLabel, count(*) AS Customers, count(*) / (SELECT {D('count(*)')} FROM labels) AS share,
       (SELECT {D("count(*) FILTER (WHERE ChurnRiskLabel = 'Churned')")} FROM labels)
         / (SELECT count(*) FROM labels) AS churn_rate
FROM labels GROUP BY ChurnRiskLabel""", extra=CF_SQL))
def q_churn_status(spark, sf):
    return CH.churn_status(_labels(spark, sf))


@query("churn_fallback_scores", with_chain("featured", """
SELECT *, CASE WHEN IsChurned THEN 0.9 ELSE 0.1 END::DOUBLE AS ChurnProbability FROM labels""", extra=CF_SQL))
def q_churn_fallback(spark, sf):
    return CH.score(None, _labels(spark, sf))


@query("hist_recency", with_chain("featured", """
SELECT ChurnRiskLabel, bin, round(lo + bin * ((hi - lo) / 40.0), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / 40.0), 6) AS bin_hi, count(*) AS count
FROM (SELECT ChurnRiskLabel, CASE WHEN hi = lo THEN 0 ELSE CAST(least(floor((x - lo) / (hi - lo) * 40.0), 39) AS INTEGER) END AS bin, lo, hi
      FROM (SELECT ChurnRiskLabel, CAST(Recency AS DOUBLE) AS x FROM labels) t
      CROSS JOIN (SELECT CAST(min(Recency) AS DOUBLE) AS lo, CAST(max(Recency) AS DOUBLE) AS hi FROM labels) mm)
GROUP BY ChurnRiskLabel, bin, lo, hi""", extra=CF_SQL))
def q_hist_recency(spark, sf):
    return rounded(ST.histogram(_labels(spark, sf), "Recency", 40, by="ChurnRiskLabel"),
                   ratio=("bin_lo", "bin_hi"))


TRAIN_SQL = f"""tb AS (SELECT max(InvoiceDate) - INTERVAL {INACT} DAY AS snap, min(InvoiceDate) AS mn FROM featured),
tf AS (
 SELECT CustomerID,
        date_sub('day', max(InvoiceDate) FILTER (WHERE InvoiceDate <= snap), snap) AS Recency,
        count(DISTINCT Invoice) FILTER (WHERE InvoiceDate <= snap) AS Frequency,
        {money_sum_sql("CASE WHEN InvoiceDate <= snap THEN TotalPrice END")} AS Monetary,
        coalesce({money_sum_sql("CASE WHEN InvoiceDate <= snap THEN TotalPrice END")}
                 / nullif(count(DISTINCT Invoice) FILTER (WHERE InvoiceDate <= snap), 0), 0) AS AvgOrderValue,
        greatest(date_sub('day', min(InvoiceDate) FILTER (WHERE InvoiceDate <= snap), snap), 1) AS TenureDays,
        CASE WHEN max(InvoiceDate) > snap THEN 0 ELSE 1 END AS Churned,
        date_sub('day', mn, snap) >= {DEFAULT.min_history_days} AS hist_ok
 FROM featured CROSS JOIN tb GROUP BY CustomerID, snap, mn
 HAVING min(InvoiceDate) FILTER (WHERE InvoiceDate <= snap) IS NOT NULL),
tst AS (SELECT count(*) AS n, count(DISTINCT Churned) AS classes FROM tf),
training AS (SELECT CustomerID, Recency, Frequency, Monetary, AvgOrderValue, TenureDays, Churned
             FROM tf CROSS JOIN tst WHERE hist_ok AND n >= {DEFAULT.min_train_rows} AND classes = 2),
split AS (
 SELECT *, rn <= CAST(ceil(cn * {DEFAULT.test_fraction}) AS BIGINT) AS is_test
 FROM (SELECT *, row_number() OVER (PARTITION BY Churned ORDER BY bucket, CustomerID) AS rn,
              count(*) OVER (PARTITION BY Churned) AS cn
       FROM (SELECT *, CAST(CAST(('0x' || substr(md5(CustomerID), 1, 8)) AS BIGINT) % {DEFAULT.split_buckets} AS INTEGER) AS bucket
             FROM training)))"""


@query("churn_training_labels", with_chain("featured", "SELECT * FROM training", extra=TRAIN_SQL))
def q_churn_training(spark, sf):
    return _training(spark, sf)


@query("stratified_split", with_chain("featured", "SELECT CustomerID, Churned, bucket, is_test FROM split",
                                      extra=TRAIN_SQL))
def q_stratified_split(spark, sf):
    return _split(spark, sf).select("CustomerID", "Churned", "bucket", "is_test")


# unrounded, with near ties: recency decides, tenure orders customers of equal recency by tiny steps
BASELINE_SCORE = "least(Recency / CAST(180.0 AS DOUBLE), 1.0::DOUBLE) * 0.9::DOUBLE + 0.0001::DOUBLE / (1 + TenureDays)"


@query("binary_metrics", with_chain("featured", """
SELECT n, tp, fp, tn, fn, coalesce((tp + tn) / nullif(n, 0), 0)::DOUBLE AS accuracy,
       coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
       coalesce(2 * p * r / nullif(p + r, 0), 0)::DOUBLE AS f1_score, roc_auc
FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS p, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS r
      FROM (SELECT count(*) AS n, count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp,
                   count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
                   count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
                   count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn FROM sc)) c
CROSS JOIN (SELECT sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) AS roc_auc
            FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
                  FROM (SELECT score AS s, count(*) FILTER (WHERE label = 1) AS pos,
                               count(*) FILTER (WHERE label = 0) AS neg FROM sc GROUP BY 1))) a""",
                                    extra=TRAIN_SQL + f""",
sc AS (SELECT Churned AS label, {BASELINE_SCORE} AS score FROM split WHERE is_test)"""))
def q_binary_metrics(spark, sf):
    """Metric code on a deterministic recency score over the test split (oracle twin of churn_metrics)."""
    sp = _split(spark, sf).where(F.col("is_test"))
    scored = sp.select(F.col("Churned").alias("label"),
                       (F.least(F.col("Recency") / F.lit(180.0), F.lit(1.0)) * F.lit(0.9) + F.lit(0.0001) / (F.col("TenureDays") + 1)).alias("score"))
    return CH.binary_metrics(scored)


@query("churn_scores")
def q_churn_scores(spark, sf):
    model, _ = churn_model(spark, sf)
    return CH.score(model, _labels(spark, sf))


@query("churn_metrics")
def q_churn_metrics(spark, sf):
    model, split = churn_model(spark, sf)
    if model is None:
        return spark.createDataFrame([], "n BIGINT")
    return CH.model_metrics(model, split)


@query("churn_importance")
def q_churn_importance(spark, sf):
    model, _ = churn_model(spark, sf)
    if model is None:
        return spark.createDataFrame([], "Feature STRING, Importance DOUBLE")
    return CH.importances(model, spark)


@query("churn_watchlist")
def q_churn_watchlist(spark, sf):
    model, _ = churn_model(spark, sf)
    return CH.watchlist(CH.score(model, _labels(spark, sf)))
