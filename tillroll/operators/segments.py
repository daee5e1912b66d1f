"""Customer segmentation.

RFM -> log1p / population z-scores -> Spark ML KMeans (best of N seeded
restarts by training cost) -> data-driven labels. The label table has one
row per cluster (k rows), so broadcasting it is bounded by k.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillroll.config import DEFAULT, SEGMENT_LABELS, Config
from tillroll.functions.formatting import fmt_currency, fmt_plain_float
from tillroll.functions.numeric import money_sum, np_round
from tillroll.operators.customers import rfm as rfm_table
from tillroll.operators.quantiles import quantile_row, with_scalars


def rfm_scaled(rfm: DataFrame) -> DataFrame:
    """M1: Recency, log1p(Frequency), log1p(Monetary) standardised with the population std."""
    t = rfm.withColumns({"_r": F.col("Recency").cast("double"),
                         "_f": F.log1p(F.col("Frequency").cast("double")),
                         "_m": F.log1p(F.col("Monetary"))})
    stats = t.agg(*[F.avg(c).alias(f"{c}_mu") for c in ("_r", "_f", "_m")],
                  *[F.stddev_pop(c).alias(f"{c}_sd") for c in ("_r", "_f", "_m")])
    t = with_scalars(t, stats)
    z = {name: F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mu"), F.nullif(F.col(f"{c}_sd"), F.lit(0.0))),
                          F.lit(0.0))
         for name, c in (("R_z", "_r"), ("F_z", "_f"), ("M_z", "_m"))}
    return t.withColumns(z).drop(*[c for c in t.columns if c.startswith("_")])


def fit_kmeans(scaled: DataFrame, k: int, cfg: Config = DEFAULT, parallel: int | None = None) -> KMeansModel:
    """M2: k-means with ``kmeans_restarts`` seeds, keeping the lowest training cost
    (ties: lowest seed). The restarts are independent fits over one persisted
    feature frame, submitted as concurrent Spark jobs (all restarts at once by default)."""
    data = VectorAssembler(inputCols=["R_z", "F_z", "M_z"], outputCol="features").transform(scaled) \
        .select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        data.count()

        # scikit-learn stops when the summed squared centre shift is below 1e-4 x the mean
        # feature variance (1 after standardising); a per-centre shift below sqrt(1e-4 / k)
        # guarantees that, so it is Spark's equivalent stopping rule
        tol = (1e-4 / k) ** 0.5

        def fit(i: int) -> KMeansModel:
            return KMeans(k=k, seed=cfg.seed + i, maxIter=300, tol=tol, featuresCol="features").fit(data)

        with ThreadPoolExecutor(max_workers=max(1, min(parallel or cfg.kmeans_restarts, cfg.kmeans_restarts))) as pool:
            models = list(pool.map(fit, range(cfg.kmeans_restarts)))
    finally:
        data.unpersist()
    return min(enumerate(models), key=lambda im: (im[1].summary.trainingCost, im[0]))[1]


def assign(model: KMeansModel, scaled: DataFrame) -> DataFrame:
    feats = VectorAssembler(inputCols=["R_z", "F_z", "M_z"], outputCol="features").transform(scaled)
    return model.setPredictionCol("Cluster").transform(feats)


def silhouette(clustered: DataFrame, k: int) -> float | None:
    """M3: silhouette with squared Euclidean distance (Spark's linear-time form);
    None when there are no more rows than clusters."""
    if clustered.limit(k + 1).count() <= k:
        return None
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="Cluster", metricName="silhouette",
                             distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(clustered))


def _avg_rank(col: str, ascending: bool):
    """Average rank (1 = best) with ties sharing the mean of their positions."""
    o = F.asc(col) if ascending else F.desc(col)
    return (F.rank().over(Window.orderBy(o))
            + (F.count(F.lit(1)).over(Window.partitionBy(col)) - 1) / 2.0)


def segment_labels(clustered: DataFrame) -> DataFrame:
    """M4 (W2, W3, F22): cluster -> label from the mean-rank score of cluster RFM means.

    Windows here run over the k cluster rows only.
    """
    stats = clustered.groupBy("Cluster").agg(F.avg("Recency").alias("_r"), F.avg("Frequency").alias("_f"),
                                             F.avg("Monetary").alias("_m"))
    stats = stats.withColumn("Score", (_avg_rank("_r", True) + _avg_rank("_f", False)
                                       + _avg_rank("_m", False)) / 3.0)
    pos = F.row_number().over(Window.orderBy("Score", "Cluster")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    slots = len(SEGMENT_LABELS) - 1
    step = F.lit(float(slots)) / (n - 1)
    idx = F.when(n == 1, F.lit(0)).otherwise(F.bround(F.col("_pos") * step, 0).cast("int"))
    pool = F.array(*[F.lit(x) for x in SEGMENT_LABELS])
    label = F.when(n <= len(SEGMENT_LABELS), F.element_at(pool, idx + 1)) \
             .otherwise(F.concat(F.lit("Segment "), (F.col("_pos") + 1).cast("string")))
    return stats.withColumn("_pos", pos).select("Cluster", "Score", label.alias("Segment"))


def segment_customers(df: DataFrame, k: int | None = None, cfg: Config = DEFAULT):
    """M5: (segments frame, silhouette, model) for featured lines.

    Segments: CustomerID, Recency, Frequency, Monetary, Cluster, Segment.
    """
    k = k or cfg.clusters
    scaled = rfm_scaled(rfm_table(df))
    model = fit_kmeans(scaled, k, cfg)
    clustered = assign(model, scaled)
    sil = silhouette(clustered, k)
    labels = segment_labels(clustered)
    segs = clustered.join(F.broadcast(labels.select("Cluster", "Segment")), "Cluster") \
        .select("CustomerID", "Recency", "Frequency", "Monetary", "Cluster", "Segment")
    return segs, sil, model


def _exact(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


RFM_TERMS = {"R_z": "CAST(Recency AS DOUBLE)", "F_z": "log1p(CAST(Frequency AS DOUBLE))", "M_z": "log1p(CAST(Monetary AS DOUBLE))"}


def scaling_stage(rfm: DataFrame) -> SQLTransformer:
    """M1 as a saved stage: the population mean and deviation of ``rfm`` as literals (a deviation of 0 gives 0), so later customers are scaled alike."""
    got = rfm.agg(*[f(F.expr(e)).alias(f"{c}{i}") for c, e in RFM_TERMS.items() for i, f in enumerate((F.avg, F.stddev_pop))]).first()
    if got["R_z0"] is None:
        raise ValueError("no customers to scale by")
    z = [f"(({e}) - {_exact(got[c + '0'])}) / {_exact(got[c + '1'])} AS {c}" if got[c + "1"] else f"({e}) * 0D AS {c}" for c, e in RFM_TERMS.items()]
    return SQLTransformer(statement=f"SELECT *, {', '.join(z)} FROM __THIS__")


def nearest_stage(centers) -> SQLTransformer:
    """Cluster = number of the nearest centre by squared distance, ties to the smallest; null where a feature is null."""
    dist = [" + ".join(f"({c} - {_exact(v)}) * ({c} - {_exact(v)})" for c, v in zip(RFM_TERMS, center, strict=True)) for center in centers]
    return SQLTransformer(statement=f"SELECT * EXCEPT (_d), CAST(array_position(_d, array_min(_d)) - 1 AS INT) AS Cluster "
                                    f"FROM (SELECT *, array({', '.join(dist)}) AS _d FROM __THIS__)")


def label_stage(labels: DataFrame) -> SQLTransformer:
    """Cluster -> Segment by the label table (k rows, read here); null for clusters it lacks."""
    rows = labels.select("Cluster", "Segment").orderBy("Cluster").collect()
    cases = " ".join("WHEN {} THEN '{}'".format(r.Cluster, r.Segment.replace("'", "''")) for r in rows)
    return SQLTransformer(statement=f"SELECT *, CASE Cluster {cases} END AS Segment FROM __THIS__")


def segmenter(rfm: DataFrame, centers) -> PipelineModel:
    """Scaler of ``rfm``, centres and the labels that they get on ``rfm`` as one pipeline of Spark's own stages.

    ``io.save_model`` writes it, ``PipelineModel.load`` reads it in any session (no class of this library is needed), and ``transform`` scores
    any customers with Recency, Frequency and Monetary: R_z, F_z, M_z, Cluster and Segment are added, nothing is fitted anew.
    """
    scored = PipelineModel([scaling_stage(rfm), nearest_stage(centers)])
    return PipelineModel([*scored.stages, label_stage(segment_labels(scored.transform(rfm)))])


def fit_segmenter(rfm: DataFrame, k: int | None = None, cfg: Config = DEFAULT) -> PipelineModel:
    """The saved form of :func:`segment_customers`: k-means centres of ``rfm`` in a :func:`segmenter`."""
    return segmenter(rfm, fit_kmeans(rfm_scaled(rfm), k or cfg.clusters, cfg).clusterCenters())


def segment_summary(segs: DataFrame) -> DataFrame:
    """Customers, mean R/F/M, total M, % of customers and % of revenue per segment."""
    g = segs.groupBy("Segment").agg(
        F.count(F.lit(1)).alias("Customers"),
        (F.sum("Recency") / F.count(F.lit(1))).alias("AvgRecencyDays"),
        (F.sum("Frequency") / F.count(F.lit(1))).alias("AvgFrequency"),
        (money_sum("Monetary") / F.count(F.lit(1))).alias("AvgMonetary"),
        money_sum("Monetary").alias("TotalMonetary"))
    tot = segs.agg(F.count(F.lit(1)).alias("_c"), money_sum("Monetary").alias("_m"))
    return (with_scalars(g, tot)
            .withColumn("PctOfCustomers", F.lit(100.0) * F.col("Customers") / F.col("_c"))
            .withColumn("PctOfRevenue", F.lit(100.0) * F.col("TotalMonetary") / F.col("_m"))
            .drop("_c", "_m"))


QUARTILE_SEGMENTS = ("Lost", "At Risk", "Potential Loyalists", "Champions")


def quartile_segments(rfm: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Deterministic rule segments by Monetary quartile (the oracle twin of the
    KMeans segments, so the summary logic can be checked against SQL)."""
    q = quantile_row(rfm, "Monetary", [0.25, 0.5, 0.75], ["_q1", "_q2", "_q3"])
    m = F.col("Monetary")
    seg = (F.when(m <= F.col("_q1"), F.lit(QUARTILE_SEGMENTS[0]))
            .when(m <= F.col("_q2"), F.lit(QUARTILE_SEGMENTS[1]))
            .when(m <= F.col("_q3"), F.lit(QUARTILE_SEGMENTS[2]))
            .otherwise(F.lit(QUARTILE_SEGMENTS[3])))
    return with_scalars(rfm, q).withColumn("Segment", seg).drop("_q1", "_q2", "_q3")


def frequency_clusters(rfm: DataFrame, k: int) -> DataFrame:
    """Deterministic clusters (the oracle twin of KMeans for labels): order count modulo k."""
    return rfm.withColumn("Cluster", (F.col("Frequency") % k).cast("int"))


def segment_table(summary: DataFrame, symbol: str = DEFAULT.currency) -> DataFrame:
    """Display form of the segment summary: rounded means, currency and percent texts."""
    def pct(c: str):
        return F.concat(fmt_plain_float(c, 1), F.lit("%")).alias(c)
    return summary.select("Segment", "Customers", np_round("AvgRecencyDays", 1).alias("AvgRecencyDays"), np_round("AvgFrequency", 1).alias("AvgFrequency"),
                          fmt_currency("AvgMonetary", symbol).alias("AvgMonetary"), fmt_currency("TotalMonetary", symbol).alias("TotalMonetary"),
                          pct("PctOfCustomers"), pct("PctOfRevenue"))
