"""Fitted models shared by the registered queries, one fit per session and input.

Fitting is the one place a query must run jobs eagerly (Spark ML fits are
actions); the fitted model is memoised so dependent queries reuse it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, Config
from tillroll.operators import churn as CH
from tillroll.operators import segments as SG
from tillroll.operators.customers import rfm
from tillroll.plans.stages import LOCK, _key, customer_frame

_MODELS: dict = {}


def segmentation(spark: SparkSession, sf_dir: str, k: int | None = None, cfg: Config = DEFAULT):
    """(segments, silhouette, kmeans model) for the featured table of ``sf_dir``."""
    key = _key(spark, sf_dir, cfg, f"kmeans{k or cfg.clusters}")
    with LOCK:
        if key not in _MODELS:
            scaled = SG.rfm_scaled(customer_frame(spark, sf_dir, "rfm", rfm, cfg))
            model = SG.fit_kmeans(scaled, k or cfg.clusters, cfg)
            _MODELS[key] = (model, SG.silhouette(SG.assign(model, scaled), k or cfg.clusters))
    model, sil = _MODELS[key]
    scaled = SG.rfm_scaled(customer_frame(spark, sf_dir, "rfm", rfm, cfg))
    clustered = SG.assign(model, scaled)
    labels = SG.segment_labels(clustered)
    segs = clustered.join(F.broadcast(labels.select("Cluster", "Segment")), "Cluster") \
        .select("CustomerID", "Recency", "Frequency", "Monetary", "Cluster", "Segment")
    return segs, sil, model


def churn_model(spark: SparkSession, sf_dir: str, cfg: Config = DEFAULT):
    """(model or None, split frame). None when the training guards leave no rows."""
    key = _key(spark, sf_dir, cfg, "churn_rf")
    training = customer_frame(spark, sf_dir, "training", lambda f: CH.training_set(f, cfg), cfg)
    split = customer_frame(spark, sf_dir, "split", lambda f: CH.stratified_split(training, cfg), cfg)
    with LOCK:
        if key not in _MODELS:
            train = split.where(~F.col("is_test"))
            _MODELS[key] = CH.train_model(train, cfg) if train.limit(1).count() > 0 else None
    return _MODELS[key], split
