"""Full run (C1-C4): raw lines -> staged clean/featured tables -> every result.

Clean and featured lines are written once as Parquet stages in the shared
checkpoint folder (lineage cut, column-pruned re-reads); everything after
them is a lazy DataFrame except the model fits, which must run eagerly.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.config import DEFAULT, Config
from tillroll.operators import churn as CH
from tillroll.operators import forecast as FC
from tillroll.operators import insights as IN
from tillroll.operators import inventory as INV
from tillroll.operators import segments as SG
from tillroll.operators.cleaning import clean
from tillroll.operators.features import engineer
from tillroll.plans.stages import identity, stage, staged_clean_report
from tillroll.session import scratch_path
from tillroll.sources.io import save_model


@dataclass
class PipelineResults:
    report: DataFrame
    clean: DataFrame
    featured: DataFrame
    segments: DataFrame
    silhouette: float | None
    segment_summary: DataFrame
    forecast: DataFrame
    forecast_summary: DataFrame
    churn: DataFrame
    churn_metrics: DataFrame | None
    inventory: DataFrame
    inventory_summary: DataFrame
    insights: DataFrame


def run_pipeline(spark: SparkSession, raw: DataFrame, cfg: Config = DEFAULT, stage_dir: str | None = None,
                 train_churn: bool = True) -> PipelineResults:
    """Clean -> features -> segments, forecast, churn, inventory -> insights."""
    stage_dir = f'{stage_dir or scratch_path(spark, "pipeline", uuid.uuid4().hex[:12])}/{identity(spark, raw, cfg)}'
    clean_df, report = staged_clean_report(spark, raw, f"{stage_dir}/clean", cfg)
    featured = stage(spark, f"{stage_dir}/featured", lambda: engineer(clean_df, cfg))

    segs, sil, _ = SG.segment_customers(featured, cfg.clusters, cfg)
    fc, _ = FC.forecast(featured, cfg.forecast_horizon_days, method="holt_winters", cfg=cfg)

    # per-customer tables read by several results: written once each
    labels = stage(spark, f"{stage_dir}/churn_labels", lambda: CH.churn_labels(featured, cfg))
    model, metrics = None, None
    if train_churn:
        training = stage(spark, f"{stage_dir}/training", lambda: CH.training_set(featured, cfg))
        split = stage(spark, f"{stage_dir}/split", lambda: CH.stratified_split(training, cfg))
        train = split.where(~F.col("is_test"))
        if train.limit(1).count() > 0:
            model = CH.train_model(train, cfg)
            metrics = CH.model_metrics(model, split)
    churn = CH.score(model, labels)

    inv = INV.recommend(featured, cfg)
    return PipelineResults(
        report=report, clean=clean_df, featured=featured,
        segments=segs, silhouette=sil, segment_summary=SG.segment_summary(segs),
        forecast=fc, forecast_summary=FC.summary(fc), churn=churn, churn_metrics=metrics,
        inventory=inv, inventory_summary=INV.summary(inv), insights=IN.generate(featured, segs, inv, cfg))


def _segments(df: DataFrame, dst: str, cfg: Config) -> DataFrame:
    segments, _, model = SG.segment_customers(df, cfg.clusters, cfg)
    save_model(model, f"{dst}-model")
    return segments


def _churn(df: DataFrame, dst: str, cfg: Config) -> DataFrame:
    """Labels with probabilities; the rule-based ones if the history is too short to train on."""
    train = CH.stratified_split(CH.training_set(df, cfg), cfg).where(~F.col("is_test"))
    model = CH.train_model(train, cfg) if train.limit(1).count() else None
    if model is not None:
        save_model(model, f"{dst}-model")
    return CH.score(model, CH.churn_labels(df, cfg))


def run_stage(spark: SparkSession, name: str, src: str, dst: str, cfg: Config = DEFAULT) -> DataFrame:
    """C4: one stage as Parquet in, Parquet out (clean, features, inventory, forecast, segments,
    scored churn, insights). Models of segments and churn are saved beside their table, at ``<dst>-model``."""
    df = spark.read.parquet(src)
    build = {
        "clean": lambda: clean(df, cfg),
        "features": lambda: engineer(df, cfg),
        "inventory": lambda: INV.recommend(df, cfg),
        "forecast": lambda: FC.forecast(df, cfg.forecast_horizon_days, method="holt_winters", cfg=cfg)[0],
        "segments": lambda: _segments(df, dst, cfg),
        "churn": lambda: _churn(df, dst, cfg),
        "insights": lambda: IN.generate(df, SG.segment_customers(df, cfg.clusters, cfg)[0], INV.recommend(df, cfg), cfg),
    }
    if name not in build:
        raise ValueError(f"unknown stage {name!r}; one of {sorted(build)}")
    build[name]().write.mode("overwrite").parquet(dst)
    return spark.read.parquet(dst)
