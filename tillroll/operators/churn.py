"""Churn operators.

Features and the training label come from one ``groupBy(CustomerID)`` over
all lines (features from lines up to the snapshot, label from whether any
line falls after it), so the label needs no second pass or anti-join.
The hold-out split is exact and repeatable without a global sort: customers
are hashed into 10,000 buckets, only bucket counts are ordered, and a row
number is taken inside the single cutoff bucket per class.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from tillroll.config import CHURN_FEATURES, DEFAULT, Config
from tillroll.functions.calendar import elapsed_days
from tillroll.functions.formatting import fmt_plain_float
from tillroll.functions.numeric import money_sum, safe_divide
from tillroll.operators.customers import customer_features_at
from tillroll.operators.features import snapshot_row
from tillroll.operators.quantiles import with_scalars


def risk_label(recency: Column, cfg: Config = DEFAULT) -> Column:
    """> inactivity days -> Churned, > 0.6 x inactivity -> At Risk, else Active."""
    return (F.when(recency > cfg.churn_inactivity_days, F.lit("Churned"))
             .when(recency > cfg.churn_inactivity_days * cfg.at_risk_factor, F.lit("At Risk"))
             .otherwise(F.lit("Active")))


def churn_labels(df: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Features as of max + 1 day with IsChurned and ChurnRiskLabel."""
    feats = customer_features_at(df, snapshot_row(df, 1))
    return feats.withColumns({
        "IsChurned": F.col("Recency") > cfg.churn_inactivity_days,
        "ChurnRiskLabel": risk_label(F.col("Recency"), cfg),
    })


def churn_status(labels: DataFrame) -> DataFrame:
    """Customers per status with the status share, plus the overall churn rate."""
    counts = labels.groupBy("ChurnRiskLabel").agg(F.count(F.lit(1)).alias("Customers"))
    tot = labels.agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("ChurnRiskLabel") == "Churned").alias("_c"))
    return (with_scalars(counts, tot)
            .select("ChurnRiskLabel", "Customers",
                    (F.col("Customers") / F.col("_n")).alias("share"),
                    safe_divide(F.col("_c"), F.col("_n")).alias("churn_rate")))


def training_set(df: DataFrame, cfg: Config = DEFAULT, guarded: bool = True) -> DataFrame:
    """Features as of max - inactivity days, label Churned = no purchase after it.

    Guards (empty result): history before the snapshot under 30 days, fewer
    than 50 customers, or a single class.
    """
    bounds = df.agg((F.max("InvoiceDate") - F.make_interval(days=F.lit(cfg.churn_inactivity_days)))
                    .alias("_snap"), F.min("InvoiceDate").alias("_min"))
    d = with_scalars(df, bounds)
    inside = F.col("InvoiceDate") <= F.col("_snap")
    g = d.groupBy("CustomerID").agg(
        F.max(F.when(inside, F.col("InvoiceDate"))).alias("_last"),
        F.min(F.when(inside, F.col("InvoiceDate"))).alias("_first"),
        F.count_distinct(F.when(inside, F.col("Invoice"))).alias("Frequency"),
        money_sum(F.when(inside, F.col("TotalPrice"))).alias("Monetary"),
        F.max("InvoiceDate").alias("_latest"))
    g = with_scalars(g, bounds)
    ts = g.where(F.col("_first").isNotNull()).select(
        "CustomerID",
        elapsed_days("_last", "_snap").alias("Recency"),
        "Frequency", "Monetary",
        safe_divide("Monetary", "Frequency").alias("AvgOrderValue"),
        F.greatest(elapsed_days("_first", "_snap"), F.lit(1)).alias("TenureDays"),
        F.when(F.col("_latest") > F.col("_snap"), F.lit(0)).otherwise(F.lit(1)).alias("Churned"),
        (elapsed_days("_min", "_snap") >= cfg.min_history_days).alias("_hist_ok"),
    )
    if not guarded:
        return ts.drop("_hist_ok")
    stats = ts.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("Churned").alias("_classes"))
    return (with_scalars(ts, stats)
            .where(F.col("_hist_ok") & (F.col("_n") >= cfg.min_train_rows) & (F.col("_classes") == 2))
            .drop("_hist_ok", "_n", "_classes"))


def split_bucket(key: Column, buckets: int) -> Column:
    """Repeatable pseudo-random bucket from the first 32 bits of md5(key)."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def stratified_split(ts: DataFrame, cfg: Config = DEFAULT, label: str = "Churned") -> DataFrame:
    """Per class, the first ceil(25 %) customers in (bucket, CustomerID) order are test rows.

    Adds ``bucket`` and ``is_test``. Windows run only over the bucket counts
    (at most ``split_buckets`` rows per class) and inside the one cutoff
    bucket of each class.
    """
    b = ts.withColumn("bucket", split_bucket(F.col("CustomerID"), cfg.split_buckets))
    counts = b.groupBy(label, "bucket").agg(F.count(F.lit(1)).alias("_bn"))
    w_cum = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_before", F.coalesce(F.sum("_bn").over(w_cum), F.lit(0)))
                    .withColumn("_class_n", F.sum("_bn").over(Window.partitionBy(label)))
                    .withColumn("_t", F.ceil(F.col("_class_n") * F.lit(cfg.test_fraction))))
    # bucket counts: at most (classes x buckets) rows, broadcast is bounded
    j = b.join(F.broadcast(counts.select(label, "bucket", "_before", "_bn", "_t")), [label, "bucket"])
    whole = F.col("_before") + F.col("_bn") <= F.col("_t")
    none = F.col("_before") >= F.col("_t")
    rn = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("CustomerID"))
    cut = j.where(~whole & ~none).withColumn("is_test", rn <= F.col("_t") - F.col("_before"))
    return j.where(whole | none).withColumn("is_test", whole & ~none).unionByName(cut).drop("_before", "_bn", "_t")


def binary_metrics(scored: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """Confusion counts, accuracy, precision, recall, F1 (0 on 0/0) and exact ROC-AUC (NULL with one class)."""
    y = F.col(label).cast("int")
    pred = (F.col(score) >= threshold).cast("int")
    c = scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((y == 1) & (pred == 1)).alias("tp"), F.count_if((y == 0) & (pred == 1)).alias("fp"),
        F.count_if((y == 0) & (pred == 0)).alias("tn"), F.count_if((y == 1) & (pred == 0)).alias("fn"))
    prec = safe_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = safe_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    c = c.select("n", "tp", "fp", "tn", "fn",
                 safe_divide(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
                 prec.alias("precision"), rec.alias("recall"),
                 safe_divide(2 * prec * rec, prec + rec).alias("f1_score"))
    return with_scalars(c, roc_auc(scored, label, score))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", buckets: int = 4096) -> DataFrame:
    """One row: the Mann-Whitney statistic over the scores as they are (ties count one half).

    Scores are dealt into ``buckets`` equal parts of their range; running counts over those bounded parts and over the scores inside one
    part give the negatives below each score, so no window holds more than one part, and a part holds more than a
    share of the rows only where scores tie (a tie is one row).
    """
    y, s = F.col(label).cast("int"), F.col(score).cast("double")
    g = scored.groupBy(s.alias("_s")).agg(F.count_if(y == 1).alias("_pos"), F.count_if(y == 0).alias("_neg"))
    ends = scored.agg(F.min(s).alias("_lo"), F.max(s).alias("_hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col("_s") - F.col("_lo"), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))) * F.lit(float(buckets))), F.lit(0))
    g = with_scalars(g, ends).withColumn("_b", part)
    parts = g.groupBy("_b").agg(F.sum("_neg").alias("_n"))
    before = parts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_neg").over(Window.partitionBy("_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # at most buckets + 1 rows: broadcast is bounded
    return (g.withColumn("_inside", inside).join(F.broadcast(before), "_b")
            .agg(F.try_divide(F.sum(F.col("_pos") * (F.col("_before") + F.col("_inside") + F.col("_neg") * 0.5)),
                              F.nullif(F.sum("_pos") * F.sum("_neg"), F.lit(0))).alias("roc_auc")))


def balanced_weights(ts: DataFrame, label: str = "Churned") -> DataFrame:
    """Class weights n / (2 n_class), as scikit-learn's 'balanced'."""
    s = ts.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label)).alias("_pos"))
    w = F.when(F.col(label) == 1, F.col("_n") / (2.0 * F.col("_pos"))) \
         .otherwise(F.col("_n") / (2.0 * (F.col("_n") - F.col("_pos"))))
    return with_scalars(ts, s).withColumn("weight", w).drop("_n", "_pos")


def assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(CHURN_FEATURES), outputCol="features")


def train_model(train: DataFrame, cfg: Config = DEFAULT) -> RandomForestClassificationModel:
    """Random Forest, 120 trees, depth 8, min leaf 5, balanced class weights."""
    # the fit makes one pass over the data per tree level: persist the assembled
    # rows so the split lineage is not recomputed on every pass
    data = assembler().transform(balanced_weights(train)).select("features", "Churned", "weight") \
        .persist(StorageLevel.MEMORY_AND_DISK)
    rf = RandomForestClassifier(featuresCol="features", labelCol="Churned", weightCol="weight",
                                numTrees=cfg.rf_trees, maxDepth=cfg.rf_depth,
                                minInstancesPerNode=cfg.rf_min_leaf, seed=cfg.seed,
                                maxMemoryInMB=1024, cacheNodeIds=True)
    try:
        return rf.fit(data)
    finally:
        data.unpersist()


def score(model: RandomForestClassificationModel | None, customers: DataFrame) -> DataFrame:
    """Churn probability per customer; without a model 0.9 if churned else 0.1."""
    if model is None:
        return customers.withColumn(
            "ChurnProbability", F.when(F.col("IsChurned"), F.lit(0.9)).otherwise(F.lit(0.1)))
    out = model.transform(assembler().transform(customers))
    return (out.withColumn("ChurnProbability", vector_to_array("probability")[1])
               .drop("features", "rawPrediction", "probability", "prediction"))


def model_metrics(model: RandomForestClassificationModel, split: DataFrame) -> DataFrame:
    """M15 for the model on the test rows, plus n_train / n_test and ROC-AUC."""
    test = split.where(F.col("is_test"))
    pred = score(model, test).withColumnRenamed("Churned", "label")
    m = binary_metrics(pred.select("label", F.col("ChurnProbability").alias("score")))
    sizes = split.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if(F.col("is_test")).alias("n_test"))
    return with_scalars(m, sizes).select(*[c for c in m.columns if c != "roc_auc"], "n_train", "n_test", "roc_auc")


def importances(model: RandomForestClassificationModel, spark) -> DataFrame:
    """Feature importances (4 dp), sorted ascending as displayed."""
    rows = [(f, float(round(v, 4))) for f, v in zip(CHURN_FEATURES, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "Feature STRING, Importance DOUBLE").orderBy("Importance", "Feature")


def watchlist(scored: DataFrame, k: int = 20) -> DataFrame:
    """K8: the k highest churn probabilities among customers not yet churned."""
    return (scored.where(F.col("ChurnRiskLabel") != "Churned")
                  .orderBy(F.desc("ChurnProbability"), F.asc("CustomerID")).limit(k)
                  .select("CustomerID", "Recency", "Frequency", "Monetary", "ChurnProbability",
                          "ChurnRiskLabel"))


def watchlist_table(listed: DataFrame) -> DataFrame:
    """Display form of the watchlist: the probability as percent text."""
    return listed.withColumn("ChurnProbability", F.concat(fmt_plain_float(F.col("ChurnProbability") * 100, 1), F.lit("%")))
