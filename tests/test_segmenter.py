import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tillroll.operators import segments as SG
from tillroll.operators.customers import rfm
from tillroll.session import scratch_path
from tillroll.sources import io

LOAD = """
import sys
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
new = spark.createDataFrame([("n1", 1, 40, 90000.0), ("n2", 700, 1, 1.0), ("n3", None, 1, 5.0)], "CustomerID string, Recency int, Frequency long, Monetary double")
print("GOT", [(r.CustomerID, r.Cluster, r.Segment) for r in PipelineModel.load(sys.argv[1]).transform(new).orderBy("CustomerID").collect()])
"""


def test_saved_segmentation_scores_like_the_fitted_one(spark, featured_small):
    table = rfm(featured_small).cache()
    scaled = SG.rfm_scaled(table)
    kmeans = SG.fit_kmeans(scaled, 4)
    assigned = SG.assign(kmeans, scaled)
    want = assigned.join(SG.segment_labels(assigned).select("Cluster", "Segment"), "Cluster").select("CustomerID", "Cluster", "Segment")
    model = SG.segmenter(table, kmeans.clusterCenters())
    path = scratch_path(spark, "models", "segmenter-test")
    io.save_model(model, path)
    got = io.load_model(PipelineModel, path).transform(table)
    assert sorted(got.select("CustomerID", "Cluster", "Segment").collect()) == sorted(want.collect())
    # a part of the customers gets the same segments: nothing is fitted anew
    some = table.where(F.col("Monetary") > table.agg(F.avg("Monetary")).first()[0])
    assert sorted(model.transform(some).select("CustomerID", "Segment").collect()) == \
        sorted(want.join(some.select("CustomerID"), "CustomerID").select("CustomerID", "Segment").collect())
    # another session, without this library, scores customers that were not there
    out = subprocess.run([sys.executable, "-c", LOAD, path], capture_output=True, text=True, timeout=180, cwd="/")
    line = next(x for x in out.stdout.splitlines() if x.startswith("GOT"))
    rows = dict((c, (k, s)) for c, k, s in eval(line[4:]))
    assert rows.pop("n3") == (None, None)
    # by hand: the terms of the new customers on the old ones' scale, the nearest centre, its label
    base = np.array([[r.Recency, np.log1p(r.Frequency), np.log1p(r.Monetary)] for r in table.collect()])
    label = {r.Cluster: r.Segment for r in want.collect()}
    for name, terms in (("n1", (1, 40, 90000.0)), ("n2", (700, 1, 1.0))):
        z = (np.array([terms[0], np.log1p(terms[1]), np.log1p(terms[2])]) - base.mean(0)) / base.std(0)
        near = int(((np.array(kmeans.clusterCenters()) - z) ** 2).sum(1).argmin())
        assert rows[name] == (near, label[near])
    assert ROOT not in out.stdout


def test_ties_flat_features_and_no_customers(spark):
    same = spark.createDataFrame([("a", 3, 1, 9.0), ("b", 3, 1, 9.0)], "CustomerID string, Recency int, Frequency long, Monetary double")
    got = SG.segmenter(same, [(1.0, 0.0, 0.0), (-1.0, 0.0, 0.0)]).transform(same).collect()
    assert {(r.R_z, r.F_z, r.M_z, r.Cluster) for r in got} == {(0.0, 0.0, 0.0, 0)}     # both centres are as near: the first
    with pytest.raises(ValueError, match="no customers"):
        SG.segmenter(same.limit(0), [(0.0, 0.0, 0.0)])
