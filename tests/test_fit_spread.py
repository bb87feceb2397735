"""The fit at size: members side by side, rows dealt evenly over the cores."""

import threading

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from retentio.operators import ml as M


def _sizes(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def _rows(spark, n):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    return spark.range(0, n, 1, 1).select("id", x.alias("x"), (F.col("id") % 7).cast("double").alias("y"),
                                          (x > 0.6).cast("int").alias("Churn"), F.lit(1.0).alias("w"))


def test_rows_are_dealt_evenly_over_the_cores(spark):
    n = M.PART_ROWS * (spark.sparkContext.defaultParallelism + 1)
    df = _rows(spark, n)
    out = M.spread(df)
    sizes = _sizes(out)
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == n and max(sizes) < 1.1 * min(sizes)
    assert out.select("id").distinct().count() == n
    few = df.limit(M.PART_ROWS)
    assert M.spread(few) is few


def test_parts_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 10)
    monkeypatch.setattr(M, "PART_MOST", 50)
    sizes = _sizes(M.spread(_rows(spark, 1000)))
    assert len(sizes) == max(spark.sparkContext.defaultParallelism, 20)


def test_members_are_fitted_side_by_side_on_dealt_rows(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_ROWS", 100)
    meet, seen = threading.Barrier(3, timeout=60), {}
    for cls in (RandomForestClassifier, GBTClassifier):
        def fit(self, df, params=None, whole=cls.fit):
            meet.wait()  # all three are under way
            seen[self.getPredictionCol()] = (df.rdd.getNumPartitions(), self.getCacheNodeIds())
            return whole(self, df, params)
        monkeypatch.setattr(cls, "fit", fit)
    rows = _rows(spark, 1000)
    cfg = M.EnsembleConfig(rf_trees=5, rf_depth=3, gbt_iter=3, gbt_depth=2)
    model = M.fit_ensemble(rows, features=["x", "y"], cfg=cfg, weight_col="w")
    parts = min(spark.sparkContext.defaultParallelism, 10)
    assert seen == {"pred_rf": (parts, True), "pred_gbt_a": (parts, False), "pred_gbt_b": (parts, False)}
    assert [type(s).__name__ for s in model.pipeline_model.stages[1:]] == [
        "RandomForestClassificationModel", "GBTClassificationModel", "GBTClassificationModel"]
    assert [s.getNumTrees for s in model.pipeline_model.stages[1:]] == [5, 3, 3]
    scored = model.score(rows)
    assert scored.count() == 1000
    assert scored.where("Predicted_Churn_Numeric <> Churn").count() == 0
