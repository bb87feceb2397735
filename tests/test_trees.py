"""Trees as a table: votes, importances, and the package that a model is saved in."""

import json
import os

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from retentio.operators import ml as M
from retentio.operators import trees as T
from retentio.operators.features import align_features, business_features
from retentio.operators.score import ModelUnavailable, score_with_model
from retentio.plans.batch import clean_customers, materialise
from retentio.plans.mart import customer_mart


@pytest.fixture(scope="module")
def fitted(spark, tmp_path_factory):
    cleaned, st = clean_customers(customer_mart(spark, SF_SMALL))
    feats = materialise(align_features(business_features(cleaned, st), keep=("CustomerID", "Churn")))
    weighted = feats.withColumn("__w", M.class_weights(feats))
    model = M.fit_ensemble(weighted, cfg=M.EnsembleConfig(rf_trees=7, rf_depth=5, gbt_iter=4, gbt_depth=3), weight_col="__w")
    path = str(tmp_path_factory.mktemp("package"))
    model.save(path, stats_version="v1")
    return model, feats, path


def test_votes_from_the_node_table_are_the_models(spark, fitted):
    model, feats, path = fitted
    nodes = spark.read.parquet(os.path.join(path, "nodes"))
    assert nodes.groupBy("model").agg(F.countDistinct("tree").alias("k")).collect() and nodes.where("depth is null").count() == 0
    a = {r["CustomerID"]: r for r in model.score(feats).collect()}
    b = T.vote(model.with_features(feats), nodes, model.features).collect()
    assert len(a) == len(b) > 0
    assert all(abs(r["Churn_Probability"] - a[r["CustomerID"]]["Churn_Probability"]) < 1e-12 for r in b)
    assert all(r["Predicted_Churn_Numeric"] == a[r["CustomerID"]]["Predicted_Churn_Numeric"] for r in b)


def test_importances_from_the_node_table_are_the_models(spark, fitted):
    model, _, path = fitted
    got = {(r["model"], r["feature"]): r["importance"] for r in T.importances(spark.read.parquet(os.path.join(path, "nodes"))).collect()}
    for m in model.MODELS:
        for f, w in model.importances(m):
            assert abs(got.get((m, f), 0.0) - w) < 1e-12, (m, f)


def test_package_is_checked_before_planning(spark, fitted, tmp_path, monkeypatch):
    model, feats, path = fitted
    again = M.EnsembleModel.load(path, stats_version="v1")
    assert again.score(feats).exceptAll(model.score(feats)).count() == 0
    with pytest.raises(M.ModelMismatch, match="stats_version"):
        M.EnsembleModel.load(path, stats_version="v2")
    with pytest.raises(ModelUnavailable):
        M.EnsembleModel.load(str(tmp_path))           # no package
    with pytest.raises(ModelUnavailable):
        score_with_model(feats, None)
    monkeypatch.setattr(M, "CLASS_CUT", 0.4)
    with pytest.raises(M.ModelMismatch, match="class_cut"):
        M.EnsembleModel.load(path)
    monkeypatch.undo()
    about = json.loads(spark.read.text(os.path.join(path, "package")).first()[0])
    about["features"] = about["features"][::-1]
    other = str(tmp_path / "other")
    model.save(other)
    spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(os.path.join(other, "package"))
    with pytest.raises(M.ModelMismatch, match="names"):
        M.EnsembleModel.load(other)


def test_a_descent_binds_the_rows_values_once(spark, fitted):
    model, feats, path = fitted
    shown = "spark.sql.debug.maxToStringFields"
    spark.conf.set(shown, "1000")
    try:
        voted = T.vote(model.with_features(feats), spark.read.parquet(os.path.join(path, "nodes")), model.features)
        plan = voted.select("Churn_Probability")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(shown)
    line = next(x for x in plan.splitlines() if "AS __trees" in x)
    before, _, inside = line.partition("lambdafunction(")
    assert "Tenure#" in before and "Tenure#" not in inside  # not built again at every step of every tree
