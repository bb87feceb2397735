import os

import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from retentio.operators import ml as M
from retentio.operators.clean import normalise_missing
from retentio.operators.stats import compute_stats
from retentio.plans.batch import clean_customers, score_customers
from retentio.plans.mart import customer_mart
from retentio.streaming.scoring import run_stream_scoring, scratch_dir


@pytest.fixture(scope="module")
def mart(spark):
    return customer_mart(spark, SF_SMALL).persist()


def test_scored_bands_partition_the_table(spark, mart):
    cl, st = clean_customers(mart)
    s = score_customers(cl, st)
    n = s.count()
    bands = {r["Risk_Level"]: r["count"] for r in s.groupBy("Risk_Level").count().collect()}
    assert sum(bands.values()) == n and set(bands) == {"Low Risk", "Moderate Risk", "High Risk"}
    assert s.where(F.col("Churn_Probability").isNull() | (F.col("Churn_Probability") < 0) |
                   (F.col("Churn_Probability") > 1)).count() == 0


def test_stream_equals_batch(spark, mart):
    from retentio.streaming.scoring import load_stats, save_stats
    base = scratch_dir(spark, "test-s10")
    save_stats(compute_stats(normalise_missing(mart)), spark, os.path.join(base, "stats-v1"))
    stats = load_stats(spark, os.path.join(base, "stats-v1"))  # the versioned statistics the stream uses
    src = os.path.join(base, "in")
    mart.write.json(src)
    out = run_stream_scoring(spark, src, mart.schema, stats, os.path.join(base, "out"), os.path.join(base, "ck"),
                             rejected_dir=os.path.join(base, "bad"))
    from retentio.operators import validate as V
    from retentio.streaming.scoring import imputed_records
    records = imputed_records(mart, stats)
    good = V.accepted(records)
    batch = score_customers(good, stats)
    cols = sorted(batch.columns)
    assert out.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(out.select(cols)).count() == 0
    bad = spark.read.json(os.path.join(base, "bad"))
    assert bad.count() == records.count() - good.count() > 0
    assert out.join(bad, "CustomerID").count() == 0          # rejected records are never scored


def test_ensemble_save_load_and_metrics(spark, mart, tmp_path):
    from retentio.operators.features import align_features, business_features
    cl, st = clean_customers(mart)
    feats = align_features(business_features(cl, st), keep=("CustomerID", "Churn"))
    cfg = M.EnsembleConfig(rf_trees=5, rf_depth=4, gbt_iter=3, gbt_depth=2)
    model = M.fit_ensemble(feats, cfg=cfg, weight_col=None)
    scored = model.score(feats)
    ps = [r["Churn_Probability"] for r in scored.select("Churn_Probability").collect()]
    assert all(0.0 <= p <= 1.0 for p in ps)
    path = str(tmp_path / "model")
    model.save(path)
    again = M.EnsembleModel.load(path).score(feats)
    a = sorted((r["CustomerID"], r["Churn_Probability"]) for r in scored.collect())
    b = sorted((r["CustomerID"], r["Churn_Probability"]) for r in again.collect())
    assert a == b
    rep = {r["label"]: r for r in M.classification_report(scored).collect()}
    acc = M.accuracy(scored).collect()[0]["accuracy"]
    assert abs(rep["accuracy"]["f1"] - acc) < 1e-12
    top = M.importance_table(model, 15).groupBy("model").count().collect()  # the fifteen most important of each model
    assert {r["model"]: r["count"] for r in top} == dict.fromkeys(M.EnsembleModel.MODELS, 15)
    # M6: the soft vote is the mean of the three positive-class probabilities
    from pyspark.ml.functions import vector_to_array
    parts = model.pipeline_model.transform(feats).select(
        "CustomerID", *[vector_to_array(c)[1].alias(c) for c in M.EnsembleModel.PROB_COLS]).collect()
    mean = {r["CustomerID"]: sum(r[c] for c in M.EnsembleModel.PROB_COLS) / 3 for r in parts}
    assert all(abs(mean[cid] - p) < 1e-12 for cid, p in a)


def test_weights_and_split(spark, mart):
    w = mart.select(M.class_weights(mart).alias("w"), "Churn")
    tot = w.agg(F.sum("w")).collect()[0][0]
    assert abs(tot - mart.count()) < 1e-6          # balanced weights sum to n
    shares = mart.select(M.hash_split(F.col("CustomerID")).alias("s")).groupBy("s").count().collect()
    assert {r["s"] for r in shares} == {"train", "test"}


def test_stratified_split_is_exact_per_class(spark):
    rows = [(i, 1 if i % 4 == 0 else 0) for i in range(2003)]
    df = spark.createDataFrame(rows, "id long, y int")
    out = M.stratified_split(df, "y", train_pct=80, row_hash=M.lehmer_hash(F.col("id"))).collect()
    for cls in (0, 1):
        members = sorted(((r["id"] + 42) % 2147483647 * 48271 % 2147483647, r["split"]) for r in out if r["y"] == cls)
        n = len(members)
        k = n - (n * 20 + 99) // 100
        assert [s for _, s in members] == ["train"] * k + ["test"] * (n - k)   # brute force: smallest k hashes
