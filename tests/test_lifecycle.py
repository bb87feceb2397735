"""The end-to-end flows on a customer CSV that Spark derives from the driver tables."""

import json

import pytest

from paths import SF_SMALL
from retentio.operators import ml as M
from retentio.plans import lifecycle as L
from retentio.sources import sinks as K
from retentio.plans.mart import customer_mart


@pytest.fixture(scope="module")
def csv_path(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lc")
    p = str(d / "customers.csv")
    customer_mart(spark, SF_SMALL).coalesce(1).write.option("header", True).csv(p)
    return p


def test_analyze_report_and_export(spark, csv_path, tmp_path):
    res, scored = L.analyze_batch(spark, csv_path)
    r = json.loads(res.toJSON().first())
    n = scored.count()
    ra = r["risk_analysis"]
    assert ra["total_customers"] == n == ra["high_risk"] + ra["moderate_risk"] + ra["low_risk"]
    demo, demo_scored = L.analyze_batch(spark, None)
    assert demo_scored.count() == 100
    base = L.full_report(spark, csv_path, str(tmp_path))
    assert K.read_full_report(spark, base)["customers"].count() == n
    parts = [spark.read.option("header", True).csv(L.risk_export(spark, csv_path, str(tmp_path), lv)).count()
             for lv in ("high", "medium", "low")]
    assert sum(parts) == n                            # the three exports partition the table
    with pytest.raises(ValueError):
        L.risk_export(spark, csv_path, str(tmp_path), "extreme")


def test_train_and_score_with_saved_model(spark, csv_path, tmp_path):
    cfg = M.EnsembleConfig(rf_trees=5, rf_depth=4, gbt_iter=3, gbt_depth=2)
    rep = {r["label"]: r for r in L.train(spark, csv_path, str(tmp_path / "model"), cfg=cfg).collect()}
    assert 0.0 <= rep["accuracy"]["f1"] <= 1.0
    _, scored = L.analyze_batch(spark, csv_path, L.load_model(str(tmp_path / "model")))
    ps = [r["Churn_Probability"] for r in scored.select("Churn_Probability").collect()]
    assert ps and all(0.0 <= p <= 1.0 for p in ps)


def test_cli_benchmarks_and_analyze(capsys):
    from retentio.__main__ import main
    assert main(["benchmarks"]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert len(out) == 5 and json.loads(out[0])["metric"] == "Tenure (Months)"
