import pytest
from pyspark.sql import functions as F

from retentio.operators import features as E
from retentio.operators import risk as R
from retentio.operators import validate as V
from retentio.operators.stats import Stats

PROBS = [0.0, 0.2999, 0.3, 0.3001, 0.5, 0.7, 0.7001, 1.0]


def test_both_band_rules(spark):
    df = spark.createDataFrame([(p,) for p in PROBS], "p double")
    got = [(r["b"], r["r"]) for r in df.select(R.band_batch(F.col("p")).alias("b"),
                                               R.band_record(F.col("p")).alias("r")).collect()]
    assert [g[0] for g in got] == ["Low Risk", "Low Risk", "Low Risk", "Moderate Risk", "Moderate Risk",
                                   "Moderate Risk", "High Risk", "High Risk"]
    assert [g[1] for g in got] == ["low", "low", "medium", "medium", "medium", "high", "high", "high"]


def _customers(spark):
    rows = [(str(i), t, 5.0, 10.0, 20.0, s, c, d, oc, cb)
            for i, (t, s, c, d, oc, cb) in enumerate([
                (3.0, 1, 1, 0.0, 2.0, 10.0), (6.0, 3, 0, 30.0, 12.0, 500.0), (9.0, 5, 0, 31.0, 5.0, 20000.0),
                (12.0, 4, 0, 61.0, 11.0, 40.0), (12.01, 2, 1, 5.0, 1.0, 0.0)])]
    return spark.createDataFrame(rows, "CustomerID string, Tenure double, WarehouseToHome double, "
                                       "HourSpendOnApp double, CouponUsed double, SatisfactionScore int, Complain int, "
                                       "DaySinceLastOrder double, OrderCount double, CashbackAmount double")


def test_features_segments_and_flags(spark):
    f = {r["CustomerID"]: r for r in E.business_features(_customers(spark), Stats.defaults()).collect()}
    assert f["0"]["EngagementIntensity"] == 10.0          # days 0 -> raw hours
    assert f["1"]["EngagementIntensity"] == 10.0 / 30.0
    assert f["2"]["HighRecencyFlag"] == 1 and f["1"]["HighRecencyFlag"] == 0
    assert f["0"]["LowSatisfactionFlag"] == 1 and f["0"]["ComplaintFlag"] == 1
    assert f["4"]["CustomerSegment"] == "Established"     # tenure 12.01 > 12
    assert f["3"]["CustomerSegment"] == "Active_New"      # tenure 12, 11 orders
    assert f["2"]["CustomerSegment"] == "New_LowEngagement"


def test_contributions_sum_to_one_and_labels(spark):
    imp = [(f"f{i}", 1.0 / (i + 1)) for i in range(8)] + [("Tenure", 0.05), ("DaySinceLastOrder", 0.04)]
    out = R.feature_contributions(_customers(spark), imp, top_n=10).collect()
    by = {}
    for r in out:
        by.setdefault(r["CustomerID"], []).append(r)
    for rows in by.values():
        assert abs(sum(r["Contribution"] for r in rows) - 1.0) < 1e-9
        rows.sort(key=lambda r: r["rank"])
        assert [r["Type"] for r in rows[:3]] == ["Top Risk Driver"] * 3
        assert [r["Type"] for r in rows[-3:]] == ["Mitigating Factor"] * 3
    assert {r["Feature"] for r in out} >= {"Daysincelastorder", "Tenure"}


def test_validation_messages(spark):
    df = spark.createDataFrame([
        ("a", 250.0, 400.0, 200000.0, 0.0, 6), ("b", -1.0, -2.0, -5.0, 3.0, 0), ("c", 5.0, 5.0, 10.0, 0.0, 3)],
        "CustomerID string, Tenure double, DaySinceLastOrder double, CashbackAmount double, OrderCount double, "
        "SatisfactionScore int")
    e = {r["CustomerID"]: r["errors"] for r in V.with_errors(df).collect()}
    assert len(e["a"]) == 5                      # high tenure/days/cashback, no orders, satisfaction 6
    assert "Satisfaction score must be between 1 and 5" not in e["b"]   # 0 reads as 3
    assert e["c"] == ["Cashback without orders - data inconsistency"]
    assert {r["CustomerID"] for r in V.accepted(df).collect()} == set()


@pytest.mark.parametrize("p,band", [(0.1, "low"), (0.5, "medium"), (0.9, "high")])
def test_impact(spark, p, band):
    df = spark.createDataFrame([(p, 10.0, 1000.0)], "Churn_Probability double, OrderCount double, "
                                                    "CashbackAmount double")
    r = R.business_impact(df).collect()[0]
    clv = 10 * 850 + 1000
    assert r["estimated_clv"] == clv and r["risk_level_record"] == band
    share = {"low": 0.05, "medium": 0.15, "high": 0.25}[band]
    assert abs(r["retention_budget"] - clv * share) < 1e-9
    assert abs(r["roi_retention"] - (clv * p - clv * share) / (clv * share)) < 1e-9
