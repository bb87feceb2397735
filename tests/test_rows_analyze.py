from pyspark.sql import functions as F

from retentio.operators import analyze as A
from retentio.operators import rows as W

SCHEMA = ("CustomerID string, Churn_Probability double, Predicted_Churn string, Risk_Level string, "
          "Tenure double, SatisfactionScore double, CityTier double, Complain double, MaritalStatus string, "
          "Gender string, PreferredPaymentMode string, CashbackAmount double, DaySinceLastOrder double, "
          "OrderCount double, Predicted_Churn_Numeric int")


def _scored(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


ROWS = [("C1", 0.9, "Yes", "High Risk", 2.0, 1.0, 1.0, 1.0, "Single", "Male", "UPI", 10.0, 40.0, 3.0, 1),
        ("C2", 0.2, "No", "Low Risk", 13.0, 5.0, 0.0, 0.0, None, None, None, 100.0, 3.0, 9.0, 0),
        ("C3", 0.5, "No", "Moderate Risk", 0.0, 0.0, 3.0, 0.0, "Widowed", "Female", "", 5.0, 10.0, 1.0, 0)]


def test_ids_are_dense_and_ordered(spark):
    df = spark.range(0, 1234, numPartitions=7).withColumn("k", (F.col("id") * 7919) % 1234)
    out = W.with_row_ids(df, order_by=F.col("k")).collect()
    ids = sorted(int(r["Customer_ID"][5:]) for r in out)
    assert ids == list(range(1, 1235))
    assert all(int(r["Customer_ID"][5:]) == r["k"] + 1 for r in out)


def test_search_semantics(spark):
    s = _scored(spark, ROWS)
    assert {r["CustomerID"] for r in W.search(s, "HIGH", "CustomerID").collect()} == {"C1"}
    assert W.search(s, "", "CustomerID").count() == 3
    assert {r["CustomerID"] for r in W.search(s, "no", "CustomerID").collect()} == {"C2", "C3"}


def test_summary_with_single_high_row_and_empty(spark):
    s = _scored(spark, ROWS)
    r = A.risk_summary(s).collect()[0]
    assert (r["high_risk"], r["moderate_risk"], r["low_risk"], r["total_customers"]) == (1, 1, 1, 3)
    prof = {x["feature"]: x for x in A.high_risk_profile(s).collect()}
    assert prof["Tenure"]["std"] is None and prof["Tenure"]["median"] == 2.0
    empty = s.where("false")
    e = A.risk_summary(empty).collect()[0]
    assert e["total_customers"] == 0 and e["churn_rate"] == 0.0
    assert A.high_risk_profile(empty).count() == 0


def test_distributions_keep_zero_levels_and_open_domains(spark):
    s = _scored(spark, ROWS)
    d = {(r["dimension"], r["value"]): r["count"] for r in A.all_distributions(s).collect()}
    assert d[("tenure", "0-3")] == 2 and d[("tenure", "3-6")] == 0 and d[("tenure", "12+")] == 1
    assert d[("city_tier", "Tier 2")] == 1                # 0 -> tier 2
    assert d[("marital", "Single")] == 2 and d[("marital", "Widowed")] == 1
    assert d[("payment", "Credit Card")] == 2             # NULL and '' -> default
    assert d[("satisfaction", "3")] == 1                  # 0 -> 3
    assert d[("churn_status", "Churned")] == 1


def test_paging(spark):
    s = _scored(spark, ROWS)
    assert [r["CustomerID"] for r in W.page(s.unionByName(s.withColumn("CustomerID", F.concat("CustomerID", F.lit("x")))),
                                            20).collect()][:2] == ["C1", "C1x"]
    assert [r["CustomerID"] for r in W.page(s, 20, after="C1").collect()][0] > "C1"
    assert [tuple(r) for r in W.page_count(s, 20).collect()] == [(1, 1, s.count(), s.count(), 1)]
