from pyspark.sql import functions as F

from retentio.operators import clean as N
from retentio.operators.stats import Stats

SCHEMA = ("CustomerID string, Tenure double, OrderCount double, CashbackAmount double, SatisfactionScore int, "
          "Complain int, DaySinceLastOrder double, Gender string")


def _rows(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_rule_imputation_edges(spark):
    df = _rows(spark, [
        ("a", 9.0, 4.0, None, None, 1, 31.0, "Male"),     # sat -> 2 (complained); cashback -> 4*85
        ("b", 9.0, None, None, None, 0, 31.0, "Male"),    # sat -> 3; order count -> max(1, 3); cashback stays NULL
        ("c", 1.5, None, 10.0, None, 0, 30.0, "Male"),    # sat -> 4; order count -> max(1, .5) = 1
        ("d", None, None, None, None, None, None, None),  # nothing to go on
    ])
    out = {r["CustomerID"]: r for r in N.rule_impute(N.coerce_numeric(df, ["Tenure", "OrderCount", "CashbackAmount",
                                                                             "SatisfactionScore", "Complain",
                                                                             "DaySinceLastOrder"])).collect()}
    assert out["a"]["SatisfactionScore"] == 2.0 and out["a"]["CashbackAmount"] == 340.0
    assert out["b"]["SatisfactionScore"] == 3.0 and out["b"]["OrderCount"] == 3.0
    assert out["b"]["CashbackAmount"] is None
    assert out["c"]["SatisfactionScore"] == 4.0 and out["c"]["OrderCount"] == 1.0
    assert out["d"]["OrderCount"] is None and out["d"]["SatisfactionScore"] == 4.0


def test_batch_clean_leaves_no_nulls_and_keeps_values(spark):
    df = _rows(spark, [
        ("a", 5.0, 2.0, 100.0, 3, 0, 10.0, "Male"),
        ("b", float("nan"), None, None, None, None, float("inf"), None),
        ("c", 7.0, 8.0, 50.0, 5, 1, 40.0, "Female"),
    ])
    out, st = N.batch_clean(df)
    rows = {r["CustomerID"]: r for r in out.collect()}
    assert all(v is not None for r in rows.values() for v in r.asDict().values())
    assert rows["a"]["Tenure"] == 5.0 and rows["a"]["CashbackAmount"] == 100.0  # untouched cells
    assert rows["b"]["Tenure"] == 6.0            # median of 5, 7
    assert rows["b"]["Gender"] == "Female"       # mode tie -> lowest value
    again, _ = N.batch_clean(out, st)
    assert sorted(again.collect()) == sorted(out.collect())  # imputing twice equals once


def test_clip_and_null_defaults(spark):
    df = _rows(spark, [("a", -1.0, 0.0, 1.0, None, None, -1.0, None)])
    c = N.clip_lower(df).collect()[0]
    assert (c["Tenure"], c["OrderCount"], c["DaySinceLastOrder"]) == (0.0, 1.0, 0.0)
    d = N.null_defaults_by_name(df).collect()[0]
    assert d["SatisfactionScore"] == 3 and d["Gender"] == "" and d["Complain"] == ""


def test_record_clean_cashback_rule(spark):
    st = Stats.defaults()
    df = _rows(spark, [("a", None, 100.0, None, None, None, None, "")])
    r = N.record_clean(df, st).collect()[0]
    assert r["CashbackAmount"] == 8500.0     # max(5000, 100 * 85)
    assert r["Tenure"] == 12.0 and r["Gender"] == "Male"


def test_synonyms_and_codes(spark):
    df = spark.createDataFrame([("Phone", "CC", "Mobile", "Female"), ("Computer", "Cash on Delivery", "Fashion", "Male")],
                               "PreferredLoginDevice string, PreferredPaymentMode string, PreferedOrderCat string, "
                               "Gender string")
    s = N.merge_synonyms(df).collect()
    assert s[0]["PreferredLoginDevice"] == "Mobile Phone" and s[0]["PreferredPaymentMode"] == "Credit Card"
    assert s[1]["PreferredPaymentMode"] == "COD" and s[0]["PreferedOrderCat"] == "Mobile Phone"
    b = N.binary_codes(N.merge_synonyms(df)).collect()
    assert (b[0]["PreferredLoginDevice"], b[0]["Gender"]) == (0, 1)
    assert N.yes_no_to_int(F.lit("Yes")) is not None


def test_record_clean_uses_imputed_order_count(spark):
    st = Stats.defaults()
    st.median["OrderCount"] = 100.0
    df = _rows(spark, [("a", 5.0, None, None, 3, 0, 5.0, "Male")])
    r = N.record_clean(df, st).collect()[0]
    assert r["OrderCount"] == 100.0 and r["CashbackAmount"] == 8500.0  # max(5000, 100 * 85)
