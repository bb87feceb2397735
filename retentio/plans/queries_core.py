"""Registered queries: mart, profiling, cleaning, features, score, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.operators import clean as N
from retentio.operators import features as E
from retentio.operators import profile as PR
from retentio.operators import risk as R
from retentio.operators import validate as V
from retentio.operators.stats import column_stats
from retentio.plans import oracle_sql as O
from retentio.plans.catalog import cleaned, features, mart, register, scored, stable, widen

NUM, STR = O.NUM_COLS, O.STR_COLS
ALL = O.MART_COLS


# ---------------------------------------------------------------------------
# mart
# ---------------------------------------------------------------------------
@register("mart_customer_features", O.widen(O.round_all(O.chain("mart", "SELECT * FROM mart"),
                                                        ["Tenure", "WarehouseToHome", "HourSpendOnApp",
                                                         "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount",
                                                         "DaySinceLastOrder", "CashbackAmount"]), O.NULLABLE_INTS))
def q_mart(spark, sf):
    return widen(stable(mart(spark, sf)), O.NULLABLE_INTS)


# ---------------------------------------------------------------------------
# profiling
# ---------------------------------------------------------------------------
@register("p1_shape", O.chain("mart", f"SELECT count(*) AS n_rows, {len(ALL)} AS n_columns, "
                                      f"{len(NUM) + 1} AS n_numeric, {len(STR) + 1} AS n_string FROM mart"))
def q_p1(spark, sf):
    return PR.shape(mart(spark, sf))


def _describe_sql():
    parts = []
    for c in NUM:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column, count({c}) AS count, {O.rnd(f'avg({x})')} AS mean, "
            f"{O.rnd(f'stddev_samp({x})')} AS std, min({x}) AS min, "
            f"{O.rnd(f'quantile_cont({x}, 0.25)')} AS q25, {O.rnd(f'quantile_cont({x}, 0.5)')} AS q50, "
            f"{O.rnd(f'quantile_cont({x}, 0.75)')} AS q75, max({x}) AS max FROM mart")
    return O.chain("mart", "SELECT * REPLACE (" + O.rnd("min") + " AS min, " + O.rnd("max") + " AS max) FROM ("
                   + " UNION ALL ".join(parts) + ")")


@register("p2_describe", _describe_sql())
def q_p2(spark, sf):
    return stable(PR.describe(mart(spark, sf), NUM))


def _union(per_col: str, cols) -> str:
    return " UNION ALL ".join(per_col.format(c=c) for c in cols)


@register("p3_null_count", O.chain("mart", _union(
    "SELECT '{c}' AS column, count(*) - count({c}) AS null_count FROM mart", ALL)))
def q_p3(spark, sf):
    return PR.null_counts(mart(spark, sf))


@register("p4_null_pct", O.chain("mart", _union(
    "SELECT '{c}' AS column, " + O.rnd("(count(*) - count({c})) * 100.0 / count(*)") + " AS null_pct FROM mart",
    ALL)))
def q_p4(spark, sf):
    return stable(PR.null_percent(mart(spark, sf)))


@register("p5_distinct_values", O.chain("mart", _union(
    "SELECT DISTINCT '{c}' AS column, {c} AS value FROM mart", STR)))
def q_p5(spark, sf):
    return PR.distinct_values(mart(spark, sf), STR)


_VC_COLS = STR + ["Churn"]


@register("p6_value_counts", O.chain("mart", _union(
    "SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM mart "
    "WHERE {c} IS NOT NULL GROUP BY {c}", _VC_COLS)))
def q_p6(spark, sf):
    return PR.value_counts(mart(spark, sf), _VC_COLS)


@register("p7_value_share", O.chain("mart", "SELECT \"column\", value, count, " + O.rnd(
    "count * 100.0 / sum(count) OVER (PARTITION BY \"column\")") + " AS pct FROM (" + _union(
    "SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value, count(*) AS count FROM mart "
    "WHERE {c} IS NOT NULL GROUP BY {c}", _VC_COLS) + ")"))
def q_p7(spark, sf):
    return stable(PR.value_share(mart(spark, sf), _VC_COLS))


@register("p8_valid_count", O.chain("mart", _union(
    "SELECT '{c}' AS column, count({c}) AS n_valid, count({c}) > 0 AS has_valid FROM mart", ALL)))
def q_p8(spark, sf):
    return PR.valid_counts(mart(spark, sf))


@register("p10_dataset_rows", O.chain("scored", f"SELECT count(*) AS total_customers, "
                                                f"{len(ALL) + 6} AS total_features FROM scored"))
def q_p10(spark, sf):
    return PR.dataset_rows(scored(spark, sf))


@register("p11_class_ratio", O.chain("mart", "SELECT count(*) FILTER (WHERE Churn = 0) AS n_negative, "
                                             "count(*) FILTER (WHERE Churn = 1) AS n_positive, "
                                             + O.rnd("CAST(count(*) FILTER (WHERE Churn = 0) AS DOUBLE) / "
                                                     "nullif(count(*) FILTER (WHERE Churn = 1), 0)")
                                             + " AS imbalance_ratio FROM mart"))
def q_p11(spark, sf):
    return stable(PR.class_ratio(mart(spark, sf), "Churn"))


@register("p12_preview", O.widen(O.round_all(O.chain("mart", "SELECT * FROM mart ORDER BY CustomerID LIMIT 10"),
                                             ["Tenure", "WarehouseToHome", "HourSpendOnApp",
                                              "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount",
                                              "DaySinceLastOrder", "CashbackAmount"]), O.NULLABLE_INTS))
def q_p12(spark, sf):
    return widen(stable(PR.preview(mart(spark, sf), 10, "CustomerID")), O.NULLABLE_INTS)


# ---------------------------------------------------------------------------
# cleaning (N1-N21)
# ---------------------------------------------------------------------------
def _stats_sql():
    parts = []
    for c in NUM:
        parts.append(f"SELECT '{c}' AS column, 'numeric' AS kind, n_{c} AS n_valid, {O.rnd(f'mean_{c}')} AS mean, "
                     f"{O.rnd(f'med_{c}')} AS median, CAST(NULL AS VARCHAR) AS mode FROM stats")
    for c in STR:
        parts.append(f"SELECT '{c}' AS column, 'categorical' AS kind, n_{c} AS n_valid, CAST(NULL AS DOUBLE) AS mean, "
                     f"CAST(NULL AS DOUBLE) AS median, mode_{c} AS mode FROM stats")
    return O.chain("stats", " UNION ALL ".join(parts))


@register("n3_stats", _stats_sql())
def q_n3(spark, sf):
    return stable(column_stats(N.normalise_missing(mart(spark, sf))))


@register("n5_n7_rule_impute", O.round_all(O.chain("mart", f"""
SELECT CustomerID,
  coalesce(CAST(CashbackAmount AS DOUBLE), CAST(OrderCount AS DOUBLE) * {O.dbl(850.0)} * {O.dbl(0.1)}) AS CashbackAmount,
  coalesce(CAST(OrderCount AS DOUBLE), CASE WHEN Tenure IS NOT NULL THEN greatest({O.dbl(1.0)}, CAST(Tenure AS DOUBLE) / {O.dbl(3.0)}) END) AS OrderCount,
  coalesce(CAST(SatisfactionScore AS DOUBLE), CAST(CASE WHEN Complain = 1 THEN 2 WHEN DaySinceLastOrder > 30 THEN 3 ELSE 4 END AS DOUBLE)) AS SatisfactionScore
FROM mart"""), ["CashbackAmount", "OrderCount", "SatisfactionScore"]))
def q_n5(spark, sf):
    m = mart(spark, sf)
    out = N.rule_impute(N.coerce_numeric(N.normalise_missing(m), NUM))
    return stable(out.select("CustomerID", "CashbackAmount", "OrderCount", "SatisfactionScore"))


def _cleaned_body(strategy: str):
    return O.round_all(O.chain("cleaned", "SELECT * FROM cleaned", strategy), NUM)


@register("n21_batch_clean", _cleaned_body("median"))
def q_n21(spark, sf):
    return stable(cleaned(spark, sf)[0])


@register("n9_impute_median", O.round_all(O.chain("cleaned", "SELECT CustomerID, " + ", ".join(NUM) + " FROM cleaned"),
                                          NUM))
def q_n9m(spark, sf):
    return stable(cleaned(spark, sf)[0].select("CustomerID", *NUM))


@register("n9_impute_mean", O.round_all(O.chain("cleaned", "SELECT CustomerID, " + ", ".join(NUM) + " FROM cleaned",
                                                "mean"), NUM))
def q_n9a(spark, sf):
    return stable(cleaned(spark, sf, "mean")[0].select("CustomerID", *NUM))


@register("n10_impute_mode", O.chain("cleaned", "SELECT CustomerID, " + ", ".join(STR) + " FROM cleaned"))
def q_n10(spark, sf):
    return cleaned(spark, sf)[0].select("CustomerID", *STR)


def _n12_sql():
    sel = []
    for c in ALL:
        low = c.lower()
        is_num = c in NUM or c == "Churn"
        if any(k in low for k in ("tenure", "count", "number", "amount")):
            e = f"coalesce({c}, 0)" if is_num else f"coalesce({c}, '0')"
        elif "probability" in low:
            e = f"coalesce({c}, 0.0)" if is_num else f"coalesce({c}, '0.0')"
        elif "score" in low:
            e = f"coalesce({c}, 3)" if is_num else f"coalesce({c}, '3')"
        elif is_num:
            e = f"coalesce(CAST({c} AS VARCHAR), '')"
        else:
            e = f"coalesce({c}, '')"
        sel.append(f"{e} AS {c}")
    return O.chain("mart", "SELECT " + ", ".join(sel) + " FROM mart")


@register("n12_null_defaults", O.round_all(_n12_sql(), ["Tenure", "OrderAmountHikeFromlastYear", "OrderCount",
                                                        "CashbackAmount"]))
def q_n12(spark, sf):
    return stable(N.null_defaults_by_name(mart(spark, sf)))


def _n13_sql():
    sel = ["m.CustomerID"]
    for c in NUM:
        fill = f"s.med_{c}"
        if c == "CashbackAmount":
            oc = "coalesce(CAST(m.OrderCount AS DOUBLE), s.med_OrderCount)"  # OrderCount is filled first
            fill = f"greatest(s.med_{c}, {oc} * {O.dbl(85.0)})"
        typ = "INTEGER" if c in ("CityTier", "SatisfactionScore", "Complain", "NumberOfDeviceRegistered",
                                 "NumberOfAddress") else "DOUBLE"
        sel.append(f"CASE WHEN m.{c} IS NULL THEN CAST({fill} AS {typ}) ELSE m.{c} END AS {c}")
    for c in STR:
        sel.append(f"CASE WHEN m.{c} IS NULL OR m.{c} = '' THEN s.mode_{c} ELSE m.{c} END AS {c}")
    sel.append("m.Churn")
    return O.chain("stats", "SELECT " + ", ".join(sel) + " FROM mart m CROSS JOIN stats s")


@register("n13_record_clean", O.round_all(_n13_sql(), ["Tenure", "WarehouseToHome", "HourSpendOnApp",
                                                       "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount",
                                                       "DaySinceLastOrder", "CashbackAmount"]))
def q_n13(spark, sf):
    return stable(_record_cleaned(spark, sf))


@register("n16_synonyms", O.chain("mart", """SELECT CustomerID,
  CASE WHEN PreferredLoginDevice = 'Phone' THEN 'Mobile Phone' ELSE PreferredLoginDevice END AS PreferredLoginDevice,
  CASE WHEN PreferredPaymentMode = 'Cash on Delivery' THEN 'COD'
       WHEN PreferredPaymentMode = 'CC' THEN 'Credit Card' ELSE PreferredPaymentMode END AS PreferredPaymentMode,
  CASE WHEN PreferedOrderCat = 'Mobile' THEN 'Mobile Phone' ELSE PreferedOrderCat END AS PreferedOrderCat
FROM mart"""))
def q_n16(spark, sf):
    return N.merge_synonyms(mart(spark, sf)).select("CustomerID", "PreferredLoginDevice", "PreferredPaymentMode",
                                                    "PreferedOrderCat")


@register("n17_binary_codes", O.widen(O.chain("mart", """SELECT CustomerID,
  CAST(CASE WHEN d = 'Mobile Phone' THEN 0 WHEN d = 'Computer' THEN 1 END AS INTEGER) AS PreferredLoginDevice,
  CAST(CASE WHEN Gender = 'Male' THEN 0 WHEN Gender = 'Female' THEN 1 END AS INTEGER) AS Gender
FROM (SELECT *, CASE WHEN PreferredLoginDevice = 'Phone' THEN 'Mobile Phone' ELSE PreferredLoginDevice END AS d FROM mart)"""),
    ["PreferredLoginDevice"]))
def q_n17(spark, sf):
    out = N.binary_codes(N.merge_synonyms(mart(spark, sf))).select("CustomerID", "PreferredLoginDevice", "Gender")
    return widen(out, ["PreferredLoginDevice"])


@register("n18_clip", O.round_all(O.chain("cleaned", f"""SELECT CustomerID,
  greatest(OrderCount, {O.dbl(1.0)}) AS OrderCount, greatest(Tenure, {O.dbl(0.0)}) AS Tenure,
  greatest(DaySinceLastOrder, {O.dbl(0.0)}) AS DaySinceLastOrder FROM cleaned"""),
    ["OrderCount", "Tenure", "DaySinceLastOrder"]))
def q_n18(spark, sf):
    return stable(N.clip_lower(cleaned(spark, sf)[0]).select("CustomerID", "OrderCount", "Tenure",
                                                             "DaySinceLastOrder"))


@register("n19_missing_category", O.chain("mart", "SELECT CustomerID, " + ", ".join(
    f"coalesce({c}, 'Missing') AS {c}" for c in ["PreferredLoginDevice", "Gender", "MaritalStatus",
                                                 "PreferredPaymentMode", "PreferedOrderCat"])
    + ", 'Missing' AS CustomerSegment FROM mart"))
def q_n19(spark, sf):
    return N.missing_category(mart(spark, sf)).select("CustomerID", *FX.CATEGORICAL_COLUMNS)


# ---------------------------------------------------------------------------
# validation (V1-V9) over record-cleaned rows
# ---------------------------------------------------------------------------
def _record_cleaned(spark, sf):
    from retentio.plans.catalog import stats
    return N.record_clean(N.normalise_missing(mart(spark, sf)), stats(spark, sf))


def _falsy_sql(c, d):
    return f"(CASE WHEN {c} IS NULL OR CAST({c} AS DOUBLE) = 0 THEN {O.dbl(d)} ELSE CAST({c} AS DOUBLE) END)"


def _errors_sql():
    t, d, cb = _falsy_sql("Tenure", 0), _falsy_sql("DaySinceLastOrder", 0), _falsy_sql("CashbackAmount", 0)
    oc, s = _falsy_sql("OrderCount", 0), _falsy_sql("SatisfactionScore", 3)
    rules = [(f"{t} > 200", FX.MSG_TENURE_HIGH), (f"{t} < 0", FX.MSG_TENURE_NEG), (f"{d} > 365", FX.MSG_DAYS_HIGH),
             (f"{d} < 0", FX.MSG_DAYS_NEG), (f"{cb} > 100000", FX.MSG_CASHBACK_HIGH),
             (f"{cb} < 0", FX.MSG_CASHBACK_NEG), (f"{oc} = 0 AND {cb} > 0", FX.MSG_CASHBACK_NO_ORDERS),
             (f"{s} < 1 OR {s} > 5", FX.MSG_SATISFACTION_RANGE)]
    arr = ", ".join(f"CASE WHEN {c} THEN {O.q(m)} END" for c, m in rules)
    return f"list_filter([{arr}], lambda x: x IS NOT NULL)"


def _rc_chain(body):
    """The record-cleaned rows (n13) as a CTE named ``rc``."""
    return O.with_ctes(O.MART, O.stats_cte(), "rc AS (" + _n13_body() + ")", body=body)


def _n13_body():
    sql = _n13_sql()
    return sql[sql.index("SELECT m.CustomerID"):]


@register("v_row_errors", _rc_chain(f"SELECT CustomerID, {_errors_sql()} AS errors, "
                                    f"len({_errors_sql()}) = 0 AS is_valid FROM rc"))
def q_v1(spark, sf):
    return V.with_errors(_record_cleaned(spark, sf)).select("CustomerID", "errors", "is_valid")


@register("v_error_counts", _rc_chain(f"SELECT error, count(*) AS n FROM (SELECT unnest({_errors_sql()}) AS error "
                                      f"FROM rc) GROUP BY error"))
def q_v2(spark, sf):
    return V.error_counts(_record_cleaned(spark, sf))


@register("v_accepted", _rc_chain(f"SELECT CustomerID FROM rc WHERE len({_errors_sql()}) = 0"))
def q_v3(spark, sf):
    return V.accepted(_record_cleaned(spark, sf)).select("CustomerID")


# rows that break every rule, made alike on both sides from the customer id
_BROKEN = {"Tenure": {0: 250.0, 1: -3.0}, "DaySinceLastOrder": {2: 400.0, 3: -1.0},
           "CashbackAmount": {4: 200000.0, 5: -5.0, 6: 10.0}, "OrderCount": {6: 0.0}, "SatisfactionScore": {7: 9}}


def _broken_sql():
    sel = []
    for c in ["Tenure", "DaySinceLastOrder", "CashbackAmount", "OrderCount", "SatisfactionScore"]:
        whens = " ".join(f"WHEN {k} THEN {v}" for k, v in _BROKEN[c].items())
        sel.append(f"CASE CAST(CustomerID AS BIGINT) % 9 {whens} ELSE {c} END AS {c}")
    return f"broken AS (SELECT CustomerID, {', '.join(sel)} FROM rc)"


@register("v_broken_rows", O.with_ctes(O.MART, O.stats_cte(), "rc AS (" + _n13_body() + ")", _broken_sql(),
                                       body=f"SELECT CustomerID, {_errors_sql()} AS errors FROM broken"))
def q_v4(spark, sf):
    rows = _record_cleaned(spark, sf)
    kind = F.col("CustomerID").cast("long") % 9
    for c, values in _BROKEN.items():
        for k, v in values.items():
            rows = rows.withColumn(c, F.when(kind == k, F.lit(v)).otherwise(F.col(c)))
    return V.with_errors(rows).select("CustomerID", "errors")


# ---------------------------------------------------------------------------
# features and encoding
# ---------------------------------------------------------------------------
FEATS = ["ValueScore", "EngagementIntensity", "CashbackPerOrder", "OrderFrequency", "HighRecencyFlag",
         "LowSatisfactionFlag", "ComplaintFlag", "CustomerSegment"]


@register("e1_e8_features", O.round_all(O.chain("feat", "SELECT CustomerID, " + ", ".join(FEATS) + " FROM feat"),
                                        ["ValueScore", "EngagementIntensity", "CashbackPerOrder", "OrderFrequency"]))
def q_e1(spark, sf):
    return stable(features(spark, sf).select("CustomerID", *FEATS))


_DUMMIES = [f for f in FX.MODEL_FEATURES if any(f.startswith(c + "_") for c in FX.CATEGORICAL_COLUMNS)]


def _dummy_sql(f):
    for c in FX.CATEGORICAL_COLUMNS:
        if f.startswith(c + "_"):
            return f"CAST(coalesce({c}, 'Missing') = {O.q(f[len(c) + 1:])} AS INTEGER) AS \"{f}\""


@register("e10_one_hot_fixed", O.chain("feat", "SELECT CustomerID, " + ", ".join(_dummy_sql(f) for f in _DUMMIES)
                                        + " FROM feat"))
def q_e10f(spark, sf):
    return E.one_hot_fixed(features(spark, sf)).select("CustomerID", *[F.col(f"`{d}`") for d in _DUMMIES])


@register("e10_one_hot_batch", O.chain("feat", " UNION ALL ".join(
    f"SELECT CustomerID, '{c}_' || {c} AS feature FROM feat WHERE {c} <> (SELECT min({c}) FROM feat)"
    for c in FX.CATEGORICAL_COLUMNS)))
def q_e10b(spark, sf):
    return E.one_hot_batch(features(spark, sf))


def _align_sql():
    cols = []
    for f in FX.MODEL_FEATURES:
        if f in _DUMMIES:
            cols.append(_dummy_sql(f).replace("AS INTEGER)", "AS DOUBLE)"))
        else:
            cols.append(f"CAST({f} AS DOUBLE) AS {f}")
    return O.round_all(O.chain("feat", "SELECT CustomerID, " + ", ".join(cols) + " FROM feat"),
                       [f for f in FX.MODEL_FEATURES if f not in _DUMMIES])


@register("f9_align", _align_sql())
def q_f9(spark, sf):
    return stable(E.align_features(features(spark, sf), keep=("CustomerID",)))


# ---------------------------------------------------------------------------
# score (M14) and risk
# ---------------------------------------------------------------------------
@register("m14_scorecard", O.round_all(O.chain("scored", "SELECT CustomerID, Churn_Probability, "
                                                         "Predicted_Churn_Numeric FROM scored"),
                                       ["Churn_Probability"]))
def q_m14(spark, sf):
    return stable(scored(spark, sf).select("CustomerID", "Churn_Probability", "Predicted_Churn_Numeric"))


@register("s_scored_table", O.round_all(O.chain("scored", "SELECT * FROM scored"), O.SCORED_DOUBLES))
def q_scored(spark, sf):
    return stable(scored(spark, sf))


@register("r1_band", O.chain("scored", "SELECT CustomerID, Risk_Level FROM scored"))
def q_r1(spark, sf):
    return scored(spark, sf).select("CustomerID", "Risk_Level")


@register("r2_band_labels", O.chain("scored", "SELECT CustomerID, "
                                    + O.band_batch_sql("Churn_Probability", FX.BAND_REPORT)
                                    + " AS Risk_Label FROM scored"))
def q_r2(spark, sf):
    return scored(spark, sf).select("CustomerID", R.band_batch(F.col("Churn_Probability"), FX.BAND_REPORT)
                                    .alias("Risk_Label"))


@register("r3_band_record", O.chain("scored", "SELECT CustomerID, " + O.band_record_sql("Churn_Probability")
                                    + " AS risk_level FROM scored"))
def q_r3(spark, sf):
    return scored(spark, sf).select("CustomerID", R.band_record(F.col("Churn_Probability")).alias("risk_level"))


def _impact_sql():
    p = "Churn_Probability"
    clv = f"(OrderCount * {O.dbl(FX.AVG_ORDER_VALUE)} + CashbackAmount)"
    band = O.band_record_sql(p)
    share = (f"CASE WHEN {band} = 'low' THEN {O.dbl(0.05)} WHEN {band} = 'medium' THEN {O.dbl(0.15)} "
             f"ELSE {O.dbl(0.25)} END")
    inner = (f"SELECT CustomerID, {clv} AS estimated_clv, {band} AS risk_level, {clv} * {share} AS retention_budget, "
             f"{clv} * {p} AS potential_revenue_loss FROM scored")
    body = ("SELECT CustomerID, estimated_clv, risk_level, retention_budget, potential_revenue_loss, "
            "CASE WHEN retention_budget > 0 THEN (potential_revenue_loss - retention_budget) / retention_budget "
            f"ELSE {O.dbl(0.0)} END AS roi_retention FROM ({inner})")
    return O.round_all(O.chain("scored", body), ["estimated_clv", "retention_budget", "potential_revenue_loss",
                                                 "roi_retention"])


@register("r4_r7_impact", _impact_sql())
def q_r4(spark, sf):
    out = R.business_impact(scored(spark, sf))
    return stable(out.select("CustomerID", "estimated_clv", F.col("risk_level_record").alias("risk_level"),
                             "retention_budget", "potential_revenue_loss", "roi_retention"))


def _reco_sql():
    band = O.band_record_sql("Churn_Probability")
    arr = {k: "[" + ", ".join(O.q(t) for t in v) + "]" for k, v in FX.RECORD_RECOMMENDATIONS.items()}
    return O.chain("scored", f"SELECT CustomerID, CASE WHEN {band} = 'low' THEN {arr['low']} WHEN {band} = 'medium' "
                             f"THEN {arr['medium']} ELSE {arr['high']} END AS recommendations FROM scored")


@register("r8_recommendations", _reco_sql())
def q_r8(spark, sf):
    return scored(spark, sf).select("CustomerID", R.record_recommendations(F.col("Churn_Probability"))
                                    .alias("recommendations"))


@register("r9_recommendation", O.chain("scored", "SELECT CustomerID, Retention_Recommendation FROM scored"))
def q_r9(spark, sf):
    return scored(spark, sf).select("CustomerID", "Retention_Recommendation")
