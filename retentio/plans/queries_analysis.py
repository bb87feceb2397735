"""Registered queries: explanations (R10-R19), aggregations (A1-A23), rows (F, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.operators import analyze as A
from retentio.operators import risk as R
from retentio.operators import rows as W
from retentio.plans import oracle_sql as O
from retentio.plans.catalog import _shared, register, scored, stable

P = "Churn_Probability"
# A stated list of driver weights (a parameter of the queries below): more than the
# ten that are kept, so that the cut, all three labels and the multipliers are at work.
IMPORTANCES = [("Tenure", 0.16), ("CashbackAmount", 0.12), ("DaySinceLastOrder", 0.11), ("Complain", 0.10),
               ("SatisfactionScore", 0.09), ("WarehouseToHome", 0.08), ("NumberOfAddress", 0.07),
               ("OrderAmountHikeFromlastYear", 0.07), ("OrderCount", 0.06), ("CouponUsed", 0.05),
               ("HourSpendOnApp", 0.05), ("CityTier", 0.04)]


# ---------------------------------------------------------------------------
# R10-R19
# ---------------------------------------------------------------------------
def _contrib_sql():
    bench = {name: b for name, b, _ in FX.BENCHMARKS}
    entries = []
    for feat, w in sorted(IMPORTANCES, key=lambda t: -t[1]):
        v = f"coalesce(TRY_CAST(CAST({feat} AS VARCHAR) AS DOUBLE), {O.dbl(1.0)})"
        if "DaySinceLastOrder" in feat:
            b = bench["Days Since Last Order"]
            m = f"CASE WHEN {v} > {O.dbl(b)} THEN {v} / {O.dbl(b)} ELSE {O.dbl(1.0)} END"
        elif "Tenure" in feat:
            b = bench["Tenure (Months)"]
            m = f"CASE WHEN {v} < {O.dbl(b)} THEN 1 + ({O.dbl(b)} - {v}) / {O.dbl(b)} ELSE {O.dbl(1.0)} END"
        elif "SatisfactionScore" in feat:
            b = bench["Satisfaction Score"]
            m = f"CASE WHEN {v} < {O.dbl(b)} THEN 1 + ({O.dbl(b)} - {v}) * {O.dbl(0.5)} ELSE {O.dbl(1.0)} END"
        elif "CashbackAmount" in feat:
            b = bench["Cashback Amount (₹)"]
            m = f"CASE WHEN {v} < {O.dbl(b)} THEN 1 + ({O.dbl(b)} - {v}) / {O.dbl(b)} ELSE {O.dbl(1.0)} END"
        else:
            m = O.dbl(1.0)
        entries.append(f"SELECT CustomerID, {O.q(feat.title())} AS Feature, "
                       f"{O.dbl(w)} * greatest({O.dbl(0.1)}, {m}) AS raw FROM scored")
    body = f"""
SELECT CustomerID, Feature, CAST(rk AS INTEGER) AS rank,
  {O.rnd("CASE WHEN total > 0 THEN raw / total ELSE raw END")} AS Contribution,
  CASE WHEN rk <= 3 THEN 'Top Risk Driver' WHEN n > 5 AND rk > n - 3 THEN 'Mitigating Factor'
       ELSE 'Contributing Factor' END AS Type
FROM (
  SELECT *, sum(raw) OVER (PARTITION BY CustomerID) AS total, count(*) OVER (PARTITION BY CustomerID) AS n
  FROM (SELECT *, row_number() OVER (PARTITION BY CustomerID ORDER BY raw DESC, Feature ASC) AS rk
        FROM ({" UNION ALL ".join(entries)}))
  WHERE rk <= {FX.CONTRIBUTION_TOP_N}
)"""
    return O.chain("scored", body)


@register("r10_contribution", _contrib_sql())
def q_r10(spark, sf):
    return stable(R.feature_contributions(scored(spark, sf), IMPORTANCES))


def _r12_sql():
    whole = _contrib_sql()
    head = whole[:whole.index("SELECT CustomerID, Feature, CAST(rk")]
    labels = ", ".join(f"{O.q(k)}: {O.q(v)}" for k, v in FX.DRIVER_LABELS.items())
    rest = whole[whole.index("SELECT CustomerID, Feature, CAST(rk"):]
    return (f"{head}SELECT CustomerID, Feature AS top_driver, coalesce(map_extract_value(MAP {{{labels}}}, lower(Feature)), "
            f"Feature) AS top_driver_label FROM ({rest}) WHERE rank = 1")


@register("r12_r14_top_driver", _r12_sql())
def q_r12(spark, sf):
    s = scored(spark, sf)
    td = R.top_driver(s, IMPORTANCES)
    return s.select("CustomerID", td.alias("top_driver"), R.driver_label(td).alias("top_driver_label"))


_PROFILE = ["Tenure (Months)", "Cashback Amount (₹)", "Days Since Last Order", "Satisfaction Score",
            "Warehouse Distance (km)", "Complain", "Total Orders"]


@register("r11_profile", O.round_all(O.chain("scored", """SELECT CustomerID,
  Tenure AS "Tenure (Months)", CashbackAmount AS "Cashback Amount (₹)", DaySinceLastOrder AS "Days Since Last Order",
  SatisfactionScore AS "Satisfaction Score", WarehouseToHome AS "Warehouse Distance (km)", Complain AS "Complain",
  OrderCount AS "Total Orders" FROM scored"""), _PROFILE))
def q_r11(spark, sf):
    return stable(R.current_profile(scored(spark, sf)))


def _factor_sql():
    return f"""CASE WHEN Tenure < 6 THEN {O.q(FX.FACTOR_SHORT_TENURE)}
  WHEN DaySinceLastOrder > 60 THEN {O.q(FX.FACTOR_LONG_INACTIVITY)}
  WHEN SatisfactionScore <= 2 THEN {O.q(FX.FACTOR_LOW_SATISFACTION)}
  WHEN Complain = 1 THEN {O.q(FX.FACTOR_COMPLAINTS)}
  WHEN Tenure < 12 THEN {O.q(FX.FACTOR_MEDIUM_TENURE)}
  WHEN DaySinceLastOrder > 30 THEN {O.q(FX.FACTOR_RECENT_INACTIVITY)}
  WHEN SatisfactionScore = 3 THEN {O.q(FX.FACTOR_AVG_SATISFACTION)}
  WHEN OrderCount < 3 THEN {O.q(FX.FACTOR_LOW_ORDERS)}
  WHEN CashbackAmount < 50 THEN {O.q(FX.FACTOR_LOW_REWARD)}
  WHEN Churn_Probability > 0.7 THEN {O.q(FX.FACTOR_FALLBACK_HIGH)}
  WHEN Churn_Probability > 0.4 THEN {O.q(FX.FACTOR_FALLBACK_MEDIUM)}
  ELSE {O.q(FX.FACTOR_FALLBACK_LOW)} END"""


def _r13_sql():
    drivers = _r12_sql()
    head = drivers[:drivers.index("SELECT CustomerID, Feature AS top_driver")]
    rest = drivers[drivers.index("SELECT CustomerID, Feature AS top_driver"):]
    return (f"{head}SELECT s.CustomerID, s.factor AS primary_risk_factor, t.top_driver_label AS with_driver FROM "
            f"(SELECT CustomerID, {_factor_sql()} AS factor FROM scored) s JOIN ({rest}) t ON t.CustomerID = s.CustomerID")


@register("r13_primary_factor", _r13_sql())
def q_r13(spark, sf):
    s = scored(spark, sf)
    return s.select("CustomerID", R.primary_risk_factor().alias("primary_risk_factor"),
                    R.primary_risk_factor(driver=R.top_driver(s, IMPORTANCES)).alias("with_driver"))


def _kpi_sql():
    def prog(c, t):
        return f"least({c} / {O.dbl(t)} * 100, {O.dbl(100.0)})"
    rows = [
        ("churn_risk", "floor(Churn_Probability * 1000 + 0.5) / 10", "<15%", f"Churn_Probability > {O.dbl(0.15)}",
         "CAST(NULL AS DOUBLE)"),
        ("tenure", "Tenure", ">12 mo", f"Tenure > {O.dbl(12.0)}", prog("Tenure", 12.0)),
        ("days_since_order", "DaySinceLastOrder", "<7 d", f"DaySinceLastOrder > {O.dbl(7.0)}",
         prog("DaySinceLastOrder", 30.0)),
        ("satisfaction", "SatisfactionScore", ">4/5", f"SatisfactionScore > {O.dbl(4.0)}",
         f"SatisfactionScore / {O.dbl(5.0)} * 100"),
    ]
    parts = [f"SELECT CustomerID, '{m}' AS metric, CAST({cur} AS DOUBLE) AS current, '{t}' AS target, "
             f"CASE WHEN {cond} THEN 'Above Target' ELSE 'Below Target' END AS comparison, "
             f"CAST({pg} AS DOUBLE) AS progress FROM scored" for m, cur, t, cond, pg in rows]
    return O.round_all(O.chain("scored", " UNION ALL ".join(parts)), ["current", "progress"])


@register("r15_kpi", _kpi_sql())
def q_r15(spark, sf):
    return stable(R.kpi_comparison(scored(spark, sf)))


def _exec_sql():
    band = O.band_record_sql("Churn_Probability")
    cols = []
    for i, name in enumerate(["category", "risk_wording", "advice"]):
        w = FX.EXEC_WORDING
        cols.append(f"CASE WHEN {band} = 'high' THEN {O.q(w['high'][i])} WHEN {band} = 'medium' "
                    f"THEN {O.q(w['medium'][i])} ELSE {O.q(w['low'][i])} END AS {name}")
    return O.chain("scored", "SELECT CustomerID, " + ", ".join(cols) + " FROM scored")


@register("r16_exec_wording", _exec_sql())
def q_r16(spark, sf):
    return scored(spark, sf).select("CustomerID", *R.exec_wording())


@register("r17_percentages", O.round_all(O.chain("scored", "SELECT CustomerID, floor(Churn_Probability * 1000 + 0.5) / 10 "
                                                 "AS churn_risk_pct, floor((1 - Churn_Probability) * 1000 + 0.5) / 10 "
                                                 "AS retention_pct FROM scored"), ["churn_risk_pct", "retention_pct"]))
def q_r17(spark, sf):
    p = F.col(P)
    return stable(scored(spark, sf).select("CustomerID", R.percent_one_decimal(p).alias("churn_risk_pct"),
                                           R.percent_one_decimal(1 - p).alias("retention_pct")))


# ---------------------------------------------------------------------------
# aggregations
# ---------------------------------------------------------------------------
_SUMMARY = f"""SELECT count(*) AS total_customers,
  count(*) FILTER (WHERE Churn_Probability > 0.7) AS high_risk,
  count(*) FILTER (WHERE Churn_Probability > 0.3 AND Churn_Probability <= 0.7) AS moderate_risk,
  count(*) FILTER (WHERE Churn_Probability <= 0.3) AS low_risk,
  {O.rnd("avg(Churn_Probability)")} AS average_probability,
  CAST(sum(Predicted_Churn_Numeric) AS BIGINT) AS total_predicted_churn,
  {O.rnd("CASE WHEN count(*) > 0 THEN sum(Predicted_Churn_Numeric) / count(*) ELSE 0.0 END")} AS churn_rate
FROM scored"""


@register("a1_risk_distribution", O.chain("scored", _SUMMARY))
def q_a1(spark, sf):
    return stable(A.risk_summary(scored(spark, sf)))


def _profile_sql():
    parts = []
    for f in A.PROFILE_FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        parts.append(f"SELECT '{f}' AS feature, {O.rnd(f'avg({x})')} AS mean, {O.rnd(f'median({x})')} AS median, "
                     f"{O.rnd(f'stddev_samp({x})')} AS std FROM scored WHERE Churn_Probability > 0.7 "
                     f"HAVING count(*) > 0")
    return O.chain("scored", " UNION ALL ".join(parts))


@register("a5_high_risk_profile", _profile_sql())
def q_a5(spark, sf):
    return stable(A.high_risk_profile(scored(spark, sf)))


@register("a6_high_risk_segment", O.chain("scored", f"""SELECT
  count(*) FILTER (WHERE Churn_Probability > 0.7) AS high_risk_count,
  {O.rnd("coalesce(avg(Churn_Probability) FILTER (WHERE Churn_Probability > 0.7), 0.0)")} AS high_risk_avg_probability,
  {O.rnd("coalesce(sum(Churn_Probability) FILTER (WHERE Churn_Probability > 0.7) * 850.0, 0.0)")} AS high_risk_loss,
  {O.rnd("coalesce(sum(Churn_Probability) * 850.0, 0.0)")} AS expected_loss
FROM scored"""))
def q_a6(spark, sf):
    return stable(A.high_risk_segment(scored(spark, sf)))


RUN_DATE = "01/01/2026"  # an argument of the report


@register("a8_summary_report", O.chain("scored", f"""SELECT CAST(pos AS INTEGER) AS position, Metric, Value FROM (
  SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS pos,
         unnest([{", ".join(O.q(m) for m in FX.SUMMARY_METRICS[:8])}]) AS Metric,
         unnest([CAST(n AS VARCHAR), printf('%.2f%%', avgp * 100), printf('%.2f%%', rate * 100),
                 CAST(hi AS VARCHAR), CAST(mid AS VARCHAR), CAST(lo AS VARCHAR),
                 '₹' || format('{{:,.2f}}', loss), '{RUN_DATE}']) AS Value
  FROM (SELECT count(*) AS n, coalesce(avg(Churn_Probability), 0.0) AS avgp,
               CASE WHEN count(*) > 0 THEN sum(Predicted_Churn_Numeric) / count(*) ELSE 0.0 END AS rate,
               count(*) FILTER (WHERE Churn_Probability > 0.7) AS hi,
               count(*) FILTER (WHERE Churn_Probability > 0.3 AND Churn_Probability <= 0.7) AS mid,
               count(*) FILTER (WHERE Churn_Probability <= 0.3) AS lo,
               coalesce(sum(Churn_Probability) * 850.0, 0.0) AS loss FROM scored))"""))
def q_a8(spark, sf):
    return A.summary_report(scored(spark, sf), run_date=RUN_DATE)


def _rate_sql(key):
    return O.round_all(O.chain("scored", (
        f"SELECT {key}, avg(CAST(Churn AS DOUBLE)) AS churn_rate, count(*) AS n FROM scored "
        f"WHERE {key} IS NOT NULL GROUP BY {key}")), ["churn_rate"] + ([key] if key in O.NUM_COLS else []))


for _key, _name in [("Complain", "a10_churn_rate_by_complain"), ("SatisfactionScore", "a10_churn_rate_by_satisfaction"),
                    ("MaritalStatus", "a10_churn_rate_by_marital")]:
    def _mk(key):
        def q(spark, sf):
            return stable(A.churn_rate_by(scored(spark, sf), key))
        return q
    register(_name, _rate_sql(_key))(_mk(_key))


RATE_KEYS = ["Complain", "SatisfactionScore", "MaritalStatus"]


def _rate_sets_sql():
    chosen = " ".join(f"WHEN grouping({k}) = 0 THEN {{}}" for k in RATE_KEYS)
    names = chosen.format(*(O.q(k) for k in RATE_KEYS))
    values = chosen.format(*(f"CAST({k} AS VARCHAR)" for k in RATE_KEYS))
    return O.chain("scored", f"""SELECT dimension, value, {O.rnd("rate")} AS churn_rate, n FROM (
  SELECT CASE {names} END AS dimension, CASE {values} END AS value, avg(CAST(Churn AS DOUBLE)) AS rate, count(*) AS n
  FROM scored GROUP BY GROUPING SETS ({", ".join(f"({k})" for k in RATE_KEYS)})) WHERE value IS NOT NULL""")


@register("a10_churn_rate_sets", _rate_sets_sql())
def q_a10s(spark, sf):
    return stable(A.churn_rate_sets(scored(spark, sf), RATE_KEYS))


def _dash_values_sql():
    def falsy(c, d):
        return (f"CASE WHEN {c} IS NULL OR CAST({c} AS VARCHAR) = '' OR TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) = 0 "
                f"THEN '{d}' ELSE CAST({c} AS VARCHAR) END")
    ten = "coalesce(CAST(Tenure AS DOUBLE), 0.0)"
    sat = "coalesce(CASE WHEN CAST(SatisfactionScore AS DOUBLE) <> 0 THEN CAST(SatisfactionScore AS DOUBLE) END, 3.0)"
    tier = "coalesce(CASE WHEN CAST(CityTier AS DOUBLE) <> 0 THEN CAST(CityTier AS DOUBLE) END, 2.0)"

    def num_text(x):
        return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    return {
        "payment": (f"CASE {falsy('PreferredPaymentMode', 'Credit Card')} WHEN 'CC' THEN 'Credit Card' "
                    f"WHEN 'Cash on Delivery' THEN 'COD' ELSE {falsy('PreferredPaymentMode', 'Credit Card')} END"),
        "tenure": (f"CASE WHEN {ten} <= 3 THEN '0-3' WHEN {ten} <= 6 THEN '3-6' WHEN {ten} <= 9 THEN '6-9' "
                   f"WHEN {ten} <= 12 THEN '9-12' ELSE '12+' END"),
        "city_tier": f"'Tier ' || {num_text(tier)}",
        "marital": falsy("MaritalStatus", "Single"),
        "gender": falsy("Gender", "Male"),
        "satisfaction": num_text(f"floor({sat} + 0.5)"),
        "complaints": "CASE WHEN coalesce(CAST(Complain AS DOUBLE), 0.0) = 1 THEN 'Complaints' ELSE 'No Complaints' END",
        "churn_status": ("CASE WHEN lower(CAST(Predicted_Churn AS VARCHAR)) IN ('yes', '1', 'true') THEN 'Churned' "
                         "ELSE 'Retained' END"),
    }


def _dist_sql(dim):
    v = _dash_values_sql()[dim]
    counts = f"SELECT {v} AS value, count(*) AS count FROM scored GROUP BY 1"
    if dim in A.DOMAINS:
        dom = " UNION ALL ".join(f"SELECT {O.q(x)} AS value" for x in A.DOMAINS[dim])
        counts = (f"SELECT coalesce(d.value, c.value) AS value, CAST(coalesce(c.count, 0) AS BIGINT) AS count "
                  f"FROM ({dom}) d FULL OUTER JOIN ({counts}) c ON d.value = c.value")
    body = (f"SELECT value, count, round(count * 100.0 / sum(count) OVER (), 1) AS share, "
            f"count * 100.0 / max(count) OVER () AS height FROM ({counts})")
    return O.round_all(O.chain("scored", body), ["share", "height"])


for _dim, _name in [("payment", "a12_payment"), ("tenure", "a13_tenure"), ("city_tier", "a14_city_tier"),
                    ("marital", "a15_marital"), ("gender", "a16_gender"), ("satisfaction", "a17_satisfaction"),
                    ("complaints", "a18_complaints"), ("churn_status", "a19_churn_status")]:
    def _mkd(dim):
        def q(spark, sf):
            return stable(A.distribution(scored(spark, sf), dim))
        return q
    register(_name, _dist_sql(_dim))(_mkd(_dim))


def _a20_sql():
    st = _dash_values_sql()["marital"]
    band = ("CASE WHEN contains(r, 'High') THEN 'high' WHEN contains(r, 'Moderate') THEN 'medium' ELSE 'low' END")
    g = (f"SELECT MaritalStatus, count(*) FILTER (WHERE b = 'low') AS low, count(*) FILTER (WHERE b = 'medium') "
         f"AS medium, count(*) FILTER (WHERE b = 'high') AS high FROM (SELECT {st} AS MaritalStatus, {band} AS b "
         f"FROM (SELECT *, coalesce(Risk_Level, 'Low Risk') AS r FROM scored)) GROUP BY 1")
    body = (f"SELECT MaritalStatus, low, medium, high, low + medium + high AS total, "
            + ", ".join(f"{b} * 100.0 / nullif(low + medium + high, 0) AS {b}_pct" for b in ("low", "medium", "high"))
            + f" FROM ({g})")
    return O.round_all(O.chain("scored", body), ["low_pct", "medium_pct", "high_pct"])


@register("a20_marital_risk", _a20_sql())
def q_a20(spark, sf):
    return stable(A.marital_risk(scored(spark, sf)))


def _a23_sql():
    vals = _dash_values_sql()
    long = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {v} AS value FROM scored" for d, v in vals.items())
    counts = f"SELECT dimension, value, count(*) AS count FROM ({long}) GROUP BY 1, 2"
    dom = " UNION ALL ".join(f"SELECT '{d}' AS dimension, {O.q(x)} AS value" for d, xs in A.DOMAINS.items() for x in xs)
    full = (f"SELECT coalesce(d.dimension, c.dimension) AS dimension, coalesce(d.value, c.value) AS value, "
            f"CAST(coalesce(c.count, 0) AS BIGINT) AS count FROM ({dom}) d FULL OUTER JOIN ({counts}) c "
            f"ON d.dimension = c.dimension AND d.value = c.value")
    body = (f"SELECT dimension, value, count, round(count * 100.0 / sum(count) OVER (PARTITION BY dimension), 1) "
            f"AS share FROM ({full})")
    return O.round_all(O.chain("scored", body), ["share"])


@register("a23_all_distributions", _a23_sql())
def q_a23(spark, sf):
    return stable(A.all_distributions(scored(spark, sf)))


# ---------------------------------------------------------------------------
# rows (F5, F7, F10, F12, T3, T5)
# ---------------------------------------------------------------------------
SCORED_ROUND = O.SCORED_DOUBLES


@register("f5_ids", O.chain("scored", "SELECT printf('CUST_%04d', row_number() OVER (ORDER BY CAST(CustomerID AS "
                                      "BIGINT))) AS Customer_ID, CustomerID FROM scored"))
def q_f5(spark, sf):
    s = scored(spark, sf).select("CustomerID")
    return W.with_row_ids(s, order_by=F.col("CustomerID").cast("bigint"))


for _lv in ("high", "medium", "low"):
    def _mkf(lv):
        def q(spark, sf):
            return stable(W.risk_customers(scored(spark, sf), lv))
        return q
    _cond = {"high": "Churn_Probability > 0.7",
             "medium": "Churn_Probability > 0.3 AND Churn_Probability <= 0.7",
             "low": "Churn_Probability <= 0.3"}[_lv]
    register(f"f7_filter_{_lv}", O.round_all(O.chain("scored", f"SELECT * FROM scored WHERE {_cond}"),
                                             SCORED_ROUND))(_mkf(_lv))

SEARCH_TERM = "moderate"


@register("f10_search", O.round_all(O.chain("scored", f"""SELECT * FROM scored WHERE
  coalesce(contains(lower(CustomerID), '{SEARCH_TERM}'), false)
  OR coalesce(contains(lower(Risk_Level), '{SEARCH_TERM}'), false)
  OR (Predicted_Churn IS NOT NULL AND Predicted_Churn <> '0' AND Predicted_Churn <> ''
      AND coalesce(contains(lower(Predicted_Churn), '{SEARCH_TERM}'), false))"""), SCORED_ROUND))
def q_f10(spark, sf):
    return stable(W.search(scored(spark, sf), SEARCH_TERM))


@register("f10_search_id", O.round_all(O.chain("scored", """SELECT * FROM scored WHERE
  coalesce(contains(lower(CustomerID), '12'), false) OR coalesce(contains(lower(Risk_Level), '12'), false)
  OR (Predicted_Churn IS NOT NULL AND Predicted_Churn <> '0' AND Predicted_Churn <> ''
      AND coalesce(contains(lower(Predicted_Churn), '12'), false))"""), SCORED_ROUND))
def q_f10b(spark, sf):
    return stable(W.search(scored(spark, sf), "12"))


def js_number_sql(c: str) -> str:
    return (f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
            f"ELSE CAST(CAST({c} AS DOUBLE) AS VARCHAR) END")


def _f12_sql():
    def shown(c):
        return f"CASE WHEN coalesce({c}, 0) = 0 THEN 'N/A' ELSE {js_number_sql(c)} END"
    sat = "coalesce(CAST(SatisfactionScore AS DOUBLE), 0.0)"
    stars = f"repeat('★', CAST(trunc({sat}) AS INTEGER)) || repeat('☆', CAST(trunc(5 - {sat}) AS INTEGER))"
    body = f"""SELECT CAST(CustomerID AS VARCHAR) AS customer,
  format('{{:.1f}}', round(coalesce(Churn_Probability, 0.0) * 100, 1)) || '%' AS probability,
  coalesce(nullif(Risk_Level, ''), 'Unknown') AS risk,
  CASE WHEN lower(CAST(Predicted_Churn AS VARCHAR)) IN ('yes', '1', 'true') THEN 'Yes' ELSE 'No' END AS prediction,
  {shown('Tenure')} AS tenure, {shown('OrderCount')} AS orders,
  '₹' || rtrim(rtrim(format('{{:,.3f}}', round(coalesce(CashbackAmount, 0.0), 3)), '0'), '.') AS cashback,
  {shown('DaySinceLastOrder')} AS days_since_order,
  {shown('SatisfactionScore')} || CASE WHEN {sat} <> 0 THEN {stars} ELSE '' END AS satisfaction
FROM scored"""
    return O.chain("scored", body)


@register("f12_table", _f12_sql())
def q_f12(spark, sf):
    return W.display_table(scored(spark, sf))


@register("t3_topk", O.round_all(O.chain("scored", "SELECT * FROM scored ORDER BY Churn_Probability DESC, "
                                                  "CustomerID ASC LIMIT 15"), SCORED_ROUND))
def q_t3(spark, sf):
    return stable(W.top_k(scored(spark, sf), P, 15))


@register("t5_page", O.round_all(O.chain("scored", "SELECT * FROM scored ORDER BY CustomerID LIMIT 50 OFFSET 100"),
                                 SCORED_ROUND))
def q_t5(spark, sf):
    return stable(W.page_at(scored(spark, sf), _page_index(spark, sf), 3))


def _page_index(spark, sf):
    """The fences of pages of 50, written once per session and data folder."""
    return _shared("page_index", spark, sf, lambda: W.page_index(scored(spark, sf), 50))


@register("t5_page_index", O.chain("scored", """SELECT (r - 1) // 50 + 1 AS page, min(CustomerID) AS first_key, max(CustomerID) AS last_key,
  count(*) AS n FROM (SELECT CustomerID, row_number() OVER (ORDER BY CustomerID) AS r FROM scored) GROUP BY 1"""))
def q_t5i(spark, sf):
    return _page_index(spark, sf)


@register("t5_page_at", O.round_all(O.chain("scored", "SELECT * FROM scored ORDER BY CustomerID LIMIT 50 OFFSET 50"), SCORED_ROUND))
def q_t5a(spark, sf):
    """Page 2 opened by its fences, without the rows before it."""
    return stable(W.page_at(scored(spark, sf), _page_index(spark, sf), 2))


@register("t5_page_count", O.chain("scored", """SELECT page, (page - 1) * 50 + 1 AS first_row, least(page * 50, n) AS last_row,
  n, total_pages FROM (SELECT n, total_pages, unnest(range(1, total_pages + 1)) AS page
  FROM (SELECT count(*) AS n, CAST(ceil(count(*) / 50) AS BIGINT) AS total_pages FROM scored))"""))
def q_t5c(spark, sf):
    return W.page_count(scored(spark, sf), 50)
