"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each oracle is written independently in plain SQL over the driver's views
(``customer``, ``orders``, ``lineitem``, ``events``); the shared stages
(mart, statistics, cleaning, features, score) are CTEs prepended to each
query. Doubles are rounded on both sides with ``floor(x * 1e6 + 0.5) / 1e6``
so the value hash does not depend on summation order.
"""

from __future__ import annotations

from retentio.functions import fixed as FX

NUM_COLS = ["Tenure", "WarehouseToHome", "CityTier", "HourSpendOnApp", "SatisfactionScore", "Complain",
            "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount", "DaySinceLastOrder", "CashbackAmount",
            "NumberOfDeviceRegistered", "NumberOfAddress"]
STR_COLS = ["PreferredLoginDevice", "PreferredPaymentMode", "PreferedOrderCat", "Gender", "MaritalStatus"]
MART_COLS = ["CustomerID"] + NUM_COLS + STR_COLS + ["Churn"]
DIGITS = 6


def rnd(expr: str, digits: int = DIGITS) -> str:
    s = f"1e{digits}"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


def dbl(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MART = """
ord AS (
  SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CAST(o_orderdate AS DATE) AS od
  FROM orders
),
order_facts AS (
  SELECT o_custkey AS custkey,
         min(CASE WHEN od < DATE '1996-07-01' THEN od END) AS first_od,
         max(CASE WHEN od < DATE '1996-07-01' THEN od END) AS last_od,
         sum(CASE WHEN od < DATE '1996-07-01' AND od >= DATE '1995-07-02'
                  THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS recent_total,
         sum(CASE WHEN od < DATE '1995-07-02' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS earlier_total,
         max(CASE WHEN od >= DATE '1996-07-01' THEN 1 END) AS active_next
  FROM ord WHERE od < DATE '1996-12-28'
  GROUP BY o_custkey
),
prio_counts AS (
  SELECT o_custkey AS custkey, o_orderpriority, count(*) AS n
  FROM ord WHERE od < DATE '1996-07-01' GROUP BY 1, 2
),
prio_mode AS (
  SELECT custkey, count(*) AS n_priorities,
         arg_min(o_orderpriority, (-n, o_orderpriority)) AS top_priority
  FROM prio_counts GROUP BY custkey
),
line_facts AS (
  SELECT o.o_custkey AS custkey, count(*) AS n_lines,
         sum(CAST(l.l_extendedprice AS DECIMAL(15,2)) * CAST(l.l_discount AS DECIMAL(15,2))) AS cashback,
         count(*) FILTER (WHERE l.l_returnflag = 'R') AS n_returned,
         count(*) FILTER (WHERE l.l_discount >= 0.08) AS n_coupon,
         count(DISTINCT l.l_suppkey) AS n_suppliers
  FROM lineitem l JOIN ord o ON l.l_orderkey = o.o_orderkey
  WHERE o.od < DATE '1996-07-01'
  GROUP BY o.o_custkey
),
ev AS (
  SELECT user_id AS custkey, sum(CAST(value AS DECIMAL(18,2))) AS event_value FROM events GROUP BY 1
),
mart AS (
  SELECT
    CAST(c.c_custkey AS VARCHAR) AS CustomerID,
    CAST(CAST(floor(date_diff('day', f.first_od, DATE '1996-07-01') / 30) AS BIGINT) AS DOUBLE) AS Tenure,
    CAST(5 + ((c.c_nationkey * 7) % 45) AS DOUBLE) AS WarehouseToHome,
    CAST(c.c_nationkey % 3 + 1 AS INTEGER) AS CityTier,
    CAST(e.event_value AS DOUBLE) / 60.0 AS HourSpendOnApp,
    CAST(5 - (5 * lf.n_returned) // lf.n_lines AS INTEGER) AS SatisfactionScore,
    CAST(CASE WHEN lf.n_lines IS NOT NULL THEN CASE WHEN 2 * lf.n_returned >= lf.n_lines THEN 1 ELSE 0 END END AS INTEGER) AS Complain,
    CASE WHEN f.recent_total IS NOT NULL AND f.earlier_total IS NOT NULL
         THEN (CAST(f.recent_total AS DOUBLE) - CAST(f.earlier_total AS DOUBLE)) / CAST(f.earlier_total AS DOUBLE) * 100.0
    END AS OrderAmountHikeFromlastYear,
    CAST(lf.n_coupon AS DOUBLE) AS CouponUsed,
    CAST(lf.n_lines AS DOUBLE) AS OrderCount,
    CAST(date_diff('day', f.last_od, DATE '1996-07-01') AS DOUBLE) AS DaySinceLastOrder,
    CASE WHEN c.c_acctbal >= 0 THEN CAST(lf.cashback AS DOUBLE) END AS CashbackAmount,
    CAST(pm.n_priorities AS INTEGER) AS NumberOfDeviceRegistered,
    CAST(lf.n_suppliers AS INTEGER) AS NumberOfAddress,
    CASE WHEN c.c_custkey % 17 <> 0 THEN
      CASE c.c_custkey % 3 WHEN 0 THEN 'Phone' WHEN 1 THEN 'Mobile Phone' WHEN 2 THEN 'Computer' END
    END AS PreferredLoginDevice,
    CASE pm.top_priority WHEN '1-URGENT' THEN 'CC' WHEN '2-HIGH' THEN 'Credit Card' WHEN '3-MEDIUM' THEN 'COD'
         WHEN '4-NOT SPECIFIED' THEN 'Cash on Delivery' WHEN '5-LOW' THEN 'UPI' END AS PreferredPaymentMode,
    CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'Mobile' WHEN 'BUILDING' THEN 'Mobile Phone'
         WHEN 'FURNITURE' THEN 'Fashion' WHEN 'HOUSEHOLD' THEN 'Grocery' WHEN 'MACHINERY' THEN 'Laptop & Accessory'
    END AS PreferedOrderCat,
    CASE c.c_custkey % 2 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' END AS Gender,
    CASE (c.c_custkey // 3) % 3 WHEN 0 THEN 'Single' WHEN 1 THEN 'Married' WHEN 2 THEN 'Divorced' END AS MaritalStatus,
    CAST(CASE WHEN f.active_next IS NULL THEN 1 ELSE 0 END AS INTEGER) AS Churn
  FROM customer c
  LEFT JOIN order_facts f ON f.custkey = c.c_custkey
  LEFT JOIN prio_mode pm ON pm.custkey = c.c_custkey
  LEFT JOIN line_facts lf ON lf.custkey = c.c_custkey
  LEFT JOIN ev e ON e.custkey = c.c_custkey
)"""


def _mode_sql(col: str, src: str = "mart") -> str:
    return (f"(SELECT v FROM (SELECT {col} AS v, count(*) AS n FROM {src} WHERE {col} IS NOT NULL GROUP BY 1) "
            f"ORDER BY n DESC, v ASC LIMIT 1)")


def stats_cte(src: str = "mart") -> str:
    parts = []
    for c in NUM_COLS:
        d = dbl(FX.NUMERIC_DEFAULTS.get(c, 0.0))
        parts.append(f"count({c}) AS n_{c}")
        parts.append(f"coalesce(avg(CAST({c} AS DOUBLE)), {d}) AS mean_{c}")
        parts.append(f"coalesce(median(CAST({c} AS DOUBLE)), {d}) AS med_{c}")
    for c in STR_COLS:
        d = q(FX.CATEGORICAL_DEFAULTS.get(c, "Missing"))
        parts.append(f"count({c}) AS n_{c}")
        parts.append(f"coalesce({_mode_sql(c, src)}, {d}) AS mode_{c}")
    return "stats AS (SELECT " + ",\n  ".join(parts) + f" FROM {src})"


def cleaned_cte(strategy: str = "median", name: str = "cleaned") -> str:
    stat = "med" if strategy == "median" else "mean"
    sel = ["m.CustomerID"]
    for c in NUM_COLS:
        raw = f"CAST(m.{c} AS DOUBLE)"
        if c == "CashbackAmount":
            e = f"coalesce({raw}, CAST(m.OrderCount AS DOUBLE) * {dbl(FX.AVG_ORDER_VALUE)} * {dbl(FX.CASHBACK_SHARE)}, s.{stat}_{c})"
        elif c == "OrderCount":
            e = (f"coalesce({raw}, CASE WHEN m.Tenure IS NOT NULL THEN greatest({dbl(1.0)}, CAST(m.Tenure AS DOUBLE) / {dbl(3.0)}) END, "
                 f"s.{stat}_{c})")
        elif c == "SatisfactionScore":
            e = (f"coalesce({raw}, CAST(CASE WHEN m.Complain = 1 THEN 2 WHEN m.DaySinceLastOrder > 30 THEN 3 ELSE 4 END AS DOUBLE), "
                 f"s.{stat}_{c})")
        else:
            e = f"coalesce({raw}, s.{stat}_{c})"
        sel.append(f"{e} AS {c}")
    for c in STR_COLS:
        sel.append(f"coalesce(m.{c}, s.mode_{c}) AS {c}")
    sel.append("m.Churn")
    return f"{name} AS (SELECT " + ",\n  ".join(sel) + " FROM mart m CROSS JOIN stats s)"


FEAT = """
clipped AS (
  SELECT * REPLACE (greatest(OrderCount, CAST(1.0 AS DOUBLE)) AS OrderCount,
                    greatest(Tenure, CAST(0.0 AS DOUBLE)) AS Tenure,
                    greatest(DaySinceLastOrder, CAST(0.0 AS DOUBLE)) AS DaySinceLastOrder)
  FROM cleaned
),
feat AS (
  SELECT *,
    CashbackAmount * OrderCount / (Tenure + CAST(1.0 AS DOUBLE)) AS ValueScore,
    CASE WHEN DaySinceLastOrder > 0 THEN HourSpendOnApp / DaySinceLastOrder ELSE HourSpendOnApp END AS EngagementIntensity,
    CashbackAmount / OrderCount AS CashbackPerOrder,
    CASE WHEN OrderCount > 0 THEN Tenure / OrderCount ELSE CAST(0.0 AS DOUBLE) END AS OrderFrequency,
    CAST(DaySinceLastOrder > 30 AS INTEGER) AS HighRecencyFlag,
    CAST(SatisfactionScore <= 2 AS INTEGER) AS LowSatisfactionFlag,
    CAST(Complain = 1 AS INTEGER) AS ComplaintFlag,
    CASE WHEN Tenure > 12 THEN 'Established' WHEN OrderCount > 10 THEN 'Active_New' ELSE 'New_LowEngagement' END AS CustomerSegment
  FROM clipped
)"""


def _logit_sql() -> str:
    z = dbl(FX.SCORECARD_INTERCEPT)
    for col, w in FX.SCORECARD_WEIGHTS:
        z = f"({z} + {dbl(w)} * CAST({col} AS DOUBLE))"
    return z


def band_batch_sql(p: str, labels=FX.BAND_BATCH) -> str:
    low, mid, high = labels
    return (f"CASE WHEN {p} <= {dbl(FX.BAND_LOW_CUT)} THEN {q(low)} WHEN {p} <= {dbl(FX.BAND_HIGH_CUT)} "
            f"THEN {q(mid)} ELSE {q(high)} END")


def band_record_sql(p: str) -> str:
    low, mid, high = FX.BAND_RECORD
    return (f"CASE WHEN {p} < {dbl(FX.BAND_LOW_CUT)} THEN {q(low)} WHEN {p} < {dbl(FX.BAND_HIGH_CUT)} "
            f"THEN {q(mid)} ELSE {q(high)} END")


def batch_reco_sql(level: str) -> str:
    r = FX.BATCH_RECOMMENDATIONS
    return (f"CASE WHEN {level} = 'High Risk' THEN {q(r['High Risk'])} WHEN {level} = 'Moderate Risk' "
            f"THEN {q(r['Moderate Risk'])} ELSE {q(r['Low Risk'])} END")


SCORED = f"""
prob AS (
  SELECT CustomerID, CAST(1.0 AS DOUBLE) / (CAST(1.0 AS DOUBLE) + exp(-({_logit_sql()}))) AS p FROM feat
),
scored AS (
  SELECT c.*, pr.p AS Churn_Probability, CAST(pr.p > {dbl(FX.CLASS_CUT)} AS INTEGER) AS Predicted_Churn_Numeric,
    {band_batch_sql('pr.p')} AS Risk_Level,
    {batch_reco_sql(band_batch_sql('pr.p'))} AS Retention_Recommendation,
    CAST(round_even(pr.p * 100, 2) AS VARCHAR) || '%' AS Churn_Probability_Percent,
    CASE WHEN pr.p > {dbl(FX.CLASS_CUT)} THEN 'Yes' ELSE 'No' END AS Predicted_Churn
  FROM cleaned c JOIN prob pr ON pr.CustomerID = c.CustomerID
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + body


def chain(upto: str, body: str, strategy: str = "median") -> str:
    """Prepend the shared stages up to ``upto`` (mart|stats|cleaned|feat|scored)."""
    order = ["mart", "stats", "cleaned", "feat", "scored"]
    parts = [MART]
    if order.index(upto) >= 1:
        parts.append(stats_cte())
    if order.index(upto) >= 2:
        parts.append(cleaned_cte(strategy))
    if order.index(upto) >= 3:
        parts.append(FEAT)
    if order.index(upto) >= 4:
        parts.append(SCORED)
    return with_ctes(*parts, body=body)


SCORED_DOUBLES = NUM_COLS + ["Churn_Probability"]


NULLABLE_INTS = ["SatisfactionScore", "Complain", "NumberOfDeviceRegistered", "NumberOfAddress"]


def widen(select_from: str, cols: list[str]) -> str:
    """Integer columns that hold NULLs leave the query as DOUBLE (both sides)."""
    rep = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({select_from})"


def round_all(select_from: str, doubles: list[str]) -> str:
    """``SELECT * REPLACE`` rounding the listed double columns."""
    if not doubles:
        return f"SELECT * FROM ({select_from})"
    rep = ", ".join(f'{rnd(chr(34) + c + chr(34))} AS "{c}"' for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({select_from})"
