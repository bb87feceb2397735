"""Registered queries: training preparation (N15, F1/F2, N16, N17), M2, N20,
A9, and source/sink round trips (S1, S2, S8) over data Spark derives from
the driver tables."""

from __future__ import annotations

import os
import re

from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.operators import analyze as A
from retentio.operators import clean as N
from retentio.operators import ml as M
from retentio.operators import rows as W
from retentio.plans import oracle_sql as O
from retentio.plans.catalog import ORACLES, _shared, cleaned, mart, register, scored, stable, widen
from retentio.plans.queries_analysis import RUN_DATE, P

MED7 = N.TRAINING_MEDIAN_COLUMNS


@register("n15_training_fill", O.round_all(O.chain("mart", "SELECT CustomerID, " + ", ".join(
    f"coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM mart)) AS {c}" for c in MED7) + " FROM mart"), MED7))
def q_n15(spark, sf):
    return stable(N.fill_median_columns(mart(spark, sf)).select("CustomerID", *MED7))


# the training frame of the notebook: features listed with PreferredPaymentMode twice (quirk Q8)
TRAIN_NUMERIC = ["Tenure", "PreferredLoginDevice", "CityTier", "WarehouseToHome", "PreferredPaymentMode", "Gender",
                 "HourSpendOnApp", "NumberOfDeviceRegistered", "SatisfactionScore", "NumberOfAddress", "Complain",
                 "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount", "DaySinceLastOrder", "CashbackAmount"]
TRAIN_CATEGORICAL = ["PreferredPaymentMode", "PreferedOrderCat", "MaritalStatus"]
TRAIN_COLUMNS = W.dedupe(TRAIN_NUMERIC + TRAIN_CATEGORICAL + ["Churn"])
_F1_NULLABLE = ["PreferredLoginDevice"] + O.NULLABLE_INTS


def _training_sql():
    sel = []
    for c in TRAIN_COLUMNS:
        if c in MED7:
            sel.append(f"coalesce({c}, (SELECT median(CAST({c} AS DOUBLE)) FROM mart)) AS {c}")
        elif c == "PreferredLoginDevice":
            sel.append("CAST(CASE WHEN PreferredLoginDevice IN ('Mobile Phone', 'Phone') THEN 0 "
                       "WHEN PreferredLoginDevice = 'Computer' THEN 1 END AS INTEGER) AS PreferredLoginDevice")
        elif c == "Gender":
            sel.append("CAST(CASE WHEN Gender = 'Male' THEN 0 WHEN Gender = 'Female' THEN 1 END AS INTEGER) AS Gender")
        elif c == "PreferredPaymentMode":
            sel.append("CASE WHEN PreferredPaymentMode = 'Cash on Delivery' THEN 'COD' WHEN PreferredPaymentMode = 'CC' "
                       "THEN 'Credit Card' ELSE PreferredPaymentMode END AS PreferredPaymentMode")
        elif c == "PreferedOrderCat":
            sel.append("CASE WHEN PreferedOrderCat = 'Mobile' THEN 'Mobile Phone' ELSE PreferedOrderCat END "
                       "AS PreferedOrderCat")
        else:
            sel.append(c)
    return O.widen(O.round_all(O.chain("mart", "SELECT " + ", ".join(sel) + " FROM mart"), MED7),
                   _F1_NULLABLE)


@register("f1_training_frame", _training_sql())
def q_f1(spark, sf):
    """N15 -> N16 -> N17 -> F1 (de-duplicated column list) -> F2 (label kept)."""
    df = N.binary_codes(N.merge_synonyms(N.fill_median_columns(mart(spark, sf))))
    return widen(stable(df.select(*TRAIN_COLUMNS)), _F1_NULLABLE)


@register("f2_features", f"SELECT * EXCLUDE (Churn) FROM ({_training_sql()})")
def q_f2(spark, sf):
    """the features of the training frame, without the label."""
    return W.features_and_label(q_f1(spark, sf))[0]


@register("m2_class_weights_ratio", O.chain("mart", f"""SELECT Churn, count(*) AS n,
  {O.rnd("CASE WHEN Churn = 1 THEN (SELECT count(*) FROM mart WHERE Churn = 0) * 1.0 / (SELECT count(*) FROM mart WHERE Churn = 1) "
         "ELSE 1.0 END")} AS weight
FROM mart GROUP BY Churn"""))
def q_m2r(spark, sf):
    m = mart(spark, sf)
    w = M.class_weights(m, mode="ratio")
    return stable(m.groupBy("Churn").agg(F.count(F.lit(1)).alias("n"), F.first(w).alias("weight")))


@register("m2_class_weights", O.chain("mart", f"""SELECT Churn, count(*) AS n,
  {O.rnd("CASE WHEN Churn = 1 THEN (SELECT count(*) FROM mart) / (2.0 * (SELECT count(*) FROM mart WHERE Churn = 1)) "
         "ELSE (SELECT count(*) FROM mart) / (2.0 * (SELECT count(*) FROM mart WHERE Churn = 0)) END")} AS weight
FROM mart GROUP BY Churn"""))
def q_m2(spark, sf):
    m = mart(spark, sf)
    w = M.class_weights(m)
    return stable(m.groupBy("Churn").agg(F.count(F.lit(1)).alias("n"), F.first(w).alias("weight")))


@register("n20_yes_no", O.chain("scored", "SELECT CustomerID, CASE WHEN lower(Predicted_Churn) = 'yes' THEN 1 "
                                          "WHEN lower(Predicted_Churn) = 'no' THEN 0 ELSE 0 END AS Predicted_Churn "
                                          "FROM scored"))
def q_n20(spark, sf):
    return scored(spark, sf).select("CustomerID", N.yes_no_to_int(F.col("Predicted_Churn")).alias("Predicted_Churn"))


@register("a9_report_metadata", O.chain("scored", f"""SELECT position, "Field", "Value" FROM (
  SELECT 0 AS position, 'Total Customers Analyzed' AS "Field", CAST(count(*) AS VARCHAR) AS "Value" FROM scored
  UNION ALL SELECT 1, 'Analysis Timestamp', '2026-01-01 00:00:00' UNION ALL SELECT 2, 'Model Used', {O.q(FX.METADATA_MODEL)}
  UNION ALL SELECT 3, 'Data Source', 'Uploaded CSV' UNION ALL SELECT 4, 'Imputation Strategy', {O.q(FX.METADATA_STRATEGY)}
  UNION ALL SELECT 5, 'NaN Values Handled', {O.q(FX.METADATA_NAN)})"""))
def q_a9(spark, sf):
    return A.report_metadata(scored(spark, sf), run_time="2026-01-01 00:00:00")


def _roundtrip_dir(spark, name):
    from retentio.streaming.scoring import scratch_dir
    return scratch_dir(spark, name)


_MART_DOUBLES = ["Tenure", "WarehouseToHome", "HourSpendOnApp", "OrderAmountHikeFromlastYear", "CouponUsed",
                 "OrderCount", "DaySinceLastOrder", "CashbackAmount"]


@register("s1_csv_scan", O.widen(O.round_all(O.chain("mart", "SELECT * EXCLUDE (Churn) FROM mart"), _MART_DOUBLES),
                                 O.NULLABLE_INTS))
def q_s1(spark, sf):
    """The mart written as header CSV (NULL as empty), read back by the
    customer CSV source with its NA tokens and typed ``try_cast``."""
    from retentio.sources.customers import read_customers_csv
    path = os.path.join(_roundtrip_dir(spark, "s1"), "customers.csv")
    mart(spark, sf).drop("Churn").write.option("header", True).csv(path)
    return widen(stable(read_customers_csv(spark, path)), O.NULLABLE_INTS)


@register("s2_json_records", O.widen(O.round_all(O.chain("mart", "SELECT * EXCLUDE (Churn) FROM mart"),
                                                 _MART_DOUBLES), O.NULLABLE_INTS))
def q_s2(spark, sf):
    """The mart as JSON lines, read back with the explicit customer schema."""
    from retentio.sources.customers import CUSTOMER_SCHEMA, read_customers_json
    path = os.path.join(_roundtrip_dir(spark, "s2"), "records")
    mart(spark, sf).drop("Churn").write.json(path)
    out = read_customers_json(spark, path, CUSTOMER_SCHEMA).select(*[c for c in O.MART_COLS if c != "Churn"])
    return widen(stable(out), O.NULLABLE_INTS)


def _s8_sql():
    """N12 over the scored rows: their columns hold no NULL, so only columns without a keyword become text."""
    texts = [c for c in O.NUM_COLS + ["Churn", "Predicted_Churn_Numeric"] if not re.search("tenure|count|number|amount|probability|score", c.lower())]
    return O.round_all(O.chain("scored", "SELECT * REPLACE (" + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in texts) + ") FROM scored"),
                       [c for c in O.SCORED_DOUBLES if c not in texts])


@register("s8_records_json", _s8_sql())
def q_s8(spark, sf):
    """All predictions as JSON records with no NULL fields (N12 first), read back as written."""
    from retentio.operators.clean import null_defaults_by_name
    from retentio.sources.sinks import write_records_json
    path = os.path.join(_roundtrip_dir(spark, "s8"), "records")
    s = scored(spark, sf)
    write_records_json(s, path)
    return stable(spark.read.schema(null_defaults_by_name(s).schema).json(path))


# ---------------------------------------------------------------------------
# one observed write (P10, P13), the report (S6), quarantine (S1, S2), versions (S10, N3), encoding (M5)
# ---------------------------------------------------------------------------
def _as_text(c: str) -> str:
    return f"printf('%.6f', floor({c} * 1000000 + 0.5) / 1000000)"


def _p10_sql():
    cols = [*O.MART_COLS, "Churn_Probability", "Predicted_Churn_Numeric", "Retention_Recommendation", "Churn_Probability_Percent",
            "Predicted_Churn", "Risk_Level"]
    kinds = {"Churn": "int", "Predicted_Churn_Numeric": "int"}
    shown = []
    for c in cols:
        t = _as_text(c) if c in O.SCORED_DOUBLES else f"CAST({c} AS VARCHAR)"
        shown.append(f"strlen({t}) + CASE WHEN contains({t}, ',') THEN 2 ELSE 0 END")
    size = " + ".join(shown) + f" + {len(cols) - 1} + 1"
    head = len(",".join(cols)) + 1
    body = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS name, '{kinds.get(c, 'string')}' AS type, count(*) - count({c}) AS n_null, "
        f"count(*) AS total_customers, {len(cols)} AS total_features, (sum({size}) + {head}) / 1024.0 AS dataset_size_kb FROM scored"
        for i, c in enumerate(cols))
    return O.round_all(O.chain("scored", body), ["dataset_size_kb"])


@register("p10_dataset_info", _p10_sql())
def q_p10i(spark, sf):
    """Size, names, types, missing values and rows of the scored table, observed while it is written."""
    from retentio.operators.profile import write_observed
    s = stable(scored(spark, sf))
    shown = s.select(*[F.format_string("%.6f", F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes])
    return stable(write_observed(shown, os.path.join(_roundtrip_dir(spark, "p10"), "scored")))


def _s6_sql():
    """Customers by made-up id, then the summary and the metadata, as (part, item, value)."""
    customers = O.chain("scored", """SELECT printf('CUST_%04d', row_number() OVER (ORDER BY CAST(CustomerID AS BIGINT))) AS item,
  Risk_Level || '|' || Predicted_Churn || '|' || Churn_Probability_Percent AS value FROM scored""")
    return (f"SELECT 'customers' AS part, item, value FROM ({customers}) UNION ALL SELECT 'summary', Metric, Value FROM "
            f"({ORACLES['a8_summary_report']}) UNION ALL SELECT 'metadata', \"Field\", \"Value\" FROM ({ORACLES['a9_report_metadata']})")


@register("s6_full_report", _s6_sql())
def q_s6(spark, sf):
    """The whole report with made-up ids, committed by its manifest and read back."""
    from retentio.sources.sinks import read_full_report, write_full_report
    rows = scored(spark, sf).withColumn("Place", F.col("CustomerID").cast("long")).drop("CustomerID")
    base = write_full_report(rows, _roundtrip_dir(spark, "s6"), stamp="run", run_time="2026-01-01 00:00:00", run_date=RUN_DATE,
                             order_by=F.col("Place"))
    got = read_full_report(spark, base)
    shown = F.concat_ws("|", "Risk_Level", "Predicted_Churn", "Churn_Probability_Percent")
    parts = [("customers", F.col("Customer_ID"), shown), ("summary", F.col("Metric"), F.col("Value")),
             ("metadata", F.col("Field"), F.col("Value"))]
    frames = [got[p].select(F.lit(p).alias("part"), i.alias("item"), v.alias("value")) for p, i, v in parts]
    return frames[0].union(frames[1]).union(frames[2])


# lines of the mart that are broken alike on both sides, by the customer id modulo 11
_BROKEN_LINES = """CASE CAST(CustomerID AS BIGINT) % 11 WHEN 3 THEN 'no record' WHEN 5 THEN 'field of another type'
  WHEN 7 THEN 'no id' ELSE 'accepted' END"""


@register("s2_quarantine", O.chain("mart", f"""SELECT source, reason, count(*) AS n FROM (
  SELECT unnest(['csv', 'json']) AS source, {_BROKEN_LINES} AS reason FROM mart) GROUP BY 1, 2"""))
def q_s2q(spark, sf):
    """Lines of the mart cut short, with text in a number, or without an id, told apart and quarantined."""
    from retentio.sources.customers import CUSTOMER_SCHEMA, quarantine, rescued_records
    m = mart(spark, sf).drop("Churn")
    kind = F.col("CustomerID").cast("long") % 11
    named = m.select(*[F.when(kind == 7, F.lit(None)).otherwise(F.col(c)).alias(c) if c == "CustomerID" else F.col(c)
                       for c in CUSTOMER_SCHEMA.names], kind.alias("__kind"))
    values = [F.col(c) for c in CUSTOMER_SCHEMA.names]
    texts = {"json": F.to_json(F.struct(*values)), "csv": F.concat_ws(",", *[F.coalesce(v.cast("string"), F.lit("")) for v in values])}
    bad = {"json": F.regexp_replace(texts["json"], '"CityTier":[0-9]+', '"CityTier":"many"'),
           "csv": F.concat_ws(",", *[F.lit("many") if c == "CityTier" else F.coalesce(F.col(c).cast("string"), F.lit(""))
                                     for c in CUSTOMER_SCHEMA.names])}
    out = []
    for source in ("csv", "json"):
        base = _roundtrip_dir(spark, "s2q")
        cut = {"json": F.expr("substring(text, 1, length(text) - 3)"), "csv": F.concat(F.lit("cut,"), F.col("text"))}[source]
        lines = named.withColumn("text", texts[source]).select(
            F.when(F.col("__kind") == 3, cut).when(F.col("__kind") == 5, bad[source]).otherwise(F.col("text")).alias("value"))
        lines.write.text(os.path.join(base, "in"))
        records = rescued_records(spark, os.path.join(base, "in"), CUSTOMER_SCHEMA, source, header=False)
        quarantine(records, os.path.join(base, "good"), os.path.join(base, "bad"))
        good = spark.read.parquet(os.path.join(base, "good")).select(F.lit("accepted").alias("reason"))
        bad_rows = spark.read.schema("reason string, line string").json(os.path.join(base, "bad")).where("line is not null").select("reason")
        out.append(good.union(bad_rows).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(source).alias("source"), "reason", "n"))
    return out[0].union(out[1])


def _version_chain(src: str, version: int, rest: int) -> str:
    """Accepted rows with id % 2 = ``rest``, scored with the statistics of ``src``."""
    from retentio.plans.queries_core import _errors_sql, _n13_body
    types = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in O.NUM_COLS)
    cleaned = f"cleaned AS (SELECT * REPLACE ({types}) FROM rc WHERE len({_errors_sql()}) = 0)"
    half = "half AS (SELECT * FROM mart WHERE CAST(CustomerID AS BIGINT) % 2 = 0)"
    return O.with_ctes(O.MART, half, O.stats_cte(src), f"rc AS ({_n13_body()})", cleaned, O.FEAT, O.SCORED,
                       body=f"SELECT CustomerID, Churn_Probability, CAST({version} AS BIGINT) AS stats_version FROM scored "
                            f"WHERE CAST(CustomerID AS BIGINT) % 2 = {rest}")


@register("s10_versioned_stats", O.round_all(
    f"SELECT * FROM ({_version_chain('mart', 1, 0)}) UNION ALL SELECT * FROM ({_version_chain('half', 2, 1)})", ["Churn_Probability"]))
def q_s10v(spark, sf):
    """Records arrive in two halves; the statistics of the first are published before the second comes, whose batch uses them."""
    from retentio.operators.clean import normalise_missing
    from retentio.operators.stats import compute_stats
    from retentio.plans.catalog import stats as shared_stats
    from retentio.streaming.scoring import publish_stats, run_versioned_scoring

    def build():
        m = mart(spark, sf)
        base = _roundtrip_dir(spark, "s10v")
        place = {k: os.path.join(base, k) for k in ("in", "stats", "out", "ckpt")}
        even = m.where(F.col("CustomerID").cast("long") % 2 == 0)
        publish_stats(shared_stats(spark, sf), spark, place["stats"])
        for half, after in ((even, True), (m.where(F.col("CustomerID").cast("long") % 2 != 0), False)):
            half.write.mode("append").json(place["in"])
            out = run_versioned_scoring(spark, place["in"], m.schema, place["stats"], place["out"], place["ckpt"])
            if after:
                publish_stats(compute_stats(normalise_missing(even)), spark, place["stats"])
        return out
    return stable(_shared("versions", spark, sf, build).select("CustomerID", P, "stats_version"))


_TS = ["PreferedOrderCat", "MaritalStatus"]


def _ts_sql():
    h = "(((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647"
    over = "OVER (PARTITION BY {c} ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cols = ", ".join(f"(coalesce(sum(y) {over.format(c=c)}, 0) + overall) / (count(y) {over.format(c=c)} + 1.0) AS {c}_ts" for c in _TS)
    return O.round_all(O.chain("cleaned", f"""SELECT CustomerID, {cols} FROM (SELECT *, CAST(Churn AS DOUBLE) AS y, {h} AS h,
  (SELECT avg(CAST(Churn AS DOUBLE)) FROM cleaned) AS overall FROM cleaned)"""), [f"{c}_ts" for c in _TS])


@register("m5_target_statistics", _ts_sql())
def q_m5(spark, sf):
    """M5: categories as the mean label of the rows before, in hashed order."""
    from retentio.operators.features import ordered_target_statistics
    from retentio.operators.ml import lehmer_hash
    cl, _ = cleaned(spark, sf)
    out = ordered_target_statistics(cl.select("CustomerID", "Churn", *_TS), _TS, lehmer_hash(F.col("CustomerID").cast("long")))
    return stable(out.select("CustomerID", *[f"{c}_ts" for c in _TS]))
