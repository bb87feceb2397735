"""Aggregations over the scored table.

Global summaries are single ``agg`` calls of combinable functions (partial
aggregation per partition, one small final merge). Distributions are
``groupBy`` over bucketed/normalised values -- low-cardinality keys, so the
shuffle carries one partial row per key per partition; the fixed domain
levels join the same aggregation as weight-0 rows, so zero counts are kept
without a join. Shares are windows over the *grouped* rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.functions.columns import money_text
from retentio.operators.clean import _c

P = "Churn_Probability"


def _high(p):
    return p > FX.BAND_HIGH_CUT


def _mid(p):
    return (p > FX.BAND_LOW_CUT) & (p <= FX.BAND_HIGH_CUT)


def _low(p):
    return p <= FX.BAND_LOW_CUT


# A1-A4 ----------------------------------------------------------------------
def risk_summary(df: DataFrame, prob_col: str = P, pred_col: str = "Predicted_Churn_Numeric") -> DataFrame:
    """A1-A4: band counts, total, average probability, predicted churn and rate."""
    return df.agg(*_summary_aggs(prob_col, pred_col))


def _summary_aggs(prob_col: str = P, pred_col: str = "Predicted_Churn_Numeric") -> list[Column]:
    p = _c(prob_col)
    n = F.count(F.lit(1))
    pred = F.sum(F.coalesce(_c(pred_col).cast("long"), F.lit(0)))
    return [
        n.alias("total_customers"),
        F.count_if(_high(p)).alias("high_risk"),
        F.count_if(_mid(p)).alias("moderate_risk"),
        F.count_if(_low(p)).alias("low_risk"),
        F.avg(p).alias("average_probability"),
        pred.alias("total_predicted_churn"),
        F.when(n > 0, pred / n).otherwise(F.lit(0.0)).alias("churn_rate"),
    ]


# A5 -------------------------------------------------------------------------
PROFILE_FEATURES = ["Tenure", "CashbackAmount", "DaySinceLastOrder", "SatisfactionScore", "OrderCount"]


def high_risk_profile(df: DataFrame, prob_col: str = P, features: list[str] = PROFILE_FEATURES) -> DataFrame:
    """A5: mean, median, std of five features among high-risk customers.

    Long form (feature, mean, median, std); empty when nobody is high-risk,
    std NULL for a single row. The median is the exact distributed selection
    of ``stats.exact_medians``.
    """
    from retentio.operators.stats import exact_medians
    feats = [f for f in features if f in df.columns]
    hi = df.where(_high(_c(prob_col))).select(*[_c(f).cast("double").alias(f) for f in feats])
    aggs = []
    for f in feats:
        aggs += [F.count(_c(f)).alias(f"n::{f}"), F.avg(_c(f)).alias(f"mean::{f}"),
                 F.stddev_samp(_c(f)).alias(f"std::{f}")]
    row = hi.agg(*aggs).collect()[0]  # one row
    spark = df.sparkSession
    counts = {f: row[f"n::{f}"] for f in feats}
    rows = []
    if any(counts.values()):
        med = exact_medians(hi, feats, counts)
        rows = [(f, row[f"mean::{f}"], med[f], row[f"std::{f}"]) for f in feats]
    return spark.createDataFrame(rows, "feature string, mean double, median double, std double")


# A6 / A7 --------------------------------------------------------------------
def high_risk_segment(df: DataFrame, prob_col: str = P) -> DataFrame:
    """High-risk count, their average p, high_risk_loss = sum(p)*850
    over high-risk only, expected_loss = sum(p)*850 over everyone."""
    return df.agg(*_segment_aggs(prob_col))


def _segment_aggs(prob_col: str = P) -> list[Column]:
    p = _c(prob_col)
    return [
        F.count_if(_high(p)).alias("high_risk_count"),
        F.coalesce(F.avg(F.when(_high(p), p)), F.lit(0.0)).alias("high_risk_avg_probability"),
        F.coalesce(F.sum(F.when(_high(p), p)) * FX.AVG_ORDER_VALUE, F.lit(0.0)).alias("high_risk_loss"),
        F.coalesce(F.sum(p) * FX.AVG_ORDER_VALUE, F.lit(0.0)).alias("expected_loss"),
    ]


# A8 / A9 --------------------------------------------------------------------
def summary_report(df: DataFrame, prob_col: str = P, pred_col: str = "Predicted_Churn_Numeric",
                   with_date: bool = True, run_date: str | None = None) -> DataFrame:
    """Eight (Metric, Value) text rows from one aggregate, stacked; the last is the run's date (today, if not given)."""
    s = df.agg(*_summary_aggs(prob_col, pred_col), *_segment_aggs(prob_col))
    pct = "%.2f%%"
    rows = [
        (FX.SUMMARY_METRICS[0], F.col("total_customers").cast("string")),
        (FX.SUMMARY_METRICS[1], F.format_string(pct, F.coalesce(F.col("average_probability"), F.lit(0.0)) * 100)),
        (FX.SUMMARY_METRICS[2], F.format_string(pct, F.col("churn_rate") * 100)),
        (FX.SUMMARY_METRICS[3], F.col("high_risk").cast("string")),
        (FX.SUMMARY_METRICS[4], F.col("moderate_risk").cast("string")),
        (FX.SUMMARY_METRICS[5], F.col("low_risk").cast("string")),
        (FX.SUMMARY_METRICS[6], money_text(F.col("expected_loss"))),
    ]
    if with_date:
        rows.append((FX.SUMMARY_METRICS[7],
                     F.date_format(F.current_date(), "dd/MM/yyyy") if run_date is None else F.lit(run_date)))
    structs = [F.struct(F.lit(i).alias("position"), F.lit(m).alias("Metric"), v.alias("Value"))
               for i, (m, v) in enumerate(rows)]
    return s.select(F.explode(F.array(*structs)).alias("r")).select("r.position", "r.Metric", "r.Value")


def report_metadata(df: DataFrame, data_source: str = "Uploaded CSV", run_time: str | None = None) -> DataFrame:
    """Metadata rows (Field, Value) with the customer count and the run's time (now, if not given)."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss") if run_time is None else F.lit(run_time)
    n = df.agg(F.count(F.lit(1)).cast("string").alias("n"))
    rows = [("Total Customers Analyzed", F.col("n")),
            ("Analysis Timestamp", stamp),
            ("Model Used", F.lit(FX.METADATA_MODEL)), ("Data Source", F.lit(data_source)),
            ("Imputation Strategy", F.lit(FX.METADATA_STRATEGY)), ("NaN Values Handled", F.lit(FX.METADATA_NAN))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("Field"),
                                                 v.alias("Value")) for i, (k, v) in enumerate(rows)])).alias("r")
                    ).select("r.*")


# A10 / A11 ------------------------------------------------------------------
def churn_rate_by(df: DataFrame, key: str, label: str = "Churn") -> DataFrame:
    """A10: mean label per key value; NULL keys left out."""
    return (df.where(_c(key).isNotNull()).groupBy(_c(key).alias(key))
            .agg(F.avg(_c(label).cast("double")).alias("churn_rate"), F.count(F.lit(1)).alias("n")))


def churn_rate_sets(df: DataFrame, keys: list[str], label: str = "Churn") -> DataFrame:
    """A10 for several keys in one scan: (dimension, value, churn_rate, n), NULL keys left out.

    One Expand and one aggregate over grouping sets of one key each; the
    grouping id has a zero bit for the key that a row is grouped by.
    """
    grouped = (df.groupingSets([[_c(k)] for k in keys], *[_c(k) for k in keys])
               .agg(F.avg(_c(label).cast("double")).alias("churn_rate"), F.count(F.lit(1)).alias("n"),
                    F.grouping_id().alias("gid")))
    every = (1 << len(keys)) - 1
    dimension = value = None
    for i, k in enumerate(keys):
        mine = F.col("gid") == every - (1 << (len(keys) - 1 - i))
        dimension = F.when(mine, F.lit(k)) if dimension is None else dimension.when(mine, F.lit(k))
        value = F.when(mine, _c(k).cast("string")) if value is None else value.when(mine, _c(k).cast("string"))
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "churn_rate", "n").where("value is not null")


# A12-A19, A21-A23 -----------------------------------------------------------
def _with_shares(counts: DataFrame) -> DataFrame:
    """``counts`` (dimension, value, count) with share and height against its dimension's total and largest count.

    The totals are one more aggregate of the grouped rows, joined back: values
    of an open domain stay spread, no window gathers them.
    """
    totals = counts.groupBy("dimension").agg(F.sum("count").alias("__sum"), F.max("count").alias("__max"))
    return counts.join(totals, "dimension").select(
        *counts.columns, F.round(F.col("count") * 100.0 / F.col("__sum"), 1).alias("share"),
        (F.col("count") * 100.0 / F.col("__max")).alias("height"))


def dashboard_values(df: DataFrame) -> list[tuple[str, Column]]:
    """The normalised value per dashboard dimension (falsy defaults as the UI)."""
    def falsy(c, d):
        return F.when(c.isNull() | (c.cast("string") == "") | (c.cast("string").try_cast("double") == 0), F.lit(d)
                      ).otherwise(c.cast("string"))
    tenure = F.coalesce(_c("Tenure").cast("double"), F.lit(0.0))
    sat = F.coalesce(F.when(_c("SatisfactionScore").cast("double") != 0, _c("SatisfactionScore").cast("double")),
                     F.lit(3.0))
    tier = F.coalesce(F.when(_c("CityTier").cast("double") != 0, _c("CityTier").cast("double")), F.lit(2.0))
    churned = F.lower(_c("Predicted_Churn").cast("string")).isin("yes", "1", "true")
    sat = F.floor(sat + 0.5).cast("double")  # a fill between two levels counts to the nearest
    payment = falsy(_c("PreferredPaymentMode"), "Credit Card")
    for old, new in FX.SYNONYMS["PreferredPaymentMode"].items():  # N16
        payment = F.when(payment == old, F.lit(new)).otherwise(payment)
    return [
        ("payment", payment),
        ("tenure", F.when(tenure <= 3, "0-3").when(tenure <= 6, "3-6").when(tenure <= 9, "6-9")
         .when(tenure <= 12, "9-12").otherwise("12+")),
        ("city_tier", F.concat(F.lit("Tier "), F.when(tier == F.floor(tier), tier.cast("long").cast("string"))
                               .otherwise(tier.cast("string")))),
        ("marital", falsy(_c("MaritalStatus"), "Single")),
        ("gender", falsy(_c("Gender"), "Male")),
        ("satisfaction", F.when(sat == F.floor(sat), sat.cast("long").cast("string")).otherwise(sat.cast("string"))),
        ("complaints", F.when(F.coalesce(_c("Complain").cast("double"), F.lit(0.0)) == 1, "Complaints")
         .otherwise("No Complaints")),
        ("churn_status", F.when(churned, "Churned").otherwise("Retained")),
    ]


DOMAINS = {
    "tenure": FX.TENURE_BUCKETS, "city_tier": FX.CITY_TIERS, "marital": FX.MARITAL_DOMAIN,
    "gender": FX.GENDER_DOMAIN, "satisfaction": FX.SATISFACTION_DOMAIN, "complaints": FX.COMPLAIN_DOMAIN,
    "churn_status": FX.CHURN_STATUS_DOMAIN,
}


def distribution(df: DataFrame, dimension: str) -> DataFrame:
    """Counts of one dashboard dimension; fixed domains keep zeros.

    The domain levels enter the SAME aggregation as weight-0 rows (a union
    with a few literal rows), so zero counts survive without a join.
    """
    value = dict(dashboard_values(df))[dimension]
    rows = df.select(value.alias("value"), F.lit(1).alias("w"))
    if dimension in DOMAINS:
        dom = df.sparkSession.createDataFrame([(v, 0) for v in DOMAINS[dimension]], "value string, w int")
        rows = rows.unionByName(dom)
    counts = rows.groupBy("value").agg(F.sum("w").cast("long").alias("count"))
    return _with_shares(counts.withColumn("dimension", F.lit(dimension))).drop("dimension")


def all_distributions(df: DataFrame) -> DataFrame:
    """Every dashboard dimension in one scan: (dimension, value, count, share).

    One ``explode`` of (dimension, value) structs, the domain levels as
    weight-0 rows, ONE ``groupBy``; totals per dimension come from its rows.
    """
    vals = dashboard_values(df)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value"))
                                         for d, v in vals])).alias("d")) \
        .select("d.dimension", "d.value", F.lit(1).alias("w"))
    dom = df.sparkSession.createDataFrame([(d, v, 0) for d, vs in DOMAINS.items() for v in vs],
                                          "dimension string, value string, w int")
    counts = long.unionByName(dom).groupBy("dimension", "value").agg(F.sum("w").cast("long").alias("count"))
    return _with_shares(counts).drop("height")


# A20 ------------------------------------------------------------------------
def marital_risk(df: DataFrame, prob_col: str = P) -> DataFrame:
    """Marital status x band crosstab with row shares (open domain)."""
    status = dict(dashboard_values(df))["marital"]
    risk = F.coalesce(_c("Risk_Level"), F.lit("Low Risk"))
    band = F.when(risk.contains("High"), "high").when(risk.contains("Moderate"), "medium").otherwise("low")
    g = (df.select(status.alias("MaritalStatus"), band.alias("band"))
         .groupBy("MaritalStatus").agg(F.count_if(F.col("band") == "low").alias("low"),
                                       F.count_if(F.col("band") == "medium").alias("medium"),
                                       F.count_if(F.col("band") == "high").alias("high")))
    total = F.col("low") + F.col("medium") + F.col("high")
    return g.select("MaritalStatus", "low", "medium", "high", total.alias("total"),
                    *[F.try_divide(F.col(b) * 100.0, total).alias(f"{b}_pct") for b in ("low", "medium", "high")])


# A24 ------------------------------------------------------------------------
def analysis_result(scored: DataFrame, prob_col: str = P) -> DataFrame:
    """One row of nested structs (risk analysis, segmentation, feature
    profile, dataset info) from ONE aggregate over the scored table; the
    feature profile (<= 5 rows, collected) enters as literals. The records
    themselves stay a separate dataset, never collected."""
    prof = high_risk_profile(scored, prob_col).collect()  # <= 5 rows
    fa = F.create_map(*[x for r in prof for x in (
        F.lit(r["feature"]), F.struct(F.lit(r["mean"]).cast("double").alias("mean"),
                                      F.lit(r["median"]).cast("double").alias("median"),
                                      F.lit(r["std"]).cast("double").alias("std")))])
    header_bytes = len(",".join(scored.columns).encode("utf-8")) + 1
    line = F.to_csv(F.struct(*[_c(c) for c in scored.columns]))
    row = scored.agg(*_summary_aggs(prob_col), *_segment_aggs(prob_col),
                     ((F.sum(F.octet_length(line) + 1) + header_bytes) / 1024.0).alias("dataset_size_kb"))
    return row.select(
        F.struct("total_customers", "high_risk", "moderate_risk", "low_risk", "average_probability",
                 "churn_rate", "total_predicted_churn").alias("risk_analysis"),
        F.struct("high_risk_count", "high_risk_avg_probability", "high_risk_loss").alias("customer_segmentation"),
        fa.alias("feature_analysis"),
        F.struct(F.col("total_customers"), F.lit(len(scored.columns)).alias("total_features"),
                 "dataset_size_kb").alias("dataset_info"))
