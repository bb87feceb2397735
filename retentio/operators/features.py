"""Feature engineering and encoding: projections only (E1-E10, F9), and target statistics of categories (M5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.fixed import CATEGORICAL_COLUMNS, MODEL_FEATURES, REQUIRED_COLUMNS
from retentio.operators.clean import _c, _replace, clip_lower, coerce_numeric, fill_numeric, missing_category
from retentio.operators.stats import Stats

FEATURE_COLUMNS = ["ValueScore", "EngagementIntensity", "CashbackPerOrder", "OrderFrequency",
                   "HighRecencyFlag", "LowSatisfactionFlag", "ComplaintFlag", "CustomerSegment"]


def business_features(df: DataFrame, stats: Stats) -> DataFrame:
    """E1-E9 on a cleaned table.

    Re-imputes after coercion (E9), clips (N18), then adds ValueScore,
    EngagementIntensity, CashbackPerOrder, OrderFrequency, the three flags
    and CustomerSegment -- all in one projection.
    """
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"feature engineering needs columns {missing}")
    out = fill_numeric(df, stats)
    out = coerce_numeric(out, REQUIRED_COLUMNS)
    out = _replace(out, {c: F.coalesce(_c(c), F.lit(float(stats.median.get(c, 0.0))).cast(out.schema[c].dataType))
                         for c in REQUIRED_COLUMNS})
    out = clip_lower(out)
    cash, oc, ten = _c("CashbackAmount"), _c("OrderCount"), _c("Tenure")
    days, hours = _c("DaySinceLastOrder"), _c("HourSpendOnApp")
    feats: list[Column] = [
        (cash * oc / (ten + 1.0)).alias("ValueScore"),
        F.when(days > 0, hours / days).otherwise(hours).cast("double").alias("EngagementIntensity"),
        (cash / oc).alias("CashbackPerOrder"),
        F.when(oc > 0, ten / oc).otherwise(F.lit(0.0)).alias("OrderFrequency"),
        (days > 30).cast("int").alias("HighRecencyFlag"),
        (_c("SatisfactionScore") <= 2).cast("int").alias("LowSatisfactionFlag"),
        (_c("Complain") == 1).cast("int").alias("ComplaintFlag"),
        F.when(ten > 12, "Established").when(oc > 10, "Active_New").otherwise("New_LowEngagement")
        .alias("CustomerSegment"),
    ]
    return out.select(*[_c(c) for c in out.columns if c not in FEATURE_COLUMNS], *feats)


def one_hot_fixed(df: DataFrame, features: list[str] = MODEL_FEATURES) -> DataFrame:
    """E10 (default): one 0/1 column per model dummy of the fixed vocabulary."""
    df = missing_category(df)
    dummies = []
    for f in features:
        for c in CATEGORICAL_COLUMNS:
            if f.startswith(c + "_"):
                level = f[len(c) + 1:]
                dummies.append((_c(c) == level).cast("int").alias(f))
                break
    return df.select("*", *dummies)


def one_hot_batch(df: DataFrame, id_col: str = "CustomerID", columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """E10 (``compat="batch"``): levels taken from the batch, the lowest dropped.

    Returned in sparse long form ``(id, feature)`` -- one row per dummy that is
    1; zeros are implicit. The lowest level per column is a combinable ``min``
    aggregate (one small row); no fan-out of customers x levels.
    """
    df = missing_category(df, columns)
    mins = df.agg(*[F.min(_c(c)).alias(c) for c in columns]).collect()[0]
    parts = []
    for c in columns:
        parts.append(F.when(_c(c) != F.lit(mins[c]), F.concat(F.lit(c + "_"), _c(c))))
    return (df.select(_c(id_col).alias(id_col), F.explode(F.array(*parts)).alias("feature"))
            .where(F.col("feature").isNotNull()))


def align_features(df: DataFrame, features: list[str] = MODEL_FEATURES, keep: tuple[str, ...] = ()) -> DataFrame:
    """exact model feature order; absent -> 0.0, extra dropped, all double."""
    enc = one_hot_fixed(df, features)
    cols = [(_c(f).cast("double") if f in enc.columns else F.lit(0.0)).alias(f) for f in features]
    return enc.select(*[_c(k) for k in keep if k in enc.columns], *cols)


# M5 -------------------------------------------------------------------------
def ordered_target_statistics(df: DataFrame, columns: list[str], row_hash: Column, label: str = "Churn",
                              weight: float = 1.0) -> DataFrame:
    """M5: ``df`` with ``<column>_ts``: the label's mean over the rows of the same category before it, in order of
    ``row_hash`` (unique), drawn towards the overall mean as by ``weight`` rows; a row's own label is not among them.

    Rows are dealt out by ranges of the hash and written; sums per (part,
    category) are few, and their running totals say what lies before a part.
    Inside a part a category's rows are bounded by the part's, so a category
    that holds a third of all rows is never in one place. A NULL category is one
    of its own; rows without a label count nothing.
    """
    from pyspark.sql import Window as W

    from retentio.plans.batch import materialise
    y = F.col(f"`{label}`").cast("double")
    overall = df.agg(F.avg(y)).first()[0] or 0.0
    part = materialise(df.withColumn("__h", row_hash).repartitionByRange("__h").withColumn("__part", F.spark_partition_id()))
    out = part
    for i, c in enumerate(columns):
        cat = F.col(f"`{c}`").cast("string")
        sums = part.groupBy("__part", cat.alias("__cat")).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
        before = W.partitionBy("__cat").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
        ahead = sums.select(F.col("__part").alias("__p"), F.col("__cat").alias("__c"),
                            F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("__s"),
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"))
        own = W.partitionBy("__part", cat).orderBy("__h").rowsBetween(W.unboundedPreceding, -1)
        here = (out.withColumns({"__s_own": F.coalesce(F.sum(y).over(own), F.lit(0.0)),
                                 "__n_own": F.coalesce(F.count(y).over(own), F.lit(0))}))
        joined = here.join(ahead, (here["__part"] == ahead["__p"]) & cat.eqNullSafe(ahead["__c"]))
        ts = (F.col("__s") + F.col("__s_own") + F.lit(weight * overall)) / (F.col("__n") + F.col("__n_own") + F.lit(weight))
        out = joined.withColumn(f"{c}_ts", ts).drop("__p", "__c", "__s", "__n", "__s_own", "__n_own")
    return out.drop("__h", "__part")


def target_statistics(df: DataFrame, column: str, label: str = "Churn", weight: float = 1.0) -> DataFrame:
    """M5: (category, statistic) of a whole training table, for rows that are scored: one row per category."""
    y = F.col(f"`{label}`").cast("double")
    overall = df.agg(F.avg(y)).first()[0] or 0.0
    return df.groupBy(F.col(f"`{column}`").cast("string").alias("category")).agg(
        ((F.sum(y) + F.lit(weight * overall)) / (F.count(y) + F.lit(weight))).alias("statistic"))
