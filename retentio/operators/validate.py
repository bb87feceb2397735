"""Per-row data-quality rules (V1-V9) as one array-valued column.

Each rule is a ``when(rule, message)``; ``array_compact`` keeps the fired
ones. Accepted / rejected rows are two filters of the same projection, and
error counts are an ``explode`` + ``groupBy`` over the rejected rows (keys:
eight messages at most).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.operators.clean import _c


def _falsy(name: str, default: float, df: DataFrame) -> Column:
    """``value or default``: NULL and 0 both read as the default."""
    if name not in df.columns:
        return F.lit(float(default))
    v = _c(name).cast("double")
    return F.when(v.isNull() | (v == 0), F.lit(float(default))).otherwise(v)


def error_list(df: DataFrame) -> Column:
    """V1-V8 -> ``array<string>`` of messages, in rule order."""
    tenure = _falsy("Tenure", 0, df)
    days = _falsy("DaySinceLastOrder", 0, df)
    cash = _falsy("CashbackAmount", 0, df)
    orders = _falsy("OrderCount", 0, df)
    sat = _falsy("SatisfactionScore", 3, df)
    rules = [
        (tenure > 200, FX.MSG_TENURE_HIGH),
        (tenure < 0, FX.MSG_TENURE_NEG),
        (days > 365, FX.MSG_DAYS_HIGH),
        (days < 0, FX.MSG_DAYS_NEG),
        (cash > 100000, FX.MSG_CASHBACK_HIGH),
        (cash < 0, FX.MSG_CASHBACK_NEG),
        ((orders == 0) & (cash > 0), FX.MSG_CASHBACK_NO_ORDERS),
        ((sat < 1) | (sat > 5), FX.MSG_SATISFACTION_RANGE),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in rules])).cast("array<string>")


def with_errors(df: DataFrame) -> DataFrame:
    """V1-V8: adds ``errors`` and ``is_valid`` (V9: reject when any fires)."""
    return df.withColumn("errors", error_list(df)).withColumn("is_valid", F.size("errors") == 0)


def accepted(df: DataFrame) -> DataFrame:
    return with_errors(df).where("is_valid").drop("errors", "is_valid")


def rejected(df: DataFrame) -> DataFrame:
    return with_errors(df).where(~F.col("is_valid")).drop("is_valid")


def error_counts(df: DataFrame) -> DataFrame:
    """Count of rows per fired message."""
    return (with_errors(df).select(F.explode("errors").alias("error"))
            .groupBy("error").agg(F.count(F.lit(1)).alias("n")))
