"""Cleaning, normalisation and imputation.

Every operator is a projection of built-in column expressions: the
statistics arrive as literals (``Stats``), so the fill is a narrow,
codegen'd stage with no shuffle and no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import NUMERIC_TYPES, nan_to_null, numeric_columns, string_columns
from retentio.functions.fixed import (AVG_ORDER_VALUE, BINARY_CODES, CASHBACK_SHARE, CATEGORICAL_COLUMNS,
                                      RECORD_CASHBACK_PER_ORDER, SYNONYMS)
from retentio.operators.stats import DEFAULT_EXCLUDE, Stats, compute_stats

ID_AND_LABEL = DEFAULT_EXCLUDE


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _replace(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Replace named columns in place (order kept) in one projection."""
    return df.select(*[exprs[c].alias(c) if c in exprs else _c(c) for c in df.columns])


# N1 -------------------------------------------------------------------------
def normalise_missing(df: DataFrame) -> DataFrame:
    """NaN/+inf/-inf -> NULL in every floating column."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return _replace(df, {c: nan_to_null(_c(c)) for c in fl})


# N2 -------------------------------------------------------------------------
def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """To double; text that is not a number becomes NULL (``try_cast``,
    ANSI-safe). Integer columns widen to double, as a column with a missing
    value is float in the reference, so a fill of 4.5 stays 4.5."""
    out = {}
    for c in columns:
        if c in df.columns:
            dt = df.schema[c].dataType
            out[c] = (_c(c).cast("double") if isinstance(dt, NUMERIC_TYPES)
                      else nan_to_null(_c(c).try_cast("double")))
    return _replace(df, out)


# N5-N8 ----------------------------------------------------------------------
def rule_impute(df: DataFrame) -> DataFrame:
    """Rule imputation, all from the raw (pre-imputation) values.

    Cashback = OrderCount * 850 * 0.1; OrderCount = max(1, Tenure / 3);
    Satisfaction = 2 if Complain = 1, else 3 if DaySinceLastOrder > 30, else 4.
    A rule whose input is NULL leaves the cell NULL for the statistics fill.
    """
    cols = set(df.columns)
    out = {}
    if "CashbackAmount" in cols and "OrderCount" in cols and "Tenure" in cols:
        out["CashbackAmount"] = F.coalesce(
            _c("CashbackAmount"), (_c("OrderCount") * F.lit(AVG_ORDER_VALUE) * F.lit(CASHBACK_SHARE)).cast(
                df.schema["CashbackAmount"].dataType))
    if "OrderCount" in cols and "Tenure" in cols:
        guess = F.when(_c("Tenure").isNotNull(), F.greatest(F.lit(1.0), _c("Tenure") / 3.0))
        out["OrderCount"] = F.coalesce(_c("OrderCount"), guess.cast(df.schema["OrderCount"].dataType))
    if "SatisfactionScore" in cols and "Complain" in cols and "DaySinceLastOrder" in cols:
        guess = (F.when(_c("Complain") == 1, 2).when(_c("DaySinceLastOrder") > 30, 3).otherwise(4))
        out["SatisfactionScore"] = F.coalesce(_c("SatisfactionScore"),
                                              guess.cast(df.schema["SatisfactionScore"].dataType))
    return _replace(df, out)


# N9 / N10 / N11 -------------------------------------------------------------
def fill_numeric(df: DataFrame, stats: Stats, strategy: str = "median",
                 exclude: tuple[str, ...] = ID_AND_LABEL) -> DataFrame:
    """Numeric NULL -> the column statistic (median or mean), else default."""
    out = {}
    for c in numeric_columns(df, exclude):
        dt = df.schema[c].dataType
        out[c] = F.coalesce(_c(c), F.lit(stats.numeric(c, strategy)).cast(dt))
    return _replace(df, out)


def fill_categorical(df: DataFrame, stats: Stats, exclude: tuple[str, ...] = ID_AND_LABEL) -> DataFrame:
    """String NULL -> the column mode, else 'Unknown'."""
    out = {}
    for c in string_columns(df, exclude):
        mode = stats.mode.get(c)
        out[c] = F.coalesce(_c(c), F.lit(mode if mode is not None else "Unknown"))
    return _replace(df, out)


def fill_last_resort(df: DataFrame) -> DataFrame:
    """Anything still missing -> 0 (numeric) or 'Unknown' (string); never an id or the label."""
    columns = [c for c in df.columns if c not in ID_AND_LABEL]
    return df.na.fill(0, columns).na.fill("Unknown", columns)


# N12 ------------------------------------------------------------------------
def null_defaults_by_name(df: DataFrame) -> DataFrame:
    """Output defaults chosen by column-name keyword.

    tenure/count/number/amount -> 0, probability -> 0.0, score -> 3,
    anything else -> '' (numeric columns of the last kind are rendered as
    text so that '' can be held).
    """
    out = {}
    for f in df.schema.fields:
        low = f.name.lower()
        c = _c(f.name)
        is_num = isinstance(f.dataType, NUMERIC_TYPES)
        if any(k in low for k in ("tenure", "count", "number", "amount")):
            out[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType)) if is_num else F.coalesce(c, F.lit("0"))
        elif "probability" in low:
            out[f.name] = F.coalesce(c, F.lit(0.0).cast(f.dataType)) if is_num else F.coalesce(c, F.lit("0.0"))
        elif "score" in low:
            out[f.name] = F.coalesce(c, F.lit(3).cast(f.dataType)) if is_num else F.coalesce(c, F.lit("3"))
        elif is_num:
            out[f.name] = F.coalesce(c.cast("string"), F.lit(""))
        else:
            out[f.name] = F.coalesce(c, F.lit(""))
    return _replace(df, out)


# N13 ------------------------------------------------------------------------
def record_clean(df: DataFrame, stats: Stats, strategy: str = "median",
                 exclude: tuple[str, ...] = ID_AND_LABEL) -> DataFrame:
    """Record-style imputation over a DataFrame of records.

    NULL or '' -> statistic; CashbackAmount takes max(stat, OrderCount * 85)
    when OrderCount is known (imputed first when it comes earlier, as the
    record's fields are filled in order); strings take the mode; columns with no
    statistic fall back by keyword (tenure/count/number/amount -> 0,
    score -> 3, complain -> 0, else 0).
    """
    out = {}
    for f in df.schema.fields:
        name = f.name
        if name in exclude:
            continue
        c = _c(name)
        is_num = isinstance(f.dataType, NUMERIC_TYPES)
        missing = c.isNull() if is_num else (c.isNull() | (c == ""))
        if name in stats.median or (is_num and name in stats.mean):
            fill = F.lit(float(stats.numeric(name, strategy)))
            if name == "CashbackAmount" and "OrderCount" in df.columns:
                oc = _c("OrderCount").cast("double")
                # fields are imputed in column order: an OrderCount before
                # CashbackAmount is already filled when the rule reads it
                if df.columns.index("OrderCount") < df.columns.index(name) and "OrderCount" in stats.median:
                    oc = F.coalesce(oc, F.lit(float(stats.numeric("OrderCount", strategy))))
                fill = F.when(oc.isNotNull(), F.greatest(fill, oc * RECORD_CASHBACK_PER_ORDER)).otherwise(fill)
            out[name] = F.when(missing, fill.cast(f.dataType) if is_num else fill.cast("string")).otherwise(c)
        elif name in stats.mode:
            out[name] = F.when(missing, F.lit(stats.mode[name])).otherwise(c)
        else:
            low = name.lower()
            fb = 3 if ("score" in low and not any(k in low for k in ("tenure", "count", "number", "amount"))) else 0
            out[name] = F.when(missing, F.lit(fb).cast(f.dataType) if is_num else F.lit(str(fb))).otherwise(c)
    return _replace(df, out)


# N15 ------------------------------------------------------------------------
TRAINING_MEDIAN_COLUMNS = ["Tenure", "WarehouseToHome", "HourSpendOnApp", "OrderAmountHikeFromlastYear",
                           "CouponUsed", "OrderCount", "DaySinceLastOrder"]


def fill_median_columns(df: DataFrame, columns: list[str] = TRAINING_MEDIAN_COLUMNS) -> DataFrame:
    """Median fill of a named column list (training preparation);
    exact medians by distributed selection, one fused projection."""
    from retentio.operators.stats import exact_medians
    cols = [c for c in columns if c in df.columns]
    counts = df.agg(*[F.count(_c(c)).alias(c) for c in cols]).collect()[0]  # one row
    med = exact_medians(df, cols, {c: counts[c] for c in cols})
    return _replace(df, {c: F.coalesce(_c(c), F.lit(med[c]).cast(df.schema[c].dataType))
                         for c in cols if med[c] is not None})


# N16 / N17 ------------------------------------------------------------------
def merge_synonyms(df: DataFrame, synonyms: dict = SYNONYMS) -> DataFrame:
    """Merge category synonyms (Phone -> Mobile Phone, CC -> Credit Card, ...)."""
    out = {}
    for col, mapping in synonyms.items():
        if col in df.columns:
            expr = _c(col)
            for src, dst in mapping.items():
                expr = F.when(_c(col) == src, F.lit(dst)).otherwise(expr)
            out[col] = expr
    return _replace(df, out)


def binary_codes(df: DataFrame, codes: dict = BINARY_CODES) -> DataFrame:
    """Two-level categories to 0/1 (other values -> NULL)."""
    out = {}
    for col, mapping in codes.items():
        if col in df.columns:
            expr = None
            for k, v in mapping.items():
                expr = F.when(_c(col) == k, F.lit(v)) if expr is None else expr.when(_c(col) == k, F.lit(v))
            out[col] = expr.cast("int")
    return _replace(df, out)


# N18 / N19 / N20 ------------------------------------------------------------
def clip_lower(df: DataFrame, bounds: dict[str, float] | None = None) -> DataFrame:
    """OrderCount >= 1, Tenure >= 0, DaySinceLastOrder >= 0."""
    bounds = bounds or {"OrderCount": 1.0, "Tenure": 0.0, "DaySinceLastOrder": 0.0}
    return _replace(df, {c: F.greatest(_c(c), F.lit(b).cast(df.schema[c].dataType))
                         for c, b in bounds.items() if c in df.columns})


def missing_category(df: DataFrame, columns: list[str] = CATEGORICAL_COLUMNS) -> DataFrame:
    """Missing categorical -> 'Missing' (absent column -> constant)."""
    out = df
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit("Missing"))
    return _replace(out, {c: F.coalesce(_c(c), F.lit("Missing")) for c in columns})


def yes_no_to_int(c: Column) -> Column:
    """N20: 'Yes'/'yes' -> 1, 'No'/'no' -> 0, numbers kept, anything else -> 0."""
    low = F.lower(c.cast("string"))
    return (F.when(low == "yes", 1).when(low == "no", 0)
            .otherwise(F.coalesce(c.cast("string").try_cast("double").cast("int"), F.lit(0))))


# N21 ------------------------------------------------------------------------
def batch_clean(df: DataFrame, stats: Stats | None = None, strategy: str = "median") -> tuple[DataFrame, Stats]:
    """Statistics -> N1 -> N2 -> rules -> N9/N10 -> N11, in two passes.

    Pass 1 is the statistics job (skipped when ``stats`` is given, e.g. a
    versioned table for streams); pass 2 is one fused projection.
    """
    df = normalise_missing(df)
    if stats is None:
        stats = compute_stats(df)
    num = numeric_columns(df, ID_AND_LABEL)
    out = coerce_numeric(df, num)
    out = rule_impute(out)
    out = fill_numeric(out, stats, strategy)
    out = fill_categorical(out, stats)
    out = fill_last_resort(out)
    return out, stats
