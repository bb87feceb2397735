"""Profiling operators.

Per-column profiles are computed as ONE wide aggregate (partial aggregation,
one row out) and then unpivoted, instead of one job per column. Value counts
are ``groupBy`` over the unpivoted (column, value) pairs; shares divide by
per-column totals from one small aggregate (no window over a column's
distinct values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import NUMERIC_TYPES, nan_to_null
from retentio.operators.clean import _c


def shape(df: DataFrame) -> DataFrame:
    """Rows, columns, numeric and string column counts."""
    n_num = sum(isinstance(f.dataType, NUMERIC_TYPES) for f in df.schema.fields)
    n_str = sum(isinstance(f.dataType, T.StringType) for f in df.schema.fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(n_num).alias("n_numeric"),
        F.lit(n_str).alias("n_string"))


def dtypes(df: DataFrame) -> list[tuple[str, str]]:
    """(column, Spark type) from the schema (no job)."""
    return df.dtypes


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles, max per numeric column."""
    from retentio.operators.stats import exact_quantiles
    x = {c: nan_to_null(_c(c).cast("double")) for c in cols}
    aggs = []
    for c in cols:
        aggs += [F.count(x[c]).alias(f"n::{c}"), F.avg(x[c]).alias(f"mean::{c}"),
                 F.stddev_samp(x[c]).alias(f"std::{c}"), F.min(x[c]).alias(f"min::{c}"),
                 F.max(x[c]).alias(f"max::{c}")]
    row = df.agg(*aggs).collect()[0]  # one row
    counts = {c: row[f"n::{c}"] for c in cols}
    qs = exact_quantiles(df, cols, counts, [0.25, 0.5, 0.75])
    rows = [(c, counts[c], row[f"mean::{c}"], row[f"std::{c}"], row[f"min::{c}"],
             qs[c][0.25], qs[c][0.5], qs[c][0.75], row[f"max::{c}"]) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "column string, count bigint, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double")


def _one_row_unpivot(df: DataFrame, aggs: dict[str, F.Column], value_name: str) -> DataFrame:
    wide = df.agg(*[v.alias(k) for k, v in aggs.items()])
    return wide.unpivot([], list(aggs), "column", value_name)


def null_counts(df: DataFrame) -> DataFrame:
    """NULL (and NaN) count per column, one aggregate."""
    def miss(f):
        c = _c(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.count_if(c.isNull() | F.isnan(c))
        return F.count_if(c.isNull())
    return _one_row_unpivot(df, {f.name: miss(f).cast("long") for f in df.schema.fields}, "null_count")


def null_percent(df: DataFrame) -> DataFrame:
    """Null count * 100 / rows."""
    n = F.count(F.lit(1))
    aggs = {}
    for f in df.schema.fields:
        c = _c(f.name)
        m = c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()
        aggs[f.name] = F.count_if(m) * 100.0 / n
    return _one_row_unpivot(df, aggs, "null_pct")


def valid_counts(df: DataFrame) -> DataFrame:
    """Non-null count per column and whether any valid value exists."""
    out = _one_row_unpivot(df, {c: F.count(_c(c)) for c in df.columns}, "n_valid")
    return out.withColumn("has_valid", F.col("n_valid") > 0)


def _long_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[_c(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "value")


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """P5: distinct values per column (NULL included), one shuffle."""
    return _long_strings(df, cols).distinct()


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts per column, NULLs left out."""
    return (_long_strings(df, cols).where(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count(F.lit(1)).alias("count")))


def value_share(df: DataFrame, cols: list[str]) -> DataFrame:
    """Value counts as percent of the column's non-null rows.

    The per-column totals come from one small aggregate (one number per
    column) applied as a literal map -- no window holding every distinct
    value of a column in one task.
    """
    tot = df.agg(*[F.count(_c(c)).alias(c) for c in cols]).collect()[0]  # one row
    totals = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(int(tot[c])))])
    return value_counts(df, cols).withColumn(
        "pct", F.col("count") * 100.0 / F.element_at(totals, F.col("column")))


def dataset_rows(df: DataFrame) -> DataFrame:
    """P10: rows and feature count of a table."""
    return df.agg(F.count(F.lit(1)).alias("total_customers")).withColumn("total_features", F.lit(len(df.columns)))


def write_observed(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as parquet, and what that one job observed of it, a row per column:
    (position, name, type, n_null, total_customers, total_features, dataset_size_kb).

    Rows, bytes as CSV (with its header line) and missing values are metrics
    of the write itself; nothing is scanned again.
    """
    seen = Observation("dataset")
    line = F.to_csv(F.struct(*[_c(c) for c in df.columns]))
    missing = [F.count_if(nan_to_null(_c(f.name)).isNull() if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                          else _c(f.name).isNull()).alias(f"null_{i}") for i, f in enumerate(df.schema.fields)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length(line) + 1).alias("bytes"), *missing).write.parquet(path)
    got = seen.get
    size = ((got["bytes"] or 0) + len(",".join(df.columns).encode()) + 1) / 1024.0
    rows = [(i, f.name, f.dataType.simpleString(), got[f"null_{i}"], got["rows"], len(df.columns), size)
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, type string, n_null long, total_customers long, total_features int, dataset_size_kb double")


def class_ratio(df: DataFrame, label: str = "Churn") -> DataFrame:
    """Class counts and imbalance ratio negatives / positives."""
    y = _c(label)
    return df.agg(F.count_if(y == 0).alias("n_negative"), F.count_if(y == 1).alias("n_positive")).withColumn(
        "imbalance_ratio", F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive")))


def preview(df: DataFrame, n: int = 10, order_by: str | None = None) -> DataFrame:
    """The first n rows (by ``order_by`` when given: per-partition top-n)."""
    return (df.orderBy(order_by) if order_by else df).limit(n)


def with_row_count(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """``df`` with its row count as an observed metric of whatever job runs it (no extra pass)."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
