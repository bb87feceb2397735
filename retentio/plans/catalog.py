"""Registry of named queries (one per inventory id) and their SQL oracles.

Every query starts from the driver tables through the customer mart, so its
work grows with the data. Doubles leaving a query are rounded with
``round_half_away(x, 6)`` -- the same IEEE arithmetic the oracle uses -- so
the value hash does not depend on summation order.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import round_half_away
from retentio.plans import oracle_sql as O
from retentio.plans.mart import customer_mart

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def stable(df: DataFrame, digits: int = O.DIGITS) -> DataFrame:
    """Round every double column (presentation only)."""
    return df.select(*[round_half_away(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def widen(df: DataFrame, cols: list[str]) -> DataFrame:
    """Integer columns that hold NULLs leave the query as double, so a
    pandas-based comparison sees the same dtype on both sides."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if c in cols else F.col(f"`{c}`")
                       for c in df.columns])


# ---------------------------------------------------------------------------
# shared stages, built once per session and data folder
# ---------------------------------------------------------------------------
_SHARED: dict = {}


def _shared(kind: str, spark: SparkSession, sf: str, build):
    """The mart and the scored table (by risk band) are written once as parquet
    into the shared ``spark.checkpoint.dir``, statistics are computed once --
    every report reads the columns and bands that it needs of these instead of
    re-running the joins (the reference recomputes per request)."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _SHARED:
        _SHARED[key] = build()
    return _SHARED[key]


def mart(spark, sf):
    from retentio.plans.batch import materialise
    return _shared("mart", spark, sf, lambda: materialise(customer_mart(spark, sf)))


def stats(spark, sf):
    """One statistics object (means, medians, modes) for all strategies."""
    from retentio.operators.clean import normalise_missing
    from retentio.operators.stats import compute_stats
    return _shared("stats", spark, sf, lambda: compute_stats(normalise_missing(mart(spark, sf))))


def cleaned(spark, sf, strategy="median"):
    from retentio.plans.batch import clean_customers
    return _shared(f"cleaned:{strategy}", spark, sf,
                   lambda: clean_customers(mart(spark, sf), stats(spark, sf), strategy=strategy))


def features(spark, sf):
    from retentio.operators.features import business_features

    def build():
        cl, st = cleaned(spark, sf)
        return business_features(cl, st)
    return _shared("features", spark, sf, build)


def scored(spark, sf):
    from retentio.plans.batch import materialise, score_customers

    def build():
        cl, st = cleaned(spark, sf)
        return materialise(score_customers(cl, st), partition_by="Risk_Level")
    return _shared("scored", spark, sf, build)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mart -> clean -> features -> score -> risk distribution (A1-A4)."""
    from retentio.operators.analyze import risk_summary
    return stable(risk_summary(scored(spark, sf_dir)))


from retentio.plans import queries_core  # noqa: E402,F401  (registers queries)
from retentio.plans import queries_analysis  # noqa: E402,F401
from retentio.plans import queries_io  # noqa: E402,F401
from retentio.plans import queries_extra  # noqa: E402,F401
