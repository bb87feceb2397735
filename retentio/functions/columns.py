"""Column-expression helpers shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def string_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def nan_to_null(c: Column) -> Column:
    """NaN, +inf and -inf become NULL (the first cleaning step)."""
    d = c.cast("double")
    return F.when(F.isnan(d) | d.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(c)


def js_round(c: Column) -> Column:
    """To the nearest whole number, halves upwards (also below zero)."""
    return F.floor(c + 0.5)


def js_number(c: Column) -> Column:
    """A number as text: whole ones without a decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("bigint").cast("string")).otherwise(c.cast("double").cast("string"))


def round_half_away(c: Column, digits: int) -> Column:
    """Deterministic decimal rounding ``floor(x*10^d + 0.5) / 10^d``.

    Written as plain IEEE arithmetic so other engines give the bit-identical
    value; used only for presentation of doubles in reports.
    """
    scale = float(10 ** digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def percent_text(p: Column) -> Column:
    """``round(p*100, 2)`` rendered with a trailing ``%`` (half to even, as numpy)."""
    return F.concat(F.bround(p * 100.0, 2).cast("string"), F.lit("%"))


def money_text(x: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(x, 2))
