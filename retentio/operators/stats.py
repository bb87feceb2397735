"""Column statistics for imputation (N3, N4): count, mean, exact median, mode.

Scale notes
-----------
* count / mean: one wide aggregate with partial (map-side) aggregation.
* mode (strings): count per (column, value), then per column the minimum of
  ``(-count, value)`` -- two combinable aggregates, lowest value wins a tie.
* median / quantiles: exact, without pulling a column into one task. Spark's
  ``median`` keeps every distinct value of a global group in one buffer,
  which does not hold at 100 TB. Instead a radix selection (``select_ranks``)
  reads a value's 64-bit order-preserving key 16 bits at a time: four
  combinable counts by digit, for all ranks of all columns at once, whatever
  the data. No sketch, no row is ever ranked.

The result is a small DataFrame ``(column, kind, n_valid, mean, median,
mode)``; ``Stats`` holds it as plain values (one per column) for literal
substitution in the cleaning expressions.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions.columns import nan_to_null, numeric_columns, string_columns
from retentio.functions.fixed import CATEGORICAL_DEFAULTS, ID_CANDIDATES, NUMERIC_DEFAULTS

STATS_SCHEMA = T.StructType([
    T.StructField("column", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("n_valid", T.LongType(), False),
    T.StructField("mean", T.DoubleType(), True),
    T.StructField("median", T.DoubleType(), True),
    T.StructField("mode", T.StringType(), True),
])

#: Every spelling of the id column, and the label.
DEFAULT_EXCLUDE = (*ID_CANDIDATES, "Churn")


@dataclass
class Stats:
    """Imputation statistics, one entry per column (bounded by the schema width)."""
    mean: dict = field(default_factory=dict)
    median: dict = field(default_factory=dict)
    mode: dict = field(default_factory=dict)
    n_valid: dict = field(default_factory=dict)

    def numeric(self, column: str, strategy: str = "median"):
        src = self.mean if strategy == "mean" else self.median
        if column in src and src[column] is not None:
            return src[column]
        return NUMERIC_DEFAULTS.get(column, 0.0)

    def categorical(self, column: str):
        if column in self.mode and self.mode[column] is not None:
            return self.mode[column]
        return CATEGORICAL_DEFAULTS.get(column, "Missing")

    @staticmethod
    def defaults() -> "Stats":
        s = Stats()
        for k, v in NUMERIC_DEFAULTS.items():
            s.mean[k] = v
            s.median[k] = v
        s.mode.update(CATEGORICAL_DEFAULTS)
        return s

    def fingerprint(self) -> str:
        """A digest of all values: two cleanings are the same if their statistics have one."""
        told = repr([sorted(d.items()) for d in (self.mean, self.median, self.mode, self.n_valid)])
        return hashlib.sha256(told.encode()).hexdigest()[:16]

    @staticmethod
    def from_rows(rows) -> "Stats":
        """From (column, kind, n_valid, mean, median, mode) rows."""
        s = Stats()
        for column, kind, n_valid, mean, median, mode in rows:
            s.n_valid[column] = n_valid
            if kind == "numeric":
                s.mean[column] = mean
                s.median[column] = median
            else:
                s.mode[column] = mode
        return s

    @staticmethod
    def from_table(stats_df: DataFrame) -> "Stats":
        """From a stored (versioned) statistics table; one row per column."""
        return Stats.from_rows([tuple(r) for r in stats_df.collect()])

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        for c in self.median:
            rows.append((c, "numeric", int(self.n_valid.get(c, 0)), float(self.mean[c]), float(self.median[c]), None))
        for c in self.mode:
            rows.append((c, "categorical", int(self.n_valid.get(c, 0)), None, None, self.mode[c]))
        return spark.createDataFrame(rows, STATS_SCHEMA)


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value) for every non-null numeric cell, after NaN/inf -> NULL."""
    prepared = df.select(*[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    return (prepared.unpivot([], cols, "column", "value")
            .where(F.col("value").isNotNull()))


#: Bits of a key, and those that one round reads.
KEY_BITS, DIGIT_BITS = 64, 16


def order_key(value: Column) -> Column:
    """A long that orders as the finite double ``value`` does: its exponent and fraction, negative for negative values.

    The two powers of two on either side of a value tell its exponent exactly, whatever the logarithm rounds to.
    """
    def magnitude(a: Column) -> Column:
        near = F.floor(F.log2(a)).cast("double")
        m = a / F.pow(F.lit(2.0), near)
        e = near + F.when(m >= 2, 1.0).when(m < 1, -1.0).otherwise(0.0)
        normal = (F.shiftleft((e + 1023).cast("long"), 52)
                  + ((a / F.pow(F.lit(2.0), e) - 1) * float(1 << 52)).cast("long"))
        # below the least normal double there is no exponent to tell
        return F.when(a < 2.0 ** -1022, (a * 2.0 ** 537 * 2.0 ** 537).cast("long")).otherwise(normal)

    return (F.when(value > 0, magnitude(value)).when(value < 0, -magnitude(-value))
            .when(value == 0, F.lit(0).cast("long")))


def key_value(key: int) -> float:
    """The double of an ``order_key``."""
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


def select_ranks(long: DataFrame, keys: dict) -> None:
    """Exact order statistics of a (column, value) long table of finite doubles.

    ``keys[(column, tag)]`` = {"ranks": (r1, r2)} (0-based ranks among the
    column's values); on return each key has ``found[rank]``.

    A rank is open with the digits of its key found so far (at first none). A
    round counts, for each such prefix, how many values have which next digit
    (at most 2 ** 16 rows a prefix, combined before the shuffle), adds the
    counts up in order inside one row a prefix, and takes the digit in which
    the rank falls. Four rounds find the whole key, whatever the values.
    """
    spark = long.sparkSession
    # (column, rank) -> prefix, and how many values of the column lie below it
    open_: dict[tuple[str, int], tuple[int, int]] = {(c, r): (0, 0) for (c, _), st in keys.items() for r in st["ranks"]}
    if not open_:
        return
    # with the sign bit turned over, digits are unsigned and order as keys do
    cells = long.select("column", order_key(F.col("value")).bitwiseXOR(F.lit(-1 << 63)).alias("key"))
    for done in range(0, KEY_BITS, DIGIT_BITS):
        slots = sorted({(c, prefix) for (c, _), (prefix, _) in open_.items()})
        number = {slot: i for i, slot in enumerate(slots)}
        # the shift is data, so that the plan of every round is the same code
        of = pa.table({"column": [c for c, _ in slots], "prefix": [p for _, p in slots], "slot": list(range(len(slots))),
                       "shift": [KEY_BITS - DIGIT_BITS - done] * len(slots)},
                      pa.schema([("column", pa.string()), ("prefix", pa.int64()), ("slot", pa.int32()), ("shift", pa.int32())]))
        ranks: list[list[int]] = [[] for _ in slots]
        for (c, r), (prefix, below) in open_.items():
            ranks[number[c, prefix]].append(r - below)
        wanted = pa.table({"slot": list(range(len(slots))), "wanted": ranks},
                          pa.schema([("slot", pa.int32()), ("wanted", pa.list_(pa.int64()))]))
        upto = F.expr("shiftrightunsigned(key, shift)")
        counted = (cells.join(F.broadcast(spark.createDataFrame(of)), "column")
                   .where(F.shiftrightunsigned(upto, DIGIT_BITS) == F.col("prefix"))
                   .groupBy("slot", upto.alias("upto")).agg(F.count(F.lit(1)).alias("n")))
        in_order = counted.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("upto", "n"))).alias("counts"))

        def place(rank: Column) -> Column:
            start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("long").alias("upto"),
                             F.lit(0).cast("long").alias("below"))
            return F.aggregate("counts", start, lambda acc, x: F.when(
                acc["upto"].isNull() & (rank < acc["total"] + x["n"]),
                F.struct((acc["total"] + x["n"]).alias("total"), x["upto"].alias("upto"), acc["total"].alias("below"))).otherwise(
                F.struct((acc["total"] + x["n"]).alias("total"), acc["upto"].alias("upto"), acc["below"].alias("below"))))

        found = in_order.join(F.broadcast(spark.createDataFrame(wanted)), "slot").select(
            "slot", F.explode(F.transform("wanted", lambda r: F.struct(r.alias("rank"), place(r).alias("at")))).alias("x"))
        at = {(row["slot"], row["rank"]): (row["upto"], row["below"]) for row in found.select(
            "slot", "x.rank", "x.at.upto", "x.at.below").collect()}  # one row per rank
        for (c, r), (prefix, below) in open_.items():
            upto, more = at.get((number[c, prefix], r - below), (None, 0))
            if upto is None:
                raise ValueError(f"rank {r} is beyond the values of column {c}")
            open_[c, r] = upto, below + more
    for (c, _), st in keys.items():
        st["found"] = {r: key_value(open_[c, r][0] + (1 << 63) if open_[c, r][0] < 0 else open_[c, r][0] - (1 << 63))
                       for r in st["ranks"]}


def exact_quantiles(df: DataFrame, cols: list[str], counts: dict[str, int], qs: list[float]) -> dict[str, dict[float, float]]:
    """Exact linear-interpolated quantiles per column (see module notes).

    Quantile q of n values sits at position q*(n-1); the two neighbouring
    order statistics are found by distributed selection and interpolated as
    ``lo + (hi - lo) * frac``.
    """
    result = {c: {qv: None for qv in qs} for c in cols}
    if not cols:
        return result
    keys: dict[tuple[str, int], dict] = {}
    for c in cols:
        n = counts.get(c) or 0
        if n == 0:
            continue
        for qi, qv in enumerate(qs):
            pos = qv * (n - 1)
            lo = int(math.floor(pos))
            keys[(c, qi)] = {"ranks": (lo, int(math.ceil(pos))), "frac": pos - lo}
    if keys:
        select_ranks(_long_numeric(df, cols), keys)
    for (c, qi), st in keys.items():
        lo_r, hi_r = st["ranks"]
        a, b = st["found"][lo_r], st["found"][hi_r]
        result[c][qs[qi]] = a if lo_r == hi_r else a + (b - a) * st["frac"]
    return result


def exact_medians(df: DataFrame, cols: list[str], counts: dict[str, int]) -> dict[str, float]:
    """Exact median per column (distributed selection)."""
    q = exact_quantiles(df, cols, counts, [0.5])
    return {c: q[c][0.5] for c in cols}


def column_stats(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
                 exclude: tuple[str, ...] = DEFAULT_EXCLUDE) -> DataFrame:
    """The statistics table ``(column, kind, n_valid, mean, median, mode)``."""
    rows = stats_rows(df, numeric, categorical, exclude)
    return df.sparkSession.createDataFrame(rows, STATS_SCHEMA)


def stats_rows(df: DataFrame, numeric: list[str] | None = None, categorical: list[str] | None = None,
               exclude: tuple[str, ...] = DEFAULT_EXCLUDE) -> list[tuple]:
    """The statistics as plain rows, one per column (already on the driver)."""
    numeric = numeric if numeric is not None else numeric_columns(df, exclude)
    categorical = categorical if categorical is not None else string_columns(df, exclude)

    aggs = []
    for c in numeric:
        v = nan_to_null(F.col(f"`{c}`").cast("double"))
        aggs += [F.count(v).alias(f"n::{c}"), F.avg(v).alias(f"mean::{c}")]
    for c in categorical:
        aggs.append(F.count(F.col(f"`{c}`")).alias(f"n::{c}"))
    wide = df.agg(*aggs).collect()[0] if aggs else None  # one row

    modes: dict[str, str] = {}
    if categorical:
        long_s = (df.select(*[F.col(f"`{c}`").alias(c) for c in categorical])
                  .unpivot([], categorical, "column", "value")
                  .where(F.col("value").isNotNull()))
        for r in (long_s.groupBy("column", "value").count()
                  .groupBy("column")
                  .agg(F.min(F.struct(F.negative("count").alias("nc"), F.col("value"))).alias("m"))
                  .select("column", F.col("m.value").alias("mode")).collect()):
            modes[r["column"]] = r["mode"]

    counts = {c: wide[f"n::{c}"] for c in numeric}
    medians = exact_medians(df, numeric, counts)

    rows = []
    for c in numeric:
        n = counts[c]
        if n > 0:
            rows.append((c, "numeric", n, float(wide[f"mean::{c}"]), float(medians[c]), None))
        else:  # all values missing: default by name, else 0
            d = float(NUMERIC_DEFAULTS.get(c, 0.0))
            rows.append((c, "numeric", 0, d, d, None))
    for c in categorical:
        n = wide[f"n::{c}"]
        rows.append((c, "categorical", n, None, None,
                     modes.get(c) if n > 0 else CATEGORICAL_DEFAULTS.get(c, "Missing")))
    return rows


def compute_stats(df: DataFrame, **kw) -> Stats:
    return Stats.from_rows(stats_rows(df, **kw))
