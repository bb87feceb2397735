"""Customer-table sources.

* S1 CSV with a header, read with the canonical schema (no inference job);
  NA tokens become NULL in one projection.
* S2 JSON records (one object per line), batch or stream (S10).
* S3 the seeded demo generator, built on ``spark.range`` (distributed).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions import fixed as FX

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("CustomerID", T.StringType()),
    T.StructField("Tenure", T.DoubleType()),
    T.StructField("CityTier", T.IntegerType()),
    T.StructField("WarehouseToHome", T.DoubleType()),
    T.StructField("HourSpendOnApp", T.DoubleType()),
    T.StructField("SatisfactionScore", T.IntegerType()),
    T.StructField("Complain", T.IntegerType()),
    T.StructField("OrderAmountHikeFromlastYear", T.DoubleType()),
    T.StructField("CouponUsed", T.DoubleType()),
    T.StructField("OrderCount", T.DoubleType()),
    T.StructField("DaySinceLastOrder", T.DoubleType()),
    T.StructField("CashbackAmount", T.DoubleType()),
    T.StructField("NumberOfDeviceRegistered", T.IntegerType()),
    T.StructField("NumberOfAddress", T.IntegerType()),
    T.StructField("PreferredLoginDevice", T.StringType()),
    T.StructField("PreferredPaymentMode", T.StringType()),
    T.StructField("PreferedOrderCat", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("MaritalStatus", T.StringType()),
])

# FIXED VALUES: text read as missing by the CSV reader (pandas default tokens)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class InputError(ValueError):
    """A bad input is refused before any job starts."""


def check_csv_path(path: str | None, case_insensitive: bool = True) -> str:
    """A path is given, not empty, and names a ``.csv`` file or a folder (a name without an ending).

    Judged by the name alone: the path may lie in a store that only Spark reads.
    """
    if path is None:
        raise InputError("No file provided")
    if path == "":
        raise InputError("No file selected")
    name = path.rstrip("/").rpartition("/")[2]
    ok = name.lower().endswith(".csv") if case_insensitive else name.endswith(".csv")
    if not ok and "." in name:
        raise InputError("Only CSV files are supported")
    return path


def read_customers_csv(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """Header CSV, all columns read as text, NA tokens -> NULL, then typed
    with ``try_cast`` (bad text -> NULL, quirk Q18). Unknown extra columns are
    kept as text; missing schema columns are simply absent."""
    check_csv_path(path)
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for c in raw.columns:
        v = F.when(F.trim(F.col(f"`{c}`")).isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"`{c}`"))
        t = types.get(c, T.StringType())
        cols.append((v if isinstance(t, T.StringType) else v.try_cast(t)).alias(c))
    return raw.select(*cols)


def read_customers_json(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA) -> DataFrame:
    """One JSON object per line with an explicit schema (no inference)."""
    return spark.read.schema(schema).json(path)


CORRUPT = "_corrupt_record"


def rescued_records(spark: SparkSession, path: str, schema: T.StructType = CUSTOMER_SCHEMA, kind: str = "json",
                    header: bool = True) -> DataFrame:
    """Records with what did not parse: the schema's columns, ``line`` (the raw line, NULL if it parsed) and ``reason``.

    A line that is no record, or whose field does not fit its column, is
    rescued whole; ``reason`` tells which (of CSV: a wrong number of fields
    counts as no record). A record without an id is rescued too.
    """
    held = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(held).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    rows = reader.option("header", header).csv(path) if kind == "csv" else reader.json(path)
    idc = next((c for c in FX.ID_CANDIDATES if c in schema.names), None)
    line = F.col(CORRUPT)
    if kind == "json":
        whole = F.try_parse_json(line).isNotNull()
    else:
        whole = F.size(F.split(line, ",", -1)) == len(schema.fields)
    reason = F.when(line.isNotNull(), F.when(whole, "field of another type").otherwise("no record"))
    if idc:
        reason = F.coalesce(reason, F.when(F.col(f"`{idc}`").isNull(), F.lit("no id")))
        line = F.when(line.isNull() & F.col(f"`{idc}`").isNull(), F.to_json(F.struct(*[F.col(f"`{c}`") for c in schema.names]))).otherwise(line)
    return rows.select(*[F.col(f"`{c}`") for c in schema.names], line.alias("line"), reason.alias("reason"))


def quarantine(records: DataFrame, accepted_dir: str, rejected_dir: str) -> None:
    """S1/S2 sink of ``rescued_records``: records that parsed as parquet, the others as (reason, line) JSON, by reason."""
    good = records.where("reason is null").drop("line", "reason")
    good.write.mode("overwrite").parquet(accepted_dir)
    records.where("reason is not null").select("reason", "line").write.mode("overwrite").partitionBy("reason").json(rejected_dir)


def demo_customers(spark: SparkSession, n: int = 100, seed: int = 42) -> DataFrame:
    """S3: seeded demo rows -- uniform integers [lo, hi), a 0.9/0.1 complaint
    flag and uniform category choices, one seed per column. Distributed over
    ``spark.range`` (not a Python loop)."""
    def uni(lo, hi, k):
        return (F.floor(F.rand(seed + k) * (hi - lo)) + lo)

    def choice(values, k):
        arr = F.array(*[F.lit(v) for v in values])
        return F.element_at(arr, (F.floor(F.rand(seed + k) * len(values)) + 1).cast("int"))
    return spark.range(n).select(
        uni(1, 36, 1).cast("double").alias("Tenure"),
        uni(1, 4, 2).cast("int").alias("CityTier"),
        uni(5, 50, 3).cast("double").alias("WarehouseToHome"),
        uni(10, 120, 4).cast("double").alias("HourSpendOnApp"),
        uni(1, 6, 5).cast("int").alias("SatisfactionScore"),
        F.when(F.rand(seed + 6) < 0.1, 1).otherwise(0).alias("Complain"),
        uni(5, 30, 7).cast("double").alias("OrderAmountHikeFromlastYear"),
        uni(0, 10, 8).cast("double").alias("CouponUsed"),
        uni(1, 50, 9).cast("double").alias("OrderCount"),
        uni(1, 90, 10).cast("double").alias("DaySinceLastOrder"),
        uni(100, 20000, 11).cast("double").alias("CashbackAmount"),
        uni(1, 5, 12).cast("int").alias("NumberOfDeviceRegistered"),
        uni(1, 6, 13).cast("int").alias("NumberOfAddress"),
        choice(["Mobile Phone", "Computer"], 14).alias("PreferredLoginDevice"),
        choice(["Credit Card", "Debit Card", "UPI"], 15).alias("PreferredPaymentMode"),
        choice(["Laptop & Accessory", "Mobile", "Fashion", "Grocery"], 16).alias("PreferedOrderCat"),
        choice(["Male", "Female"], 17).alias("Gender"),
        choice(["Single", "Married"], 18).alias("MaritalStatus"),
    )


def load_or_demo(spark: SparkSession, path: str | None) -> DataFrame:
    """The uploaded table when a path is given, else demo rows; tagged."""
    if path:
        return read_customers_csv(spark, path).withColumn("data_source", F.lit("uploaded"))
    return demo_customers(spark).withColumn("data_source", F.lit("demo"))


def benchmarks(spark: SparkSession) -> DataFrame:
    """The benchmark profile and risk directions as a (tiny) table."""
    return spark.createDataFrame([(m, float(b), int(d)) for m, b, d in FX.BENCHMARKS],
                                 "metric string, benchmark double, direction int")


def run_stamp(now: dt.datetime | None = None) -> str:
    """Timestamp for output names (``%Y-%m-%d_%H-%M-%S``)."""
    return (now or dt.datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
