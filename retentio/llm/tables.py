"""Spark helpers shared by the text operators: written tables, ranks, components, row keys.

Intermediate results are Parquet tables in the folder that the cluster names
in ``spark.checkpoint.dir``, so a lost executor costs only the tasks at hand.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import ensure_checkpoint_dir

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver does, from whatever folder they start."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/retentio-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based place in ``order``, without one task that sees all rows.

    Rows are range-partitioned and sorted; each partition's rows are numbered
    where they lie, the table is written, and one count per partition (as many
    numbers as partitions, never more) gives each partition's offset.
    """
    spark = df.sparkSession
    # row numbers and partition numbers are the two halves of this id
    placed = saved(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part).count().collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = spark.createDataFrame(offsets, "__part int, __offset long")
    return (placed.withColumn("__part", part).join(F.broadcast(table), "__part")
            .withColumn(name, F.col("__offset") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("__part", "__offset", "__at"))


def text_key(text: Column | str = "text") -> Column:
    """A 128-bit digest of a whole text; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, whole text) is not in ``rejected`` (columns doc_id, key)."""
    gone = rejected.select(F.col("doc_id").alias("__gone"), F.col("key").alias("__gone_key")).distinct()
    keyed = docs.withColumn("__key", text_key())
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__gone"]) & (keyed["__key"] == gone["__gone_key"]),
                      "left_anti").drop("__key")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node of an edge.

    Alternating star contraction: each node's larger neighbours, then its
    smaller ones, are linked to the smallest, until nothing changes. Each pass
    is two aggregations that combine before the shuffle and two joins; the
    rounds grow with the logarithm of the longest path.
    """
    def smallest(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("n"), F.col("b").alias("m")).union(
            e.select(F.col("b").alias("n"), F.col("a").alias("m")))
        return both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("n", "least").alias("least"))

    now = saved(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        # large star: every larger neighbour of n goes to the least node around n
        least = smallest(now)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (both.where("b > a").join(least, both["a"] == least["n"]).select(F.col("least").alias("a"), "b")
                 .where("a <> b").distinct())
        large = saved(large)
        # small star: n and its smaller neighbours go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("least"))
        small = (large.join(low, "b").select(F.col("least").alias("x"), F.col("a").alias("y"))
                 .union(low.select(F.col("least").alias("x"), F.col("b").alias("y"))).where("x <> y")
                 .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        small = saved(small)
        # done when every edge hangs on a node that hangs on nothing itself, once
        roots = small.select(F.col("a").alias("n")).distinct()
        open_ = small.groupBy("b").agg(F.count("*").alias("k")).join(roots, F.col("b") == F.col("n"), "left")
        if not open_.where("k > 1 or n is not null").head(1):
            break
        now = small
    return small.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        small.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
