"""Record-at-a-time scoring as Structured Streaming.

The single-record route becomes a stateless stream: JSON records arrive in
a folder, are imputed field by field against a *versioned* statistics table
(explicit input: a stream cannot compute global statistics, and scores must
not depend on the previous upload), checked, and those that pass are scored
and explained into a parquet sink with exactly-once file commits. Records that
break a rule are never scored; they go to their own sink (V9). ``availableNow`` drains what is there
and stops; a long-running trigger works the same way.
"""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.operators import risk as R
from retentio.operators import validate as V
from retentio.operators.clean import normalise_missing, record_clean
from retentio.operators.stats import Stats
from retentio.plans.batch import score_customers
from retentio.session import ensure_checkpoint_dir


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return os.path.join(ensure_checkpoint_dir(spark), name, uuid.uuid4().hex)


def save_stats(stats: Stats, spark: SparkSession, path: str) -> None:
    """Write a statistics version (one row per column) for streams to read."""
    stats.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> Stats:
    """Read a statistics version written by ``save_stats``."""
    return Stats.from_table(spark.read.parquet(path))


def publish_stats(stats: Stats, spark: SparkSession, folder: str) -> int:
    """The next version of a statistics table (``version=1``, ``version=2``, ..), seen by streams from their next batch on."""
    version = (newest_version(spark, folder) or 0) + 1
    save_stats(stats, spark, os.path.join(folder, f"version={version}"))
    return version


def newest_version(spark: SparkSession, folder: str) -> int | None:
    try:
        return spark.read.parquet(folder).agg(F.max("version")).first()[0]
    except AnalysisException:  # nothing published yet
        return None


def run_versioned_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, stats_dir: str, out_dir: str,
                          checkpoint_dir: str, importances: list[tuple[str, float]] | None = None,
                          model="scorecard") -> DataFrame:
    """Drain ``source_dir`` (JSON lines), every micro-batch with the newest statistics version that is published
    when it starts; ``stats_version`` is written with each score.

    A batch writes a folder of its own and overwrites it when it is run again, so a restart scores nothing twice.
    """
    def score(batch: DataFrame, number: int) -> None:
        version = newest_version(spark, stats_dir)
        if version is None:
            raise ValueError(f"no statistics version is published under {stats_dir}")
        stats = load_stats(spark, os.path.join(stats_dir, f"version={version}"))
        (score_stream(batch, stats, importances, model).withColumn("stats_version", F.lit(int(version)).cast("long"))
         .write.mode("overwrite").parquet(os.path.join(out_dir, f"batch={number}")))

    (spark.readStream.schema(schema).json(source_dir).writeStream.foreachBatch(score)
     .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start().awaitTermination())
    return spark.read.parquet(out_dir).drop("batch")


def imputed_records(records: DataFrame, stats: Stats) -> DataFrame:
    """Records as the rules and the scorer see them."""
    return record_clean(normalise_missing(records), stats)


def score_stream(records: DataFrame, stats: Stats, importances: list[tuple[str, float]] | None = None,
                 model="scorecard") -> DataFrame:
    """Accepted records, scored and explained (projections only): impute, drop
    those that break a rule, score; record band, impact, recommendations,
    primary factor and top driver."""
    scored = score_customers(V.accepted(imputed_records(records, stats)), stats, model)
    p = F.col("Churn_Probability")
    driver = R.top_driver(scored, importances)
    factor = R.primary_risk_factor(driver=driver)
    return R.business_impact(scored.withColumns({
        "top_driver": driver, "primary_risk_factor": factor,
        "recommendations": F.concat_ws("\n", R.record_recommendations(p))}))


def reject_stream(records: DataFrame, stats: Stats) -> DataFrame:
    """The imputed records that break a rule, with ``errors`` (V9)."""
    return V.rejected(imputed_records(records, stats))


def run_stream_scoring(spark: SparkSession, source_dir: str, schema: T.StructType, stats: Stats,
                       out_dir: str, checkpoint_dir: str, rejected_dir: str | None = None,
                       importances: list[tuple[str, float]] | None = None, model="scorecard",
                       scored_at: str | None = None) -> DataFrame:
    """Drain ``source_dir`` (JSON lines) through the scorer into ``out_dir``, rejected records into ``rejected_dir``.

    ``scored_at`` is the run's ISO time, written with every scored record (X13).
    """
    src = spark.readStream.schema(schema).json(source_dir)
    queries = []
    if rejected_dir:
        queries.append(reject_stream(src, stats).writeStream.format("json")
                       .option("checkpointLocation", checkpoint_dir + "-rejected")
                       .trigger(availableNow=True).start(rejected_dir))
    stamp = scored_at or dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
    scored = score_stream(src, stats, importances, model).withColumn("timestamp", F.lit(stamp))
    queries.append(scored.writeStream.format("parquet").option("checkpointLocation", checkpoint_dir)
                   .trigger(availableNow=True).start(out_dir))
    for q in queries:
        q.awaitTermination()
    return spark.read.parquet(out_dir)
