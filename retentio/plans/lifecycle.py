"""The reference's end-to-end flows as Spark jobs.

* ``analyze_batch``  — §3.1 batch analysis: load (or demo) -> statistics ->
  clean -> features -> score -> bands -> one-row analysis + the records.
* ``full_report``     — §3.3 report: the scored table written ONCE, then the
  customers / summary / metadata outputs read from it.
* ``risk_export``     — the risk-filtered export (F6-F8, S7).
* ``score_records``   — §3.2 record scoring as a stream over JSON records.
* ``train``           — §3.4 training: split, fit the ensemble, evaluate, save.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.operators import analyze as A
from retentio.operators import ml as M
from retentio.operators import rows as W
from retentio.operators.stats import Stats
from retentio.operators.clean import merge_synonyms
from retentio.plans.batch import clean_customers, materialise, score_customers
from retentio.sources import customers as C
from retentio.sources import sinks as K


def load_model(path: str | None):
    """The scorecard by default, else a saved ensemble."""
    return "scorecard" if not path else M.EnsembleModel.load(path)


def score_table(customers: DataFrame, model="scorecard", stats: Stats | None = None) -> tuple[DataFrame, Stats]:
    """Statistics -> clean -> features -> score -> bands; the result is
    materialised once (reports read it instead of recomputing)."""
    base = materialise(customers)
    cleaned, st = clean_customers(base, stats)
    return materialise(score_customers(cleaned, st, model)), st


def analyze_batch(spark: SparkSession, path: str | None, model="scorecard") -> tuple[DataFrame, DataFrame]:
    """§3.1: (one-row analysis result, scored records)."""
    customers = C.load_or_demo(spark, path)
    scored, _ = score_table(customers.drop("data_source"), model)
    return A.analysis_result(scored), scored


def full_report(spark: SparkSession, path: str, out_dir: str, model="scorecard") -> str:
    """§3.3: the full report folder (customers, summary, metadata)."""
    scored, _ = score_table(C.read_customers_csv(spark, path), model)
    return K.write_full_report(scored, out_dir)


def risk_export(spark: SparkSession, path: str, out_dir: str, level: str = "high", model="scorecard") -> str:
    """One risk band as header CSV (id kept, quirk Q14)."""
    lv = W.check_risk_argument(level)
    scored, _ = score_table(C.read_customers_csv(spark, path), model)
    target = os.path.join(out_dir, f"churn_analysis_{lv}_risk_customers_{C.run_stamp()}")
    W.risk_customers(scored, lv).write.mode("overwrite").option("header", True).csv(target)
    return target


def score_records(spark: SparkSession, source_dir: str, stats_path: str, out_dir: str, checkpoint_dir: str,
                  rejected_dir: str | None = None, model="scorecard") -> DataFrame:
    """§3.2: JSON records scored by the stream against a statistics version."""
    from retentio.streaming.scoring import load_stats, run_stream_scoring
    return run_stream_scoring(spark, source_dir, C.CUSTOMER_SCHEMA, load_stats(spark, stats_path), out_dir,
                              checkpoint_dir, rejected_dir, model)


def train(spark: SparkSession, path: str, model_out: str, label: str = "Churn",
          cfg: M.EnsembleConfig | None = None) -> DataFrame:
    """§3.4: stratified split, class weights, fit RF + two GBTs, evaluate on the
    hold-out rows, save the pipeline. Returns the classification report."""
    from retentio.operators.features import align_features, business_features
    raw = C.read_customers_csv(spark, path)
    if label not in raw.columns:
        raise C.InputError(f"training needs the label column {label!r}")
    raw = raw.withColumn(label, F.col(label).try_cast("int")).where(F.col(label).isNotNull())
    base = materialise(merge_synonyms(raw))  # N16: one name a category before statistics and dummies
    cleaned, st = clean_customers(base)
    idc = W.find_id_column(cleaned)
    # deterministic split key: the id, else a hash of the whole row (stable
    # when a lost partition is recomputed, unlike a generated row number)
    key = F.col(idc) if idc else F.xxhash64(*[F.col(f"`{c}`") for c in cleaned.columns])
    row_hash = F.pmod(F.xxhash64(key, F.lit(42)), F.lit(2 ** 52))
    split = M.stratified_split(cleaned, label, row_hash=row_hash).withColumnRenamed("split", "__split")
    feats = materialise(align_features(business_features(split, st), keep=(label, "__split")))
    train_rows = feats.where("__split = 'train'")
    # weights from the training rows alone: balanced for the forest, neg/pos for the boosted trees
    train_rows = train_rows.withColumns({"__w": M.class_weights(train_rows, label),
                                         "__ratio": M.class_weights(train_rows, label, mode="ratio")})
    model = M.fit_ensemble(train_rows, label=label, cfg=cfg, weight_col="__w", boost_weight_col="__ratio")
    model.save(model_out)
    return M.classification_report(model.score(feats.where("__split = 'test'")), label=label)
