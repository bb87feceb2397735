"""Training, ensemble scoring and evaluation on MLlib.

* M1  split: a deterministic hash threshold per row (scales, no sort), or the
      exact per-class (stratified) split: per class, the order statistic of
      the row hash at the train count, by distributed selection.
* M2  class weights from one aggregate of the label (``weightCol``).
* M3-M6 one ``Pipeline``: assembler -> random forest + two gradient-boosted
      ensembles with distinct output columns; the soft vote is the mean of the
      three positive-class probabilities, a column expression.
* M10-M12 metrics from ONE conditional aggregate over (label, prediction).
* M13 importances from the fitted trees, as a small table.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.functions.fixed import CATEGORICAL_COLUMNS, CLASS_CUT, MODEL_FEATURES
from retentio.operators.clean import _c
from retentio.operators.score import ModelUnavailable

# ---------------------------------------------------------------------------
# M1 / M2
# ---------------------------------------------------------------------------


def hash_split(key: Column, train_pct: int = 80, seed: int = 42) -> Column:
    """M1: 'train' / 'test' by ``pmod(xxhash64(key, seed), 100) < train_pct``."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < train_pct, "train").otherwise("test")


def key_split(key: Column, train_pct: int = 80, seed: int = 42) -> Column:
    """M1 for an integer key: ``lehmer_hash(key) mod 100 < train_pct``.

    Plain integer arithmetic, so any SQL engine reproduces it exactly.
    """
    return F.when(F.pmod(lehmer_hash(key, seed), F.lit(100)) < train_pct, "train").otherwise("test")


def lehmer_hash(key: Column, seed: int = 42) -> Column:
    """A MINSTD step of (key + seed): a bijection on [1, 2^31 - 2], so distinct
    integer keys never tie, and plain integer arithmetic any engine repeats."""
    m = F.lit(2147483647)
    return F.pmod(F.pmod(key.cast("long") + F.lit(seed), m) * F.lit(48271), m)


def stratified_split(df: DataFrame, label: str = "Churn", key: Column | None = None, train_pct: int = 80,
                     seed: int = 42, row_hash: Column | None = None) -> DataFrame:
    """M1, exact per class: in each class the ``n_c - ceil(n_c * test%)`` rows
    with the smallest row hash go to 'train', the rest to 'test'.

    The per-class cut is the exact order statistic of the hash, found by the
    distributed selection of ``stats.select_ranks`` -- no window over a class,
    so a class holding most rows is never gathered into one task. Rows whose
    hash ties the cut all go to 'train' (a 64-bit hash makes ties negligible;
    ``lehmer_hash`` of an integer key has none). NULL labels go to 'test'.
    """
    from retentio.operators.stats import select_ranks
    if row_hash is None:
        k = key if key is not None else F.struct(*[_c(c) for c in df.columns])
        row_hash = F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(2 ** 52))  # exact as a double
    tagged = df.withColumn("__h", row_hash.cast("double"))
    lab = _c(label).cast("string")
    counts = {r["c"]: r["n"] for r in tagged.where(lab.isNotNull()).groupBy(lab.alias("c"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    keys, cut_rank = {}, {}
    for cls, n in counts.items():
        k_train = n - (n * (100 - train_pct) + 99) // 100
        cut_rank[cls] = k_train - 1
        if k_train >= 1:
            keys[(cls, 0)] = {"ranks": (k_train - 1, k_train - 1)}
    if keys:
        select_ranks(tagged.select(lab.alias("column"), F.col("__h").alias("value")), keys)
    cut = {cls: (keys[(cls, 0)]["found"][cut_rank[cls]] if (cls, 0) in keys else -1.0) for cls in counts}
    cut_map = F.create_map(*[x for cls, v in cut.items() for x in (F.lit(cls), F.lit(float(v)))])
    split = F.when(F.col("__h") <= F.element_at(cut_map, lab), "train").otherwise("test")
    return tagged.withColumn("split", split).drop("__h")


def class_weights(df: DataFrame, label: str = "Churn", mode: str = "balanced") -> Column:
    """M2: 'balanced' = n / (2 n_c); 'ratio' = neg/pos on positives, 1 on negatives."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(_c(label) == 1).alias("pos")).collect()[0]  # one row
    n, pos = r["n"], r["pos"]
    neg = n - pos
    if mode == "ratio":
        return F.when(_c(label) == 1, F.lit(neg / pos if pos else 1.0)).otherwise(F.lit(1.0))
    w_pos = n / (2.0 * pos) if pos else 1.0
    w_neg = n / (2.0 * neg) if neg else 1.0
    return F.when(_c(label) == 1, F.lit(w_pos)).otherwise(F.lit(w_neg))


# ---------------------------------------------------------------------------
# M3-M9
# ---------------------------------------------------------------------------
@dataclass
class EnsembleConfig:
    rf_trees: int = 200
    rf_depth: int = 10
    gbt_iter: int = 200
    gbt_depth: int = 5
    gbt_step: float = 0.05
    seed: int = 42
    checkpoint_interval: int = 10


class ModelMismatch(ModelUnavailable):
    """A saved model that was made with other features, categories, cut or statistics."""


def _vocabulary() -> list[str]:
    """The dummy features of the fixed categories."""
    return [f for f in MODEL_FEATURES if any(f.startswith(c + "_") for c in CATEGORICAL_COLUMNS)]


class EnsembleModel:
    """Soft-voting ensemble over a fitted ``PipelineModel`` (M6)."""

    MODELS = ("forest", "boosted_a", "boosted_b")
    PROB_COLS = ("p_rf", "p_gbt_a", "p_gbt_b")

    def __init__(self, pipeline_model, features: list[str]):
        self.pipeline_model = pipeline_model
        self.features = features

    def with_features(self, df: DataFrame) -> DataFrame:
        """``df`` with the model features it lacks."""
        added = []
        for f in self.features:
            if f in df.columns:
                continue
            expr = F.lit(0.0)
            for c in CATEGORICAL_COLUMNS:
                if f.startswith(c + "_"):
                    src = F.coalesce(_c(c), F.lit("Missing")) if c in df.columns else F.lit("Missing")
                    expr = (src == f[len(c) + 1:]).cast("double")
                    break
            added.append(expr.alias(f))
        return df.select("*", *added)

    def score(self, df: DataFrame, prob_col: str = "Churn_Probability") -> DataFrame:
        """Soft-vote probability; model features absent from ``df`` are added
        first (fixed-vocabulary dummies, other absent features 0 -- F9), the
        input columns themselves are left as they are."""
        from pyspark.ml.functions import vector_to_array
        out = self.pipeline_model.transform(self.with_features(df))
        parts = [vector_to_array(F.col(c))[1] for c in self.PROB_COLS]
        p = (parts[0] + parts[1] + parts[2]) / 3.0
        keep = [_c(c) for c in df.columns if c not in (prob_col, "Predicted_Churn_Numeric")]
        return (out.select(*keep, p.alias(prob_col))
                .withColumn("Predicted_Churn_Numeric", (F.col(prob_col) > CLASS_CUT).cast("int")))

    def save(self, path: str, stats_version: str | None = None) -> None:
        """A model package: the pipeline, its trees as a node table, and what it was fitted with.

        The description is written last: a folder without it is no package.
        """
        spark = SparkSession.getActiveSession()
        self.pipeline_model.write().overwrite().save(os.path.join(path, "pipeline"))
        self.node_table(os.path.join(path, "pipeline")).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
        about = {"features": self.features, "vocabulary": _vocabulary(), "class_cut": CLASS_CUT, "models": list(self.MODELS),
                 "stats_version": stats_version}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "package"))

    @staticmethod
    def load(path: str, stats_version: str | None = None) -> "EnsembleModel":
        """The model of a package, checked against this code before anything is planned with it.

        ``stats_version``: the version that the caller cleans with, if the model must have been fitted on the same.
        """
        from pyspark.ml import PipelineModel
        spark = SparkSession.getActiveSession()
        try:
            about = json.loads(spark.read.text(os.path.join(path, "package")).first()[0])
        except AnalysisException as e:
            raise ModelUnavailable(f"{path} holds no model package") from e
        wanted = {"vocabulary": _vocabulary(), "class_cut": CLASS_CUT, "models": list(EnsembleModel.MODELS)}
        if stats_version is not None:
            wanted["stats_version"] = stats_version
        wrong = {k: (about.get(k), v) for k, v in wanted.items() if about.get(k) != v}
        if wrong:
            raise ModelMismatch("the package was made otherwise: " + "; ".join(f"{k}: {a!r}, not {b!r}" for k, (a, b) in wrong.items()))
        pm = PipelineModel.load(os.path.join(path, "pipeline"))
        features = list(pm.stages[0].getInputCols())
        if features != about["features"]:
            raise ModelMismatch(f"the pipeline reads {features}, the package names {about['features']}")
        return EnsembleModel(pm, features)

    def node_table(self, pipeline_dir: str) -> DataFrame:
        """M6: the trees of this model, saved under ``pipeline_dir``, one row per node."""
        from retentio.operators.trees import node_table
        depths = {m: self.pipeline_model.stages[i + 1].getMaxDepth() for i, m in enumerate(self.MODELS)}
        return node_table(SparkSession.getActiveSession(), pipeline_dir, self.MODELS, self.features, depths)

    def importances(self, model: str = "forest") -> list[tuple[str, float]]:
        """M13 input: importances of one of MODELS by feature name (sorted)."""
        fitted = self.pipeline_model.stages[1 + self.MODELS.index(model)]
        imp = fitted.featureImportances.toArray().tolist()
        return sorted(zip(self.features, imp), key=lambda t: -t[1])


#: Rows of a part that is worth a task of its own, and the most rows of a part.
PART_ROWS, PART_MOST = 10_000, 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over all cores, where it has ``PART_ROWS`` rows for each of two parts at least.

    Fits pass over their rows thousands of times and the largest part sets the
    pace of each pass; files follow the sizes of a shuffle, not the cores. More
    parts than cores would cost a forest dearly: each part sends the sums of
    all nodes.
    """
    n = df.count()
    if n < 2 * PART_ROWS:
        return df
    return df.repartition(max(min(df.sparkSession.sparkContext.defaultParallelism, n // PART_ROWS), -(-n // PART_MOST)))


def fit_ensemble(train: DataFrame, label: str = "Churn", features: list[str] = MODEL_FEATURES,
                 cfg: EnsembleConfig | None = None, weight_col: str | None = None,
                 boost_weight_col: str | None = None) -> EnsembleModel:
    """M3-M6: fit RF + two GBTs, a pipeline of all three (training data: aligned features).

    The three know nothing of each other, so they are fitted side by side: a
    boosted round is a chain of short jobs, which alone leave cores idle. Only
    the forest caches the nodes that rows are at (a descent through 200 trees
    a pass costs more); a boosted round has one tree of few levels, where
    keeping a table a level costs more than the descent. The trees are the same either way.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    cfg = cfg or EnsembleConfig()
    asm = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=cfg.rf_trees, maxDepth=cfg.rf_depth,
                                seed=cfg.seed, probabilityCol="p_rf", rawPredictionCol="raw_rf",
                                predictionCol="pred_rf", cacheNodeIds=True,
                                checkpointInterval=cfg.checkpoint_interval)
    gbt_a = GBTClassifier(labelCol=label, featuresCol="features", maxIter=cfg.gbt_iter, maxDepth=cfg.gbt_depth,
                          stepSize=cfg.gbt_step, seed=cfg.seed, predictionCol="pred_gbt_a",
                          checkpointInterval=cfg.checkpoint_interval)
    gbt_a.setProbabilityCol("p_gbt_a").setRawPredictionCol("raw_gbt_a")
    gbt_b = GBTClassifier(labelCol=label, featuresCol="features", maxIter=cfg.gbt_iter, maxDepth=cfg.gbt_depth,
                          stepSize=cfg.gbt_step, seed=cfg.seed + 1, subsamplingRate=0.8,
                          predictionCol="pred_gbt_b", checkpointInterval=cfg.checkpoint_interval)
    gbt_b.setProbabilityCol("p_gbt_b").setRawPredictionCol("raw_gbt_b")
    if weight_col:
        rf.setWeightCol(weight_col)
    if boost_weight_col or weight_col:
        for est in (gbt_a, gbt_b):
            est.setWeightCol(boost_weight_col or weight_col)
    # each on the features alone, not on the predictions of those before; a copy leaves the training summary behind,
    # which holds the session and so cannot travel to tasks once the session has observed metrics
    assembled = asm.transform(spread(train))
    with ThreadPool(3) as pool:
        fitted = pool.map(inheritable_thread_target(train.sparkSession)(lambda est: est.fit(assembled).copy()), (rf, gbt_a, gbt_b))
    return EnsembleModel(PipelineModel([asm, *fitted]), features)


# ---------------------------------------------------------------------------
# M10-M13
# ---------------------------------------------------------------------------
def confusion(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn_Numeric") -> DataFrame:
    """rows = actual class, columns = predicted 0 / 1 (zeros kept)."""
    return (df.groupBy(_c(label).cast("int").alias("actual"))
            .agg(F.count_if(_c(pred) == 0).alias("pred_0"), F.count_if(_c(pred) == 1).alias("pred_1")))


def classification_report(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn_Numeric") -> DataFrame:
    """Accuracy, per-class precision/recall/F1/support, macro and
    weighted averages -- one aggregate, then a few rows of arithmetic.
    A zero denominator gives 0 (as the reference library does)."""
    y, p = _c(label).cast("int"), _c(pred).cast("int")
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))

    def safe(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn, tn = F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")
    n = tp + fp + fn + tn
    prec1, rec1 = safe(tp, tp + fp), safe(tp, tp + fn)
    prec0, rec0 = safe(tn, tn + fn), safe(tn, tn + fp)
    f1 = {1: safe(2 * prec1 * rec1, prec1 + rec1), 0: safe(2 * prec0 * rec0, prec0 + rec0)}
    sup1, sup0 = tp + fn, tn + fp
    rows = [
        ("0", prec0, rec0, f1[0], sup0), ("1", prec1, rec1, f1[1], sup1),
        ("macro avg", (prec0 + prec1) / 2, (rec0 + rec1) / 2, (f1[0] + f1[1]) / 2, n),
        ("weighted avg", safe(prec0 * sup0 + prec1 * sup1, n), safe(rec0 * sup0 + rec1 * sup1, n),
         safe(f1[0] * sup0 + f1[1] * sup1, n), n),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), safe(tp + tn, n), n),
    ]
    structs = [F.struct(F.lit(k).alias("label"), a.alias("precision"), b.alias("recall"), f.alias("f1"),
                        s.cast("long").alias("support")) for k, a, b, f, s in rows]
    return c.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def accuracy(df: DataFrame, label: str = "Churn", pred: str = "Predicted_Churn_Numeric") -> DataFrame:
    """Mean of (prediction == label)."""
    return df.agg(F.avg((_c(label).cast("int") == _c(pred).cast("int")).cast("double")).alias("accuracy"))


def importance_table(model: EnsembleModel, top: int = 15) -> DataFrame:
    """(model, feature, importance, rank), top ``top`` of each model by importance."""
    spark = SparkSession.getActiveSession()
    rows = [(m, f, float(w), i + 1) for m in model.MODELS
            for i, (f, w) in enumerate(model.importances(m)[:top])]  # <= 25 model features each
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int")
