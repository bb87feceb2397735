"""Scoring (M7-M9, M14, M15): the probability column and the predicted class.

``scorecard`` (M14) is a fixed logistic scorecard written as one column
expression, so scoring stays inside whole-stage codegen and every result
downstream can be checked in SQL. A fitted MLlib ensemble (``ml.py``) takes
the same place through ``score_with_model``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.functions.fixed import CLASS_CUT, SCORECARD_INTERCEPT, SCORECARD_WEIGHTS
from retentio.operators.clean import _c


class ModelUnavailable(RuntimeError):
    """Scoring without a model fails before any plan is built."""


def scorecard_logit(weights=SCORECARD_WEIGHTS, intercept: float = SCORECARD_INTERCEPT) -> Column:
    z = F.lit(float(intercept))
    for col, w in weights:
        z = z + F.lit(float(w)) * _c(col).cast("double")
    return z


def scorecard(df: DataFrame, weights=SCORECARD_WEIGHTS, intercept: float = SCORECARD_INTERCEPT,
              prob_col: str = "Churn_Probability") -> DataFrame:
    """p = 1 / (1 + exp(-(b + sum w_i x_i))) and the class p > 0.5."""
    z = scorecard_logit(weights, intercept)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return (df.withColumn(prob_col, p)
            .withColumn("Predicted_Churn_Numeric", (F.col(prob_col) > CLASS_CUT).cast("int")))


def fallback_probability(pred: Column) -> Column:
    """M8: a model with classes only -> .9 for class 1, else .1."""
    return F.when(pred == 1, F.lit(0.9)).otherwise(F.lit(0.1))


def score_with_model(df: DataFrame, model, prob_col: str = "Churn_Probability") -> DataFrame:
    """M7/M9: score through a fitted model (``PipelineModel`` or the scorecard).

    ``model`` may be ``"scorecard"``, an ``EnsembleModel`` (ml.py) or a
    ``PipelineModel`` producing ``probability``/``prediction`` columns.
    """
    if model is None:
        raise ModelUnavailable("model artifact is unavailable")
    if model == "scorecard":
        return scorecard(df, prob_col=prob_col)
    if hasattr(model, "score"):
        return model.score(df, prob_col=prob_col)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn(prob_col, vector_to_array("probability")[1])
    else:
        out = out.withColumn(prob_col, fallback_probability(F.col("prediction")))
    return out.withColumn("Predicted_Churn_Numeric", (F.col(prob_col) > CLASS_CUT).cast("int"))
