"""The batch analysis chain: customers -> clean -> features -> score -> bands.

Jobs: (1) statistics over the input (a few combinable aggregates plus the
exact-median selection), then (2) one fused narrow projection for cleaning,
features, scoring and banding. Reports read the scored table; callers that
reuse it several times persist or write it once (``materialise``).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.functions.columns import percent_text
from retentio.operators.clean import _c, batch_clean
from retentio.operators.features import business_features
from retentio.operators.risk import band_batch, batch_recommendation
from retentio.operators.score import score_with_model
from retentio.operators.stats import Stats
from retentio.session import ensure_checkpoint_dir

CLIPPED = ("OrderCount", "Tenure", "DaySinceLastOrder")
PREDICTION_COLUMNS = ["Churn_Probability", "Predicted_Churn_Numeric", "Risk_Level", "Retention_Recommendation",
                      "Churn_Probability_Percent", "Predicted_Churn"]


def clean_customers(customers: DataFrame, stats: Stats | None = None, strategy: str = "median"
                    ) -> tuple[DataFrame, Stats]:
    return batch_clean(customers, stats, strategy)


def score_customers(cleaned: DataFrame, stats: Stats, model="scorecard") -> DataFrame:
    """Scored table: the cleaned columns + the prediction columns.

    Features (clipped values, derived columns) feed the model only; the
    scored rows keep the cleaned input values, as the reports show them.
    """
    carried = cleaned.select("*", *[_c(c).alias(f"__in_{c}") for c in CLIPPED if c in cleaned.columns])
    feats = business_features(carried, stats)
    scored = score_with_model(feats, model)
    p = F.col("Churn_Probability")
    keep = [(_c(f"__in_{c}") if c in CLIPPED and f"__in_{c}" in scored.columns else _c(c)).alias(c)
            for c in cleaned.columns]
    risk = band_batch(p)
    return scored.select(
        *keep, p.alias("Churn_Probability"), F.col("Predicted_Churn_Numeric"),
        risk.alias("Risk_Level"), batch_recommendation(risk).alias("Retention_Recommendation"),
        percent_text(p).alias("Churn_Probability_Percent"),
        F.when(F.col("Predicted_Churn_Numeric") == 1, "Yes").otherwise("No").alias("Predicted_Churn"))


def materialise(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """``df`` as a parquet table in the shared folder (``spark.checkpoint.dir``).

    Lineage ends here, a lost executor costs nothing that was written, and
    later reads get column pruning, filter pushdown and, with
    ``partition_by``, pruning by folder.
    """
    path = os.path.join(ensure_checkpoint_dir(df.sparkSession), "tables", uuid.uuid4().hex)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
