from pyspark.sql import functions as F

from paths import SF_SMALL
from retentio.operators import ml as M
from retentio.plans import catalog, queries_io


def test_registered_fit_is_the_whole_ensemble(spark, monkeypatch):
    """m6 and m13 fit EnsembleConfig's own sizes, balanced weights for the forest, neg/pos for the boosted trees."""
    seen = {}

    class Fitted:
        MODELS = ()

        def score(self, df):
            return df.withColumns({queries_io.P: F.lit(0.5), "Predicted_Churn_Numeric": F.lit(0)})

    def fit(train, label="Churn", cfg=None, weight_col=None, boost_weight_col=None, **_):
        seen.update(train=train, cfg=cfg or M.EnsembleConfig(), forest=weight_col, boosted=boost_weight_col)
        return Fitted()

    monkeypatch.setattr(M, "fit_ensemble", fit)
    monkeypatch.setattr(catalog, "_SHARED", {})
    assert catalog.QUERIES["m6_ensemble"](spark, SF_SMALL).count() > 0
    cfg = seen["cfg"]
    assert (cfg.rf_trees, cfg.rf_depth, cfg.gbt_iter, cfg.gbt_depth) == (200, 10, 200, 5)
    train = seen["train"]
    n = {r["Churn"]: r["count"] for r in train.groupBy("Churn").count().collect()}
    for r in train.select("Churn", seen["forest"], seen["boosted"]).distinct().collect():
        assert abs(r[1] - sum(n.values()) / (2 * n[r["Churn"]])) < 1e-12
        assert abs(r[2] - (n[0] / n[1] if r["Churn"] == 1 else 1.0)) < 1e-12
    assert train.inputFiles()   # read from written files
