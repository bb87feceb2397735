"""Registered queries: training/evaluation (M-series), sinks (S-series), stream."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from retentio.functions import fixed as FX
from retentio.operators import ml as M
from retentio.operators import risk as R
from retentio.plans import oracle_sql as O
from retentio.plans.catalog import features, mart, register, scored, stable
from retentio.plans.queries_analysis import IMPORTANCES, _r12_sql, _r13_sql, js_number_sql
from retentio.plans.queries_core import _errors_sql, _n13_body, _rc_chain

P = "Churn_Probability"


# ---------------------------------------------------------------------------
# M1, M10-M12 (oracle); M6, M13 (rows only: fitted models)
# ---------------------------------------------------------------------------
def _split_sql():
    h = "(((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647"
    return O.chain("mart", f"SELECT CustomerID, Churn, CASE WHEN ({h}) % 100 < 80 THEN 'train' ELSE 'test' END "
                           f"AS split FROM mart")


@register("m1_split", _split_sql())
def q_m1(spark, sf):
    m = mart(spark, sf)
    return m.select("CustomerID", "Churn", M.key_split(F.col("CustomerID").cast("long")).alias("split"))


@register("m1_split_shares", O.chain("mart", f"""SELECT Churn, count(*) AS n,
  count(*) FILTER (WHERE split = 'train') AS n_train,
  {O.rnd("count(*) FILTER (WHERE split = 'train') * 1.0 / count(*)")} AS train_share
FROM (SELECT Churn, CASE WHEN ((((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647) % 100 < 80
      THEN 'train' ELSE 'test' END AS split FROM mart) GROUP BY Churn"""))
def q_m1s(spark, sf):
    m = mart(spark, sf).select("Churn", M.key_split(F.col("CustomerID").cast("long")).alias("split"))
    return stable(m.groupBy("Churn").agg(F.count(F.lit(1)).alias("n"),
                                         F.count_if(F.col("split") == "train").alias("n_train"),
                                         (F.count_if(F.col("split") == "train") / F.count(F.lit(1)))
                                         .alias("train_share")))


def _strat_sql():
    h = "(((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647"
    return O.chain("mart", f"""SELECT CustomerID, Churn,
  CASE WHEN rk <= n - (n * 20 + 99) // 100 THEN 'train' ELSE 'test' END AS split
FROM (SELECT CustomerID, Churn, row_number() OVER (PARTITION BY Churn ORDER BY {h}) AS rk,
             count(*) OVER (PARTITION BY Churn) AS n FROM mart)""")


@register("m1_stratified_split", _strat_sql())
def q_m1x(spark, sf):
    m = mart(spark, sf).select("CustomerID", "Churn")
    return M.stratified_split(m, "Churn", train_pct=80, row_hash=M.lehmer_hash(F.col("CustomerID").cast("long")))


@register("m11_confusion", O.chain("scored", "SELECT CAST(Churn AS INTEGER) AS actual, "
                                            "count(*) FILTER (WHERE Predicted_Churn_Numeric = 0) AS pred_0, "
                                            "count(*) FILTER (WHERE Predicted_Churn_Numeric = 1) AS pred_1 "
                                            "FROM scored GROUP BY 1"))
def q_m11(spark, sf):
    return M.confusion(scored(spark, sf))


def _report_sql():
    safe = "coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"

    def s(a, b):
        return safe.format(a=a, b=b)
    p1, r1 = s("tp", "tp + fp"), s("tp", "tp + fn")
    p0, r0 = s("tn", "tn + fn"), s("tn", "tn + fp")
    f1, f0 = s(f"2 * {p1} * {r1}", f"{p1} + {r1}"), s(f"2 * {p0} * {r0}", f"{p0} + {r0}")
    n = "(tp + fp + fn + tn)"
    rows = [("0", p0, r0, f0, "(tn + fp)"), ("1", p1, r1, f1, "(tp + fn)"),
            ("macro avg", f"({p0} + {p1}) / 2", f"({r0} + {r1}) / 2", f"({f0} + {f1}) / 2", n),
            ("weighted avg", s(f"{p0} * (tn + fp) + {p1} * (tp + fn)", n), s(f"{r0} * (tn + fp) + {r1} * (tp + fn)", n),
             s(f"{f0} * (tn + fp) + {f1} * (tp + fn)", n), n),
            ("accuracy", "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", s("tp + tn", n), n)]
    base = ("(SELECT count(*) FILTER (WHERE Churn = 1 AND Predicted_Churn_Numeric = 1) AS tp, "
            "count(*) FILTER (WHERE Churn = 0 AND Predicted_Churn_Numeric = 1) AS fp, "
            "count(*) FILTER (WHERE Churn = 1 AND Predicted_Churn_Numeric = 0) AS fn, "
            "count(*) FILTER (WHERE Churn = 0 AND Predicted_Churn_Numeric = 0) AS tn FROM scored)")
    parts = [f"SELECT '{k}' AS label, {a} AS precision, {b} AS recall, {f} AS f1, CAST({sp} AS BIGINT) AS support "
             f"FROM {base}" for k, a, b, f, sp in rows]
    return O.round_all(O.chain("scored", " UNION ALL ".join(parts)), ["precision", "recall", "f1"])


@register("m10_m12_metrics", _report_sql())
def q_m10(spark, sf):
    return stable(M.classification_report(scored(spark, sf)))


def _ensemble(spark, sf):
    """The whole ensemble (EnsembleConfig's own sizes, weights per model as in
    lifecycle.train) fitted once per session and data folder on the written
    training split; shared by m6 and m13."""
    from retentio.operators.features import align_features
    from retentio.plans.batch import materialise
    from retentio.plans.catalog import _shared

    def build():
        # dealt evenly, so that fits and votes have as many parts as cores
        feats = materialise(M.spread(align_features(features(spark, sf), keep=("CustomerID", "Churn"))))
        train = feats.where(M.key_split(F.col("CustomerID").cast("long")) == "train")
        train = materialise(train.withColumns({"__w": M.class_weights(train),
                                               "__ratio": M.class_weights(train, mode="ratio")}))
        return M.fit_ensemble(train, weight_col="__w", boost_weight_col="__ratio"), feats
    return _shared("ensemble", spark, sf, build)


@register("m6_ensemble")
def q_m6(spark, sf):
    model, feats = _ensemble(spark, sf)
    test = feats.where(M.key_split(F.col("CustomerID").cast("long")) == "test")
    return model.score(test).select("CustomerID", "Churn", P, "Predicted_Churn_Numeric")


@register("m6_tree_votes", O.chain("mart", """SELECT CustomerID, true AS same_probability, true AS same_class FROM mart
WHERE ((((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647) % 100 >= 80"""))
def q_m6t(spark, sf):
    """Every test row's vote by the saved package, counted from its node table, against the fitted model's own."""
    from retentio.operators.trees import vote
    model, feats = _ensemble(spark, sf)
    test = feats.where(M.key_split(F.col("CustomerID").cast("long")) == "test")
    nodes = spark.read.parquet(os.path.join(_package(spark, sf), "nodes"))
    own = model.score(test).select("CustomerID", F.col(P).alias("p"), F.col("Predicted_Churn_Numeric").alias("c"))
    table = vote(model.with_features(test), nodes, model.features).select("CustomerID", P, "Predicted_Churn_Numeric")
    return own.join(table, "CustomerID").select("CustomerID", (F.abs(F.col("p") - F.col(P)) < 1e-9).alias("same_probability"),
                                                (F.col("c") == F.col("Predicted_Churn_Numeric")).alias("same_class"))


@register("m13_tree_importance", "SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', '{f}', true)" for m in M.EnsembleModel.MODELS for f in FX.MODEL_FEATURES) + ") t(model, feature, same)")
def q_m13t(spark, sf):
    """Every feature's importance in every model, summed up from the node table, against the model's own."""
    from retentio.operators.trees import importances
    model, _ = _ensemble(spark, sf)
    own = spark.createDataFrame([(m, f, float(w)) for m in model.MODELS for f, w in model.importances(m)],
                                "model string, feature string, w double")
    table = importances(spark.read.parquet(os.path.join(_package(spark, sf), "nodes")))
    return own.join(table, ["model", "feature"], "left").select(
        "model", "feature", (F.abs(F.col("w") - F.coalesce("importance", F.lit(0.0))) < 1e-9).alias("same"))


def _package(spark, sf):
    """The ensemble saved with the version of the statistics it was cleaned with."""
    from retentio.plans.catalog import _shared
    from retentio.streaming.scoring import scratch_dir

    def build():
        path = scratch_dir(spark, "package")
        _ensemble(spark, sf)[0].save(path, stats_version=_stats_version(spark, sf))
        return path
    return _shared("package", spark, sf, build)


def _stats_version(spark, sf) -> str:
    from retentio.plans.catalog import stats
    return stats(spark, sf).fingerprint()


@register("s11_model_package", O.chain("mart", """SELECT CustomerID, true AS same FROM mart
WHERE ((((CAST(CustomerID AS BIGINT) + 42) % 2147483647) * 48271) % 2147483647) % 100 >= 80"""))
def q_s11(spark, sf):
    """The package loaded again, checked, and scored with: the same probabilities as before it was saved."""
    model, feats = _ensemble(spark, sf)
    test = feats.where(M.key_split(F.col("CustomerID").cast("long")) == "test")
    again = M.EnsembleModel.load(_package(spark, sf), stats_version=_stats_version(spark, sf))
    a = model.score(test).select("CustomerID", F.col(P).alias("p"))
    return a.join(again.score(test).select("CustomerID", P), "CustomerID").select("CustomerID", (F.col("p") == F.col(P)).alias("same"))


@register("m13_importance")
def q_m13(spark, sf):
    model, _ = _ensemble(spark, sf)
    return M.importance_table(model, 15)


# ---------------------------------------------------------------------------
# sinks and stream (S7, S9, S10), analysis bundle
# ---------------------------------------------------------------------------
def _impact_sql() -> dict[str, str]:
    """Display texts of R18 over a row of ``scored``, by name."""
    band = O.band_record_sql(P)
    share = (f"CASE WHEN {band} = 'low' THEN {O.dbl(0.05)} WHEN {band} = 'medium' THEN {O.dbl(0.15)} "
             f"ELSE {O.dbl(0.25)} END")
    clv = f"(OrderCount * {O.dbl(850.0)} + CashbackAmount)"
    budget, loss = f"({clv} * {share})", f"({clv} * {P})"
    roi = f"(CASE WHEN {budget} > 0 THEN ({loss} - {budget}) / {budget} ELSE {O.dbl(0.0)} END)"

    def shown(v, example):
        return f"(CASE WHEN coalesce({v}, 0) = 0 THEN {O.dbl(example)} ELSE {v} END)"

    def rupees(v, example):
        return f"'₹' || format('{{:,.0f}}', floor({shown(v, example)} + 0.5))"
    tenths = f"(floor({shown(roi, 3.4)} * 10 + 0.5) / 10)"
    return {"estimatedCV": rupees(clv, 18750.0), "retentionBudget": rupees(budget, 1250.0),
            "potentialLoss": rupees(loss, 4250.0), "roiPotential": f"{js_number_sql(tenths)} || 'x'"}


GENERATED = "1/1/2026, 12:00:00 AM"  # the run's time, an argument of the report


def _s9_sql():
    band = O.band_record_sql(P)
    arr = {k: [O.q(t) for t in v] for k, v in FX.RECORD_RECOMMENDATIONS.items()}
    shown = _impact_sql()

    def reco(i):
        return f"CASE WHEN {band} = 'low' THEN {arr['low'][i]} WHEN {band} = 'medium' THEN {arr['medium'][i]} " \
               f"ELSE {arr['high'][i]} END"
    percent = js_number_sql(f"(floor({P} * 1000 + 0.5) / 10)")
    lines = [
        "'CUSTOMER CHURN RISK ANALYSIS REPORT'", "'==================================='", f"'Generated: {GENERATED}'", "''",
        "'EXECUTIVE SUMMARY'", "'-----------------'",
        f"'• Churn Probability: ' || {percent} || '%'",
        f"'• Risk Level: ' || upper({band})",
        f"'• Potential Revenue Loss (Estimated): ' || {shown['potentialLoss']}",
        "'• Primary Risk Factor: ' || with_driver",
        "''", "'RETENTION RECOMMENDATIONS'", "'-------------------------'",
        f"'PRIORITY: ' || upper({band})",
        f"'1. ' || {reco(0)}", f"'2. ' || {reco(1)}", f"'3. ' || {reco(2)}",
        "''", "'BUSINESS IMPACT ANALYSIS'", "'------------------------'",
        f"'• Estimated Customer Value: ' || {shown['estimatedCV']}",
        f"'• Recommended Retention Budget: ' || {shown['retentionBudget']}",
        f"'• ROI Potential: ' || {shown['roiPotential']}",
        "''", "'--- END OF REPORT'",
    ]
    factors = _r13_sql()
    head, rest = factors[:factors.index("SELECT s.CustomerID")], factors[factors.index("SELECT s.CustomerID"):]
    return (f"{head}SELECT c.CustomerID, concat_ws(chr(10), " + ", ".join(lines)
            + f") AS report FROM scored c JOIN ({rest}) f ON f.CustomerID = c.CustomerID")


@register("s9_text_report", _s9_sql())
def q_s9(spark, sf):
    from retentio.sources.sinks import record_text_report
    return record_text_report(scored(spark, sf), GENERATED, IMPORTANCES)


def _accepted_chain(body: str) -> str:
    """Record-cleaned rows that break no rule, through features and score (CTE ``scored``)."""
    types = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in O.NUM_COLS)
    cleaned = f"cleaned AS (SELECT * REPLACE ({types}) FROM rc WHERE len({_errors_sql()}) = 0)"
    return O.with_ctes(O.MART, O.stats_cte(), f"rc AS ({_n13_body()})", cleaned, O.FEAT, O.SCORED, body=body)


RUN_TIME = "2026-01-01T00:00:00+00:00"  # an argument of the run
_S10_COLUMNS = ["CustomerID", P, "Predicted_Churn", "risk_level_record", "estimated_clv", "retention_budget",
                "potential_revenue_loss", "roi_retention", "recommendations", "primary_risk_factor", "top_driver", "timestamp"]


def _s10_sql() -> str:
    band = O.band_record_sql(P)
    share = (f"CASE WHEN {band} = 'low' THEN {O.dbl(0.05)} WHEN {band} = 'medium' THEN {O.dbl(0.15)} "
             f"ELSE {O.dbl(0.25)} END")
    texts = {k: O.q(chr(10).join(v)) for k, v in FX.RECORD_RECOMMENDATIONS.items()}
    ranked = _r13_sql()
    factors = ranked[ranked.index("SELECT s.CustomerID"):]
    drivers = _r12_sql()
    drivers = drivers[drivers.index("SELECT CustomerID, Feature AS top_driver"):]
    body = f"""SELECT s.CustomerID, {P}, Predicted_Churn, {band} AS risk_level_record, clv AS estimated_clv,
  clv * share AS retention_budget, clv * {P} AS potential_revenue_loss,
  CASE WHEN clv * share > 0 THEN (clv * {P} - clv * share) / (clv * share) ELSE {O.dbl(0.0)} END AS roi_retention,
  CASE {band} WHEN 'low' THEN {texts['low']} WHEN 'medium' THEN {texts['medium']} ELSE {texts['high']} END AS recommendations,
  f.with_driver AS primary_risk_factor, d.top_driver, '{RUN_TIME}' AS timestamp
FROM (SELECT *, OrderCount * {O.dbl(850.0)} + CashbackAmount AS clv, {share} AS share FROM scored) s
JOIN ({factors}) f ON f.CustomerID = s.CustomerID JOIN ({drivers}) d ON d.CustomerID = s.CustomerID"""
    return O.round_all(_accepted_chain(body), [P, "estimated_clv", "retention_budget", "potential_revenue_loss",
                                               "roi_retention"])


def _stream(spark, sf):
    from retentio.plans.catalog import _shared
    from retentio.plans.catalog import stats as shared_stats
    from retentio.streaming.scoring import run_stream_scoring, scratch_dir

    def build():
        m = mart(spark, sf)
        base = scratch_dir(spark, "s10")
        src, bad = os.path.join(base, "in"), os.path.join(base, "rejected")
        m.write.mode("overwrite").json(src)
        out = run_stream_scoring(spark, src, m.schema, shared_stats(spark, sf), os.path.join(base, "out"),
                                 os.path.join(base, "ckpt"), bad, IMPORTANCES, scored_at=RUN_TIME)
        return out, spark.read.schema("CustomerID string, errors array<string>").json(bad)
    return _shared("stream", spark, sf, build)


@register("s10_stream_score", _s10_sql())
def q_s10(spark, sf):
    return stable(_stream(spark, sf)[0].select(*_S10_COLUMNS))


@register("s10_stream_rejected", _rc_chain(f"SELECT CustomerID, {_errors_sql()} AS errors FROM rc WHERE len({_errors_sql()}) > 0"))
def q_s10r(spark, sf):
    return _stream(spark, sf)[1]


@register("s7_risk_exports", O.round_all(O.chain("scored", "SELECT * FROM scored"), O.SCORED_DOUBLES))
def q_s7(spark, sf):
    """All three bands, written in one job and read back."""
    from retentio.sources.sinks import write_risk_exports
    from retentio.streaming.scoring import scratch_dir
    s = scored(spark, sf)
    path = write_risk_exports(s, scratch_dir(spark, "s7"), stamp="run")
    return stable(spark.read.schema(s.schema).option("header", True).csv(path))  # Risk_Level from the folder names


_A24 = [("risk_analysis", k) for k in ("total_customers", "high_risk", "moderate_risk", "low_risk", "average_probability",
                                       "churn_rate", "total_predicted_churn")] + [
    ("customer_segmentation", k) for k in ("high_risk_count", "high_risk_avg_probability", "high_risk_loss")] + [
    ("dataset_info", k) for k in ("total_customers", "total_features")]


def _a24_sql():
    high = "FILTER (WHERE Churn_Probability > 0.7)"
    of = {"total_customers": "count(*)", "high_risk": f"count(*) {high}",
          "moderate_risk": "count(*) FILTER (WHERE Churn_Probability > 0.3 AND Churn_Probability <= 0.7)",
          "low_risk": "count(*) FILTER (WHERE Churn_Probability <= 0.3)", "average_probability": "avg(Churn_Probability)",
          "churn_rate": "sum(Predicted_Churn_Numeric) / count(*)", "total_predicted_churn": "sum(Predicted_Churn_Numeric)",
          "high_risk_count": f"count(*) {high}", "high_risk_avg_probability": f"coalesce(avg(Churn_Probability) {high}, 0.0)",
          "high_risk_loss": f"coalesce(sum(Churn_Probability) {high} * 850.0, 0.0)",
          "total_features": f"max({len(O.MART_COLS) + 6})"}
    parts = [f"SELECT '{s}' AS section, '{k}' AS item, CAST({of[k]} AS DOUBLE) AS value FROM scored" for s, k in _A24]
    from retentio.operators.analyze import PROFILE_FEATURES
    for f in PROFILE_FEATURES:
        x = f"CAST({f} AS DOUBLE)"
        parts += [f"SELECT 'feature_analysis', '{f}.{k}', {e} FROM scored WHERE Churn_Probability > 0.7 HAVING count(*) > 0"
                  for k, e in (("mean", f"avg({x})"), ("median", f"median({x})"), ("std", f"stddev_samp({x})"))]
    return O.round_all(O.chain("scored", " UNION ALL ".join(parts)), ["value"])


@register("a24_analysis_result", _a24_sql())
def q_a24(spark, sf):
    """The nested result's numbers, one a row (its CSV size is compared in p10_dataset_info)."""
    from retentio.operators.analyze import analysis_result
    result = analysis_result(scored(spark, sf))
    flat = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("item"), F.col(f"{s}.{k}").cast("double").alias("value"))
            for s, k in _A24]
    profile = F.flatten(F.transform(F.map_entries("feature_analysis"), lambda e: F.array(*[
        F.struct(F.lit("feature_analysis").alias("section"), F.concat(e["key"], F.lit(f".{k}")).alias("item"),
                 e["value"][k].alias("value")) for k in ("mean", "median", "std")])))
    return stable(result.select(F.explode(F.concat(F.array(*flat), profile)).alias("r")).select("r.*"))


@register("r18_impact_strings", O.chain("scored", "SELECT CustomerID, " + ", ".join(
    f"{v} AS {k}" for k, v in _impact_sql().items()) + " FROM scored"))
def q_r18(spark, sf):
    imp = R.business_impact(scored(spark, sf))
    return imp.select("CustomerID", *R.impact_strings(imp))
