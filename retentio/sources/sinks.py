"""Sinks (S6-S9, S11): reports are written by Spark, never built in memory.

A distributed file cannot carry appended sections, so the full report is
three outputs (customers, summary, metadata) that one manifest commits. The
risk exports are ONE job with ``partitionBy("Risk_Level")`` -- the three
files partition the scored table and later reads prune by directory.
"""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retentio.functions import fixed as FX
from retentio.functions.columns import js_number
from retentio.operators import analyze as A
from retentio.operators import clean as N
from retentio.operators import rows as W
from retentio.operators.profile import with_row_count
from retentio.sources.customers import run_stamp


REPORT_PARTS = ("customers", "summary", "metadata")


class IncompleteReport(RuntimeError):
    """A report folder without a manifest, or with other rows than its manifest names."""


def write_full_report(scored: DataFrame, out_dir: str, data_source: str = "Uploaded CSV", stamp: str | None = None,
                      run_time: str | None = None, run_date: str | None = None, order_by=None) -> str:
    """``customers`` (all rows, id first, predictions last), ``summary`` and ``metadata`` as header CSV
    under ``churn_analysis_complete_report_<stamp>``, committed together.

    A run writes all three into a folder of its own; its writing jobs count
    their rows. The manifest, which names the run and the counts, is written
    last: until then readers see the report before, or none. ``run_time`` and
    ``run_date`` are shown (now, if not given); ids that are missing are made
    in the order of ``order_by``.
    """
    base = os.path.join(out_dir, f"churn_analysis_complete_report_{stamp or run_stamp()}")
    run = f"run-{uuid.uuid4().hex}"
    with_id, id_col = W.ensure_id(scored, order_by)
    parts = {"customers": W.reorder_for_report(with_id, id_col),
             "summary": A.summary_report(scored, run_date=run_date).orderBy("position").drop("position").coalesce(1),
             "metadata": A.report_metadata(scored, data_source, run_time).orderBy("position").drop("position").coalesce(1)}
    manifest = []
    for name in REPORT_PARTS:
        counted, seen = with_row_count(parts[name], name)
        counted.write.option("header", True).csv(os.path.join(base, run, name))
        manifest.append((run, name, seen.get["rows"], parts[name].columns))
    scored.sparkSession.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").json(os.path.join(base, "manifest"))
    return base


MANIFEST = "run string, part string, rows long, columns array<string>"


def read_full_report(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The committed parts of a report by name, all columns as text; refused unless they are whole."""
    try:
        manifest = spark.read.schema(MANIFEST).json(os.path.join(base, "manifest")).collect()  # one row per part
    except AnalysisException as e:
        raise IncompleteReport(f"{base} has no manifest") from e
    if sorted(r["part"] for r in manifest) != sorted(REPORT_PARTS):
        raise IncompleteReport(f"the manifest of {base} names {sorted(r['part'] for r in manifest)}")
    out = {}
    for r in manifest:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in r["columns"]])
        out[r["part"]] = spark.read.schema(schema).option("header", True).csv(os.path.join(base, r["run"], r["part"]))
        if out[r["part"]].count() != r["rows"]:
            raise IncompleteReport(f"{r['part']} of {base} has other than its {r['rows']} rows")
    return out


def write_risk_exports(scored: DataFrame, out_dir: str, stamp: str | None = None) -> str:
    """All three risk-filtered exports in one job, partitioned by band."""
    base = os.path.join(out_dir, f"churn_analysis_risk_customers_{stamp or run_stamp()}")
    scored.write.mode("overwrite").partitionBy("Risk_Level").option("header", True).csv(base)
    return base


def write_records_json(scored: DataFrame, path: str) -> None:
    """Every prediction as one JSON object per line, no NULL fields (N12 first)."""
    N.null_defaults_by_name(scored).write.mode("overwrite").json(path)


def record_text_report(df: DataFrame, generated: str, importances: list[tuple[str, float]] | None = None,
                       id_col: str = "CustomerID", prob_col: str = "Churn_Probability") -> DataFrame:
    """The per-customer text report as one string column.

    ``generated`` is the run's time as shown; with ``importances`` the primary
    risk factor is the customer's top driver (R12, R13).
    """
    from retentio.operators import risk as R
    p = F.col(prob_col)
    recos = R.record_recommendations(p)
    driver = R.top_driver(df, importances)
    impact = R.business_impact(df, prob_col)
    slots = dict(zip(("clv", "budget", "loss", "roi"), R.impact_strings(impact))) | {
        "generated": F.lit(generated), "percent": js_number(R.percent_one_decimal(p)), "band": F.upper(R.band_record(p)),
        "factor": R.primary_risk_factor(prob_col, driver)} | {f"reco{i + 1}": F.get(recos, i) for i in range(3)}
    lines = []
    for line in FX.TEXT_REPORT:
        parts = [slots[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", line) if x]
        lines.append(F.concat(*parts) if parts else F.lit(""))
    return impact.select(F.col(id_col), F.concat_ws("\n", *lines).alias("report"))


def write_text_reports(df: DataFrame, path: str, generated: str) -> None:
    """S9 sink: one text line block per customer."""
    record_text_report(df, generated).select("report").write.mode("overwrite").text(path)
