"""Plan properties that matter at scale, checked on the physical plans."""

import re

import pytest

import __spark_entry__ as entry
from paths import SF_SMALL
from retentio.operators import analyze as A
from retentio.operators import rows as W
from retentio.plans import catalog
from retentio.plans.mart import customer_mart

# queries that write files or fit models while being built
SIDE_EFFECTS = {"s1_csv_scan", "s2_json_records", "s2_quarantine", "s6_full_report", "s7_risk_export_high", "s8_records_json",
                "s10_stream_score", "s10_versioned_stats", "m6_ensemble", "m6_tree_votes", "m13_importance", "m13_tree_importance",
                "s11_model_package"}


def _plan(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SIDE_EFFECTS))
def test_no_python_in_plans(spark, name):
    txt = _plan(entry.queries()[name](spark, SF_SMALL))
    assert not re.search(r"(BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonUDF)", txt)


def test_mart_shape(spark):
    spark.catalog.clearCache()  # an identical cached plan would be substituted for the mart
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        txt = _plan(customer_mart(spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    tree = txt.split("\n\n\n")[0]
    assert len(re.findall(r"(?<!Broadcast)Exchange \(\d+\)", tree)) <= 3   # one aggregate, one join
    assert "SortAggregate" not in tree and "Window" not in tree
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", txt)  # date filter in the scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint,l_extendedprice:double,l_discount:double," \
           "l_returnflag:string>" in txt                                      # only five line-item columns


@pytest.mark.parametrize("name", ["s_scored_table", "r10_contribution", "r12_r14_top_driver", "f7_filter_high",
                                  "e1_e8_features", "f9_align", "m14_scorecard"])
def test_row_level_queries_do_not_shuffle(spark, name):
    tree = _plan(entry.queries()[name](spark, SF_SMALL)).split("\n\n\n")[0]
    assert "Exchange" not in tree


def test_a_page_is_a_range_of_the_scan(spark):
    """Both fences reach the parquet filter; the rows before the page are not read to find it."""
    s = catalog.scored(spark, SF_SMALL)
    index = W.page_index(s, 20)
    txt = _plan(W.page_at(s, index, 4))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(CustomerID", txt)
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(CustomerID", txt)
    every = [r[0] for r in s.select("CustomerID").orderBy("CustomerID").collect()]
    pages = [[r["CustomerID"] for r in W.page_at(s, index, k).collect()] for k in (1, 4, index.count())]
    assert pages[0] == every[:20] and pages[1] == every[60:80] and pages[2] == every[(index.count() - 1) * 20:]
    assert W.page_at(s, index, index.count() + 1).count() == 0


def test_churn_rates_of_all_keys_are_one_expand(spark):
    keys = ["Complain", "SatisfactionScore", "MaritalStatus"]
    s = catalog.scored(spark, SF_SMALL)
    out = A.churn_rate_sets(s, keys)
    tree = _plan(out).split("\n\n\n")[0]
    assert len(re.findall(r"Expand \(\d+\)", tree)) == 1 and len(re.findall(r"Scan parquet", tree)) == 1
    for k in keys:
        want = {str(r[k]): r["churn_rate"] for r in A.churn_rate_by(s, k).collect()}
        assert {r["value"]: r["churn_rate"] for r in out.where(f"dimension = '{k}'").collect()} == want
