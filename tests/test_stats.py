import math
import random

import numpy as np
from pyspark.sql import functions as F

from retentio.operators.stats import Stats, column_stats, exact_quantiles


def _np_quantile(vals, q):
    return float(np.quantile(np.array(vals, dtype=float), q, method="linear"))


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        hot = 5.0 if i % 3 == 0 else None          # a hot value: a third of all rows
        rows.append((rnd.random() * 1000, hot if hot is not None else rnd.randint(0, 40) * 1.0,
                     None if i % 7 == 0 else rnd.gauss(0, 1)))
    df = spark.createDataFrame(rows, "a double, b double, c double")
    cols = ["a", "b", "c"]
    counts = {c: sum(1 for r in rows if r[i] is not None) for i, c in enumerate(cols)}
    qs = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, cols, counts, qs)
    for i, c in enumerate(cols):
        vals = [r[i] for r in rows if r[i] is not None]
        for q in qs:
            assert math.isclose(got[c][q], _np_quantile(vals, q), rel_tol=1e-12, abs_tol=1e-12), (c, q)


def test_even_and_odd_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert exact_quantiles(df, ["x"], {"x": 4}, [0.5])["x"][0.5] == 2.5
    df = spark.createDataFrame([(1.0,), (2.0,), (30.0,)], "x double")
    assert exact_quantiles(df, ["x"], {"x": 3}, [0.5])["x"][0.5] == 2.0


def test_stats_table_defaults_mode_ties_and_nan(spark):
    rows = [(None, "b", float("nan"), None), (None, "a", 1.0, None), (None, "b", float("inf"), None),
            (None, "a", 3.0, None)]
    df = spark.createDataFrame(rows, "Tenure double, Gender string, CouponUsed double, MaritalStatus string")
    st = Stats.from_table(column_stats(df))
    assert st.median["Tenure"] == 12.0          # all NULL -> default by name
    assert st.mode["Gender"] == "a"             # tie -> lowest value
    assert st.median["CouponUsed"] == 2.0       # NaN / inf are missing, not values
    assert st.mode["MaritalStatus"] == "Single"  # all NULL -> categorical default


def test_ranks_between_hot_values(spark):
    """The rank at the edge of two hot values, on a flag, a four-level column and with a rare value between."""
    n = 20_000
    rows = [(float(i % 2), float(i % 4), 1.0 if i < n // 2 - 1 else 3.0 if i > n // 2 else 2.0) for i in range(n)]
    df = spark.createDataFrame(rows, "flag double, level double, edge double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, ["flag", "level", "edge"], dict.fromkeys(["flag", "level", "edge"], n), qs)
    for i, c in enumerate(["flag", "level", "edge"]):
        for q in qs:
            assert got[c][q] == _np_quantile([r[i] for r in rows], q), (c, q)


def test_no_row_is_ranked(spark, monkeypatch):
    """The selection uses aggregates alone: no window, no sort of a column."""
    from retentio.operators import stats as S
    plans = []
    df = spark.range(1000).selectExpr("cast(id as double) as x")
    long = S._long_numeric(df, ["x"])
    monkeypatch.setattr(type(long), "collect", lambda self, orig=type(long).collect: (
        plans.append(self._jdf.queryExecution().executedPlan().toString()), orig(self))[1])
    S.select_ranks(long, {("x", 0): {"ranks": (499, 500)}})
    assert len(plans) == 4 and not any("Window" in p for p in plans)


def test_keys_order_as_doubles_do(spark):
    """Powers of two and their neighbours, subnormals, extremes, both signs: the key is the double's own bits."""
    from retentio.operators.stats import key_value, order_key
    near = [x for e in (-1074, -1060, -1023, -1022, -1021, -53, -1, 0, 1, 10, 52, 53, 300, 1023)
            for x in (2.0 ** e, math.nextafter(2.0 ** e, 0), math.nextafter(2.0 ** e, math.inf))]
    rnd = random.Random(3)
    values = [0.0, -0.0, 1.7976931348623157e308, *near, *(rnd.uniform(0, 1) * 10.0 ** rnd.randint(-300, 300) for _ in range(3000))]
    values += [-v for v in values]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", order_key(F.col("v")).alias("k")).collect()
    assert all(key_value(r.k) == r.v for r in rows)
    assert [r.v for r in sorted(rows, key=lambda r: r.k)] == sorted(values)


def test_negative_and_tiny_values_are_selected(spark):
    rnd = random.Random(9)
    values = [rnd.choice([-1, 1]) * 10.0 ** rnd.randint(-320, 300) * rnd.random() for _ in range(2000)] + [0.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, ["v"], {"v": len(values)}, [0.0, 0.1, 0.5, 1.0])["v"]
    for q in (0.0, 0.1, 0.5, 1.0):
        assert math.isclose(got[q], _np_quantile(values, q), rel_tol=1e-12), q


def test_id_columns_are_no_categories(spark):
    df = spark.createDataFrame([("a", "b", "c")], "`Customer Id` string, Customer string, Gender string")
    assert [r["column"] for r in column_stats(df).collect()] == ["Gender"]
