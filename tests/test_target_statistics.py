"""M5: ordered target statistics against a plain loop, with a hot category, NULL categories and missing labels."""

import random

from pyspark.sql import functions as F

from retentio.operators.features import ordered_target_statistics, target_statistics
from retentio.operators.ml import lehmer_hash


def test_rows_before_in_hashed_order(spark):
    rng = random.Random(2)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", "b", None]), rng.choice([0, 1, 1, None])) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, cat string, Churn int")
    got = {r["id"]: r["cat_ts"] for r in ordered_target_statistics(df, ["cat"], lehmer_hash(F.col("id"))).collect()}
    labels = [y for _, _, y in rows if y is not None]
    overall = sum(labels) / len(labels)
    sums = {}
    for i, c, y in sorted(rows, key=lambda r: (r[0] + 42) % 2147483647 * 48271 % 2147483647):
        s, n = sums.get(c, (0, 0))
        assert abs(got[i] - (s + overall) / (n + 1)) < 1e-12
        if y is not None:
            sums[c] = s + y, n + 1
    whole = {r["category"]: r["statistic"] for r in target_statistics(df, "cat").collect()}
    assert all(abs(whole[c] - (s + overall) / (n + 1)) < 1e-12 for c, (s, n) in sums.items())


def test_no_window_over_a_category(spark):
    df = spark.createDataFrame([(i, "hot", i % 2) for i in range(50)], "id long, cat string, Churn int")
    plan = ordered_target_statistics(df, ["cat"], lehmer_hash(F.col("id")))._jdf.queryExecution().optimizedPlan().toString()
    assert "__part" in plan and all("__part" in w for w in plan.split("Window")[1:])
