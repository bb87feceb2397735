import random

import pytest

from retentio.llm import cube


def water(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest, open_ = total - sum(cap * sizes[n] for n in full), sum(w[n] for n in names if n not in full)
        t = {n: cap * sizes[n] if n in full else rest * w[n] / open_ for n in names}
        new = {n for n in names if n not in full and t[n] > cap * sizes[n]}
        if not new:
            return t
        full |= new


@pytest.mark.parametrize("block", [16, 4096])
def test_targets_and_balance(spark, block):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = cube.mix(docs, block=block).toPandas()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r.size for r in got.itertuples()} == sizes
    g = got.groupby("source").agg(s=("size", "sum"), t=("target", "first"), k=("taken", "sum"), big=("size", "max"))
    want = water(g.s.to_dict())
    for name, r in g.iterrows():
        assert abs(r.t - want[name]) < 1e-6 * max(1, r.t)
        assert abs(r.k - r.t) <= 0.02 * r.t + 60
    assert (got.taken == got.copies * got["size"]).all() and got.copies.max() <= 3
    again = cube.mix(docs, block=block).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_flight_keeps_both_totals():
    rng = random.Random(5)
    units = [(rng.choice([0.3, 0.5, 0.9]), float(rng.randint(0, 500))) for _ in range(400)]
    p = cube.fly(units, rng.random)
    assert sum(0 < q < 1 for q in p) <= 2
    assert abs(sum(p) - sum(q for q, _ in units)) < 1e-6
    assert abs(sum(q * s for q, (_, s) in zip(p, units)) - sum(q * s for q, s in units)) < 1e-3


def test_flight_keeps_the_mean_of_each_probability():
    units = [(0.3, 1.0), (0.5, 7.0), (0.6, 3.0), (0.2, 5.0)]
    runs = [cube.fly(units, random.Random(i).random) for i in range(4000)]
    for k, (q, _) in enumerate(units):
        assert abs(sum(r[k] for r in runs) / len(runs) - q) < 0.03


def test_edges(spark, edge_docs):
    got = cube.mix(edge_docs).collect()
    assert len(got) == edge_docs.count() and all(r.size == 0 for r in got if r.doc_id in (4, 7))
    assert cube.mix(edge_docs.limit(0)).collect() == []
    out = cube.repeated(edge_docs)
    assert out.columns == edge_docs.columns and out.count() <= 3 * edge_docs.count()


def test_copies_of_a_row_fill_no_block(spark):
    """100,000 equal rows are dealt to all blocks; the mix of them keeps its targets and agrees with itself."""
    state = spark.createDataFrame([(k, n, 30) for k, n in [(5, 100_000), (-7, 31), (9, 29), *((k, 1) for k in range(3000))]],
                                  "spread long, alike long, blocks long")
    per = [r[0] for r in cube.deal(state).groupBy("block").sum("alike").select("sum(alike)").collect()]
    assert sum(per) == 103_060 and max(per) - min(per) < 200
    rows = [(1, "one two three", "a")] * 20_000 + [(i, "w " * (i % 50), "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = cube.mix(docs, block=512).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 0.01 * g.target.iloc[0]
    again = cube.mix(docs.repartition(3), block=512).toPandas()
    order = ["source", "doc_id", "copies"]
    assert got.sort_values(order)[order].values.tolist() == again.sort_values(order)[order].values.tolist()
