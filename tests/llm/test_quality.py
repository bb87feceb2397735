import numpy as np
import pyarrow as pa

from retentio.llm import quality as Q
from retentio.llm.words import pieces, utf8


def test_held_out_accuracy(spark):
    """Fitted on two thirds of the labels, judged on the last third."""
    p = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(p + "documents.parquet"), spark.read.parquet(p + "labels.parquet")
    model = Q.fit(docs, labels.where("pmod(doc_id, 3) <> 0"), sample=6000)
    held = docs.join(labels.where("pmod(doc_id, 3) = 0"), "doc_id").select("text", "quality", "toxic").toPandas()
    raw, at = utf8(pa.array(held.text))
    got = np.concatenate([Q.predict(model, raw, at, lo, hi) for lo, hi in pieces(at)])
    bad = (held.toxic.to_numpy() == 1) | (held.quality.to_numpy() == 0)
    said = (1 - got[:, 0]) * (1 - got[:, 1]) < 0.5
    assert said[bad].mean() > 0.9 and said[~bad].mean() < 0.01


def test_sparse_sites_shrink_to_their_host_and_all(spark):
    rows = [("h1", "p", 0.1)] * 200 + [("h1", "q", 0.9)] + [("h2", "p", 0.9)] * 200 + [("h3", "p", 0.2)]
    s = {(r.host, r.path): r for r in Q.sites(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    whole = s["h1", "p"].global_rate
    assert s["h1", "p"].host_rate < whole < s["h2", "p"].host_rate
    assert abs(s["h3", "p"].host_rate - whole) < abs(0.2 - whole)
    k, r = s["h1", "q"].path_prior, s["h1", "q"]
    post = (r.path_s + k * r.host_rate) / (r.path_n + k)
    assert min(r.host_rate, 0.9) <= post <= max(r.host_rate, 0.9)


def test_site_sums_match_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [(f"h{i % 7}", f"p{i % 3}", float(x)) for i, x in enumerate(rng.random(600))]
    got = Q.sites(spark.createDataFrame(rows, "host string, path string, good double")).collect()
    for r in got:
        own = [x for h, p, x in rows if (h, p) == (r.host, r.path)]
        assert r.path_n == len(own) and abs(r.path_s - sum(own)) < 1e-9
        host = [x for h, _, x in rows if h == r.host]
        assert abs(r.host_rate - (sum(host) + r.host_prior * r.global_rate) / (len(host) + r.host_prior)) < 1e-9


def test_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    got = Q.classify(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.accepted for r in Q.classify(edge_docs, labels.limit(0)).collect())
    assert Q.classify(edge_docs.limit(0), labels).collect() == []
    left = Q.accepted(edge_docs, labels.limit(0))
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count()


def test_copies_of_a_labelled_row_count_once(spark):
    """A repeated row changes nothing in the fit."""
    rows = [(i, ("vile nasty words here " if i % 3 == 0 else "good calm text there ") + f"number {i} " * 5) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality long, toxic long")
    one = Q.fit(docs, labels)
    many = Q.fit(docs.union(spark.createDataFrame([rows[0]], "doc_id long, text string").crossJoin(spark.range(100_000)).drop("id")), labels)
    for a, b in zip(one, many):
        assert all(np.array_equal(x, y) for x, y in zip(a, b))
