"""The stages one by one against what they must keep, and tables written in between."""

import corpus_pipeline as C
from retentio.llm import cube, quality
from test_decontaminate import brute as hits
from test_ngram_join import brute as groups

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    labels, items = spark.read.parquet(SF + "/labels.parquet"), spark.read.parquet(SF + "/benchmark.parquet")
    columns = docs.columns
    stages = dict(C.STAGES)
    assert list(stages) == ["quality", "near_copies", "benchmark", "mix", "shards"]

    good = stages["quality"](spark, docs, SF).cache()
    want = {r.doc_id for r in quality.classify(docs, labels).where("accepted").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == want

    rows = [(r.doc_id, r.text) for r in good.collect()]
    unlike = stages["near_copies"](spark, good, SF).cache()
    want = {c for _, n, c in groups(rows, 5, 80) if n} | {d for d, n, _ in groups(rows, 5, 80) if not n}
    assert unlike.columns == columns and {r.doc_id for r in unlike.collect()} == want

    clean = stages["benchmark"](spark, unlike, SF).cache()
    found = hits([(r.doc_id, r.text) for r in unlike.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {k[0] for k in found if not k[5]}

    mixed = stages["mix"](spark, clean, SF).cache()
    taken = {r.doc_id: r.copies for r in cube.mix(clean).collect() if r.copies}
    assert mixed.columns == columns
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken

    out = stages["shards"](spark, mixed, SF).toPandas()
    assert len(out) == mixed.count() and sorted(out.doc_id) == sorted(r.doc_id for r in mixed.collect())
    # seven rows a shard: a few groups straddle two full ones, most copies stay together
    assert (out.groupby("doc_id").shard.nunique() > 1).mean() < 0.1
    count = out.groupby("shard").size()
    assert count.max() - count.min() <= 1


def test_empty_documents(spark, tmp_path):
    none = spark.read.parquet(SF + "/documents.parquet").limit(0)
    for name, stage in C.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_odd_documents(spark, edge_docs):
    docs = edge_docs
    for name, stage in C.STAGES:
        docs = stage(spark, docs, SF)
        docs.count()
