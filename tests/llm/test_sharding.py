import zlib

import pytest

from retentio.llm import sharding


def check(docs, shards):
    m = sharding.shard(docs, shards).toPandas()
    texts = docs.select("doc_id", "text").toPandas()
    assert len(m) == len(texts)
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts.text)
    assert sorted(zip(m["size"], m.text_crc32)) == want
    count = m.groupby("shard").size().reindex(range(shards), fill_value=0)
    assert count.max() - count.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in m.groupby("shard"))
    return m


def test_groups_stay_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = check(docs, 24).merge(docs.toPandas()[["doc_id", "text"]], on="doc_id")
    assert (m.groupby("text").shard.nunique() == 1).all()


@pytest.mark.parametrize("n", [30, 90])
def test_a_group_larger_than_a_shard(spark, n):
    docs = spark.createDataFrame([(i, "same" if i < n else f"own {i}") for i in range(100)], "doc_id long, text string")
    m = check(docs, 5)
    per = m[m.doc_id < n].groupby("shard").size()
    assert len(per) <= -(-n // 20) + 1  # as few shards as it needs, but for crumbs


def test_edges(spark, edge_docs):
    check(edge_docs, 24)
    check(edge_docs, 3)
    out = sharding.shard(edge_docs, keep=("lang", "score"))
    assert {"lang", "score"} <= set(out.columns)
    assert sharding.shard(edge_docs.limit(0)).collect() == []
