import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import fill_middle as M


def plain_version(doc_id, text, seed=1):
    """Unit by unit, from the words of the contract."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        form, out, chars = "plain", text, (None, None)
    else:
        form = "spm" if h4 % 100 < 20 else "psm"
        out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
        chars = len(prefix), len(middle)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *chars, sha(out), sha(text))


def test_rows_equal_the_plain_version(spark, edge_docs):
    own = spark.createDataFrame([(20, "a <P> b"), (21, "x<"), (22, "S><P"), (23, "M>" * 50), (24, "<" * 40), (25, "<S" * 30),
                                 (26, "é" * 5000 + "word " * 3000 + "1" * 9000), (27, "a"), (28, " \r\n\t")],
                                "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(own).union(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    want = sorted((plain_version(r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = sorted((tuple(r) for r in M.digest(M.transform(docs)).collect()), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_several_draws_come_from_one_index(spark, edge_docs):
    rows = M.transform(edge_docs, seeds=(1, 2, 3)).collect()
    assert len(rows) == 3 * edge_docs.count()
    long_ = [r for r in rows if r.doc_id == 5]
    text = edge_docs.where("doc_id = 5").first().text
    assert sorted(hashlib.sha256(r.output.encode()).hexdigest() for r in long_) == sorted(
        plain_version(5, text, s)[5] for s in (1, 2, 3))


def test_index_is_exact_and_small(spark, edge_docs):
    rows = {r.doc_id: r for r in M.rank_index(edge_docs.where("doc_id in (4, 5, 6)")).collect()}
    assert rows[4].n == 0 and len(rows[4].residuals) == 1
    r = rows[5]
    index = M.RankIndex(*(np.array([getattr(s, f) for s in r.segments]) for f in ("first", "base", "slope")),
                        np.frombuffer(r.residuals, np.int8))
    text = edge_docs.where("doc_id = 5").first().text
    ends = np.cumsum([0] + [len(u.encode()) for u in re.findall("[A-Za-z]+|[^A-Za-z]", text)])
    assert (index.at(np.arange(r.n + 1)) == ends).all()
    assert len(r.segments) < 10
    assert M.rank_index(edge_docs.limit(0)).collect() == [] and M.transform(edge_docs.limit(0)).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4000), max_size=400))
def test_every_rank_is_found(steps):
    offsets = np.cumsum([0, *steps]).astype(np.int64)
    index = M.fit(offsets)
    assert (index.at(np.arange(len(offsets))) == offsets).all()
    assert np.abs(offsets - index.predicted(np.arange(len(offsets)))).max() <= M.ERROR


def test_a_segment_goes_on_over_many_steps():
    offsets = np.arange(10 * M.STEP + 7, dtype=np.int64) * 3
    assert len(M.fit(offsets).first) == 1
