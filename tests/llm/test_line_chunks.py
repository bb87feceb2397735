import random

import duckdb
import pandas as pd

from retentio.llm import line_chunks as L


def brute(docs):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    return {tuple(r) for r in con.sql(L.ORACLE).select("doc_id, n_lines, n_removed, text").fetchall()}


def test_matches_sql(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = L.dedup(docs)
    assert {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()} == brute(docs)
    assert got.where("n_removed > 0").count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_boundaries_do_not_shift(spark):
    """A passage is cut alike wherever it stands, but for its edges."""
    passage = [f"line {i} of a passage that repeats" for i in range(40)]
    docs = spark.createDataFrame([(1, "\n".join(["a"] + passage)), (2, "\n".join(["b", "c", "d"] + passage + ["e"])),
                                  (3, "x\ny\nz")], "doc_id long, text string")
    got = {r.doc_id: r for r in L.dedup(docs).collect()}
    assert got[1].n_removed == 0 and got[3].text == "x\ny\nz"
    assert got[2].n_removed == 40 and got[2].text == "b\nc\nd\ne"


def test_edges(spark, edge_docs):
    got = L.dedup(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert all(r.text == "" and r.n_lines == 0 for r in got if r.doc_id == 4 or r.doc_id is None)
    assert len({r.text for r in got if r.doc_id == 1}) == 1
    assert L.dedup(edge_docs.limit(0)).collect() == []


def test_a_null_id_is_no_part_of_the_text(spark):
    """(null, "5:..") and (5, "..") are two documents: each keeps its own result."""
    lines = "\n".join(f"a line of number {i} here" for i in range(30))
    rows = [(3, lines), (None, "5:" + lines), (5, lines)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.dedup(df).collect()}
    assert got[None].text == "5:" + lines and got[None].n_removed == 0   # a null id comes first
    assert got[5].n_removed > 0 and got[3].n_removed > 0


def passages(rng, n_lines, words):
    return "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n_lines))


def test_recall_by_length(spark):
    """Passages between lines of their own, each twice: three short lines or two long ones are enough to be found."""
    rng = random.Random(1)
    rows, at = [], 0
    cases = [(n, 6) for n in (2, 3, 4, 5, 8, 50)] + [(2, 30), (3, 30), (4, 30)]
    for n, words in cases:
        for _ in range(100):
            p = passages(rng, n, words)
            for _ in range(2):
                rows.append((at, "\n".join([passages(rng, rng.randrange(1, 4), 6), p, passages(rng, rng.randrange(1, 4), 6)])))
                at += 1
    got = {r.doc_id: r.n_removed for r in L.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (n, words) in enumerate(cases):
        second = [got[i] for i in range(200 * k + 1, 200 * (k + 1), 2)]
        assert all(got[i] == 0 for i in range(200 * k, 200 * (k + 1), 2))
        assert second == [0 if (n, words) == (2, 6) else n] * 100, (n, words)


def test_small_alphabet_matches_sql_and_no_line_is_lost(spark):
    """Few different lines, so windows overlap, nest, repeat within a text and point to many firsts."""
    rng = random.Random(2)
    lines = ["a", "b", "", "é😀", "long " * 30, "wide " * 22]
    rows = [(i, "\n".join(rng.choice(lines[:rng.choice((1, 2, 3, 6))]) for _ in range(rng.randrange(0, 14)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "a\n" * 50), (403, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, r.n_removed, r.text) for r in L.dedup(docs).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    assert got == {tuple(r) for r in con.sql(L.ORACLE).select("doc_id, n_lines, n_removed, text").fetchall()}
    before = {x for _, t in rows if t for x in t.split("\n")}
    assert {x for _, _, _, t in got for x in t.split("\n")} >= before


def test_a_third_of_the_rows_are_copies(spark):
    rng = random.Random(3)
    p = passages(rng, 20, 8)
    rows = [(i, p) for i in range(2000)] + [(2000 + i, passages(rng, 3, 8)) for i in range(4000)] + [(7, p)] * 50
    got = L.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).collect()
    assert len(got) == len(rows)
    assert {r.n_removed for r in got if r.doc_id == 0} == {0} and {r.n_removed for r in got if 0 < r.doc_id < 2000} == {20}
    assert {r.n_removed for r in got if r.doc_id >= 2000} == {0}
