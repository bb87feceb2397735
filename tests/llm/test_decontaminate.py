import hashlib
import re
from collections import Counter

from retentio.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(len(w) - min(10, len(w)) + 1) if w else ():
            wins.setdefault(tuple(w[s:s + 10]), set()).add("" if i is None else str(i))
    out = Counter()
    for d, t in docs:
        w, found = words(t), set()
        hit = [0] * len(w)
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if k := wins.get(tuple(w[s:s + n])):
                    found |= k
                    hit[s:s + n] = [1] * n
        x = sorted(found)
        out[d, len(w), sum(hit), len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), any(hit)] += 1
    return out


def check(docs, items):
    got = Counter(tuple(r) for r in D.digest(D.scan(docs, items)).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    return got


def test_matches_brute_force(spark, edge_docs):
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(
        [(11, "A b c d e f g h i j k l m"), (11, "A b c d e f g h i j k l m"), (None, "x y z, x Y z! q"),
         (15, "b c d e f g h i j k l b c d e f g h i j k l"), (16, "x y"), (17, "é è")], "doc_id long, text string"))
    items = spark.createDataFrame([(1, "b c d e f g h i j k"), (2, "x y z"), (10, "c d e f g h i j k l"), (3, None),
                                   (4, "..."), (5, "é"), (None, "q"), (6, "word " * 12)], "item_id long, text string")
    assert any(k[5] for k in check(docs, items))
    check(docs.limit(0), items)
    check(docs, items.limit(0))


def test_whole_tables(spark):
    p = "/root/testdata/sf0.001/"
    assert any(k[5] for k in check(spark.read.parquet(p + "documents.parquet"), spark.read.parquet(p + "benchmark.parquet")))


def test_clean_keeps_columns_and_clean_rows(spark, edge_docs):
    items = spark.createDataFrame([(1, "zwei three four five")], "item_id long, text string")
    left = D.clean(edge_docs, items)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 1
    assert 6 not in {r.doc_id for r in left.collect()}


def test_copies_of_a_contaminated_row(spark):
    """100,000 equal rows with a window, and as many clean ones: each its own row, with the result of one."""
    item = " ".join(f"i{k}" for k in range(12))
    kinds = [(1, f"a b {item} c"), (2, "x y z"), (None, item), (1, "other text")]
    docs = spark.range(200_000).selectExpr("id % 2 as k").union(spark.range(2, 4).toDF("k"))
    names = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(kinds)], "k long, doc_id long, text string")
    docs = docs.join(names, "k").select("doc_id", "text")
    items = spark.createDataFrame([(1, item), (2, item + " more")], "item_id long, text string")
    got = D.scan(docs, items).groupBy("doc_id", "n_words", "n_hit", "items").count().collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(
        [(1, 15, 12, ["1", "2"], 100_000), (2, 3, 0, [], 100_000), (None, 12, 12, ["1", "2"], 1), (1, 2, 0, [], 1)], key=repr)
