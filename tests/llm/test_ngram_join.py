import random
import re

import numpy as np
import pytest

from retentio.llm import ngram_join as N


def brute(rows, k, percent):
    """Components by comparing every pair of sets."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                x = len(a & b)
                if 100 * x >= percent * (len(a) + len(b) - x):
                    up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min((x for x in (least.get(top(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def check(docs, k=4, percent=85):
    got = sorted((tuple(r) for r in N.join(docs, k, percent).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    return got


def varied(spark, n=250, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 60))] for _ in range(15)]
    rows = [(1, "a b"), (1, "A b"), (None, None), (3, ""), (None, "a b"), (5, "x y z q"), (6, "x y z Q\t"), (7, "only")]
    for i in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((100 + i, " ".join(b)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("k,percent", [(4, 85), (2, 60)])
def test_components_match_all_pairs(spark, k, percent):
    got = check(varied(spark), k, percent)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_small_blocks_and_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "LONG_LIST", 5)
    monkeypatch.setattr(N, "PART", 3)
    monkeypatch.setattr(N, "BLOCK", 2)
    monkeypatch.setattr(N, "REMEMBERED", 2)
    check(varied(spark, 120, 2))


def test_divide_skip_is_counting():
    rng = np.random.default_rng(4)
    for _ in range(60):
        q = np.unique(rng.integers(0, 200, 60).astype(np.uint64))
        sets = [np.unique(rng.integers(0, 200, rng.integers(1, 90)).astype(np.uint64)) for _ in range(30)]
        least = [int(rng.integers(1, 40)) for _ in sets]
        want = [i for i, s in enumerate(sets) if len(np.intersect1d(q, s)) >= least[i]]
        assert sorted(N.divide_skip(q, sets, least)) == want


def test_whole_table_and_edges(spark, edge_docs):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    check(edge_docs.select("doc_id", "text"))
    assert N.join(edge_docs.limit(0)).collect() == []


def test_one_of_each(spark, edge_docs):
    docs = edge_docs.unionByName(edge_docs)
    left = N.one_of_each(docs)
    assert left.columns == docs.columns
    want = {c for _, n, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80) if n}
    assert sorted(r.doc_id for r in left.collect() if (r.text or "").strip()) == sorted(want)
    assert left.where("trim(coalesce(text, '')) = ''").count() == docs.where("trim(coalesce(text, '')) = ''").count()


def templated(spark, n=60, seed=5):
    """Documents of one template that differ in about a fifth of their words at one end: few are linked, all share lists."""
    rng = random.Random(seed)
    head = [f"t{i}" for i in range(40)]
    return spark.createDataFrame([(i, " ".join(head + [f"x{rng.randint(0, 9)}" for _ in range(rng.randint(1, 9))]))
                                  for i in range(n)], "doc_id long, text string")


def test_a_crowded_hub_is_dealt_by_pairs_of_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 8)
    monkeypatch.setattr(N, "FOUND", 4)
    monkeypatch.setattr(N, "CHUNK", 16)
    seen = []
    cross = N._cross_links
    monkeypatch.setattr(N, "_cross_links", lambda *a: seen.append((a, cross(*a))) or seen[-1][1])
    check(templated(spark))
    _, out = seen[0]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[hub#\d+, p#\d+L?, q#\d+L?\]", plan)


def near_threshold(spark, n=120, seed=3):
    """One large group whose members are mostly just beyond the threshold of one another: all share lists, no hub links many."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([1, 2, 2, 3])):
            words[at] = f"y{rng.randint(0, 5)}"
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_pairs_never_become_rows(spark, monkeypatch):
    made = []
    for name in ("_open_rows", "_cross_links"):
        plain = getattr(N, name)
        monkeypatch.setattr(N, name, lambda *a, plain=plain: made.append(N.saved(plain(*a))) or made[-1])
    docs = near_threshold(spark)
    check(docs)
    rows, links = made
    places = rows.select("hub", "p", "q", "cls").distinct().count()
    assert rows.count() > 0 and links.count() < places
    # a forest: fewer links than classes in every place
    assert links.count() <= places - rows.select("hub", "p", "q").distinct().count()


def test_large_sets_make_small_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_SHINGLES", 500)
    check(near_threshold(spark, 60, 9))


def test_places_are_bounded_and_every_pair_has_one(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 20)
    names = [i.to_bytes(16, "big") for i in range(200)]
    on = {g: [i for i in range(200) if i == 0 or (i * 7 + g) % 3] for g in range(6)} | {9: [0, 5, 6]}
    rows = spark.createDataFrame([(g, names[i], 100, 1, i) for g, members in on.items() for i in members],
                                 "gram long, cls binary, n long, at long, label long")
    signs = spark.createDataFrame([(c, [0] * 8) for c in names], "cls binary, sign array<long>")
    places = {}
    for r in N._dealt(rows, signs).collect():
        places.setdefault((r.hub, r.p, r.q), {}).setdefault(r.gram, []).append((r.own, bytes(r.cls)))
    classes = [len({c for rows_ in lists.values() for _, c in rows_}) for lists in places.values()]
    assert max(classes) <= 80 and len(places) >= 36
    for g, members in on.items():
        met = [tuple(sorted((a, b))) for (_, p, q), lists in places.items() for x, (o, a) in enumerate(lists.get(g, []))
               for o2, b in lists[g][:x] if p == q or o != o2]
        assert len(met) == len(set(met)) == len(members) * (len(members) - 1) // 2
