import hashlib
from collections import Counter

import numpy as np

from retentio.llm import digest as D


def test_levels_match_counting():
    rng = np.random.default_rng(1)
    for n in (0, 1, 31, 32, 33, 400):
        x = rng.integers(97, 105, n).astype(np.uint8)
        want = [(D._MOST - sum(int(D._NLOGN[c]) for c in Counter(x[i:i + 32].tolist()).values())) * 255 // D._MOST
                for i in range(max(0, n - 31))]
        assert D.levels(x).tolist() == want


def test_features_match_counting():
    rng = np.random.default_rng(2)
    for n in (1, 10, 32, 33, 300):
        r = rng.integers(0, 9, n).astype(np.uint8)
        if n < D.NEIGHBOURS:
            want = [int(r.argmin())]
        else:
            wins = Counter(i + int(r[i:i + D.NEIGHBOURS].argmin()) for i in range(n - D.NEIGHBOURS + 1))
            want = sorted(k for k, v in wins.items() if v >= D.WINS) or [max(sorted(wins), key=lambda k: wins[k])]
        assert D.features(r).tolist() == want


def test_edited_texts_and_equal_prints(spark, edge_docs):
    docs = edge_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id > 10"),
                                 allowMissingColumns=True).where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in D.compare_edits(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        n = len(t)
        assert got[i].n_chars == n
        assert got[i].edited_sha256 == hashlib.sha256((t[:n - n // 2] + u[:n // 2]).encode()).hexdigest()
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long_ = [r for r in got.values() if r.n_chars > 300]
    assert np.median([r.near_edited for r in long_]) > 0.3 > np.quantile([r.near_next for r in long_], 0.9)


def test_the_seam_is_the_whole_computation(spark):
    """The edited text's print, put together from parts, is that of the text itself."""
    docs = spark.createDataFrame([(1, "Some words é of a text, here and there. " * 9), (2, "Other 😀 things stand in this one! " * 11)],
                                 "doc_id long, text string")
    ranks = D.fit_ranks(docs)
    (one, a), (_, b) = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    data = np.frombuffer((a[:len(a) - len(a) // 2] + b[:len(a) // 2]).encode(), np.uint8)
    want = D.packed(D.fingerprint(data, ranks[D.all_levels(data)]))
    assert {r.doc_id: r.edited_fingerprint for r in D.compare_edits(docs, ranks).collect()}[one] == want


def test_nulls_repeats_and_empty(spark, edge_docs):
    got = D.compare_edits(edge_docs).collect()
    assert len(got) == edge_docs.count()
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert D.compare_edits(edge_docs.limit(0)).collect() == []
    none, one = print_of(b""), print_of(b"x")
    assert D.likeness(none, none) == 1.0 and D.likeness(none, one) == 0.0 == D.likeness(one, none)


RANKS = np.random.default_rng(3).permutation(D.LEVELS).astype(np.uint8)


def print_of(text):
    data = np.frombuffer(text, np.uint8)
    return D.fingerprint(data, RANKS[D.all_levels(data)])


def words(rng, n):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(n // 3 + 2)).encode()[:n]


def test_likeness_has_no_break_at_any_length():
    """A text and the same without its last byte, from 16 bytes; and a text and its beginning."""
    rng = np.random.default_rng(4)
    for n in [*range(16, 700, 1), 1023, 1024, 1025, 2055, 5000, 70_000]:
        text = words(rng, n)
        assert D.likeness(print_of(text), print_of(text[:-1])) > 0.8, n
    for n, m in ((300, 250), (400, 200), (600, 300), (257, 200), (256, 255), (1000, 300), (3000, 1500)):
        found = [D.likeness(print_of(t), print_of(t[:m])) for t in (words(rng, n) for _ in range(40))]
        assert np.mean(found) > 0.8, (n, m)
    apart = [D.likeness(print_of(words(rng, n)), print_of(words(rng, m))) for n in (20, 100, 255, 300, 900) for m in (20, 256, 400, 3000)]
    assert max(apart) < 0.2


def plain_print(text):
    """Small and wide features as sets of bytes, by loops."""
    small = {text[i:i + 8] for i in range(len(text) - 7)}
    ranks = [int(RANKS[(D._MOST - sum(int(D._NLOGN[c]) for c in Counter(text[i:i + 32]).values())) * 255 // D._MOST])
             for i in range(len(text) - 31)]
    if len(ranks) < D.NEIGHBOURS:
        at = [ranks.index(min(ranks))] if ranks else []
    else:
        wins = Counter(i + ranks[i:i + D.NEIGHBOURS].index(min(ranks[i:i + D.NEIGHBOURS])) for i in range(len(ranks) - D.NEIGHBOURS + 1))
        at = [k for k, v in wins.items() if v >= D.WINS] or [max(sorted(wins), key=lambda k: wins[k])]
    return small, list(dict.fromkeys(text[i:i + 32] for i in sorted(at)))


def bits_of(hashes):
    return {h >> 11 * k & 2047 for h in hashes for k in range(D.BITS_PER_FEATURE)}


def hash_of(window):
    return int(D._lanes(np.frombuffer(window, np.uint8), np.zeros(1, np.int64), len(window))[0])


def set_bits(row):
    return set(np.flatnonzero(np.unpackbits(row)).tolist())


def test_filters_match_brute_force():
    rng = np.random.default_rng(5)
    for n in (8, 20, 31, 32, 40, 100, 135, 136, 400, 4000):
        text = words(rng, n)
        small, wide = plain_print(text)
        got = print_of(text)
        hashes = [hash_of(w) for w in small]
        want = [set() for _ in range(D.SMALL_FILTERS)]
        for h in hashes:
            lead = 64 - h.bit_length() - got.zeros
            if lead >= 0:
                want[min(lead, D.SMALL_FILTERS - 1)].add(int(D.mix(np.array([h], np.uint64))[0]))
        assert [bits_of(w) for w in want] == [set_bits(r) for r in got.small], n
        assert n - 7 <= D.SMALL_FEATURES << got.zeros and (got.zeros == 0 or n - 7 > D.SMALL_FEATURES << got.zeros - 1)
        chains = [wide[k:k + D.FEATURES_PER_FILTER] for k in range(0, len(wide), D.FEATURES_PER_FILTER)]
        assert [bits_of(map(hash_of, c)) for c in chains] == [set_bits(r) for r in got.wide], n


def test_likeness_matches_counting():
    """From the bits as sets: each common filter, and the best of the longer chain for each of the shorter."""
    def over(x, y):
        chance = len(x) * len(y) / D.FILTER_BITS
        chance += D.CUTOFF * (min(len(x), len(y)) - chance)
        return len(x & y) - chance, min(len(x), len(y)) - chance

    rng = np.random.default_rng(6)
    for n, m in ((100, 100), (700, 300), (3000, 700), (9000, 8000), (40, 5000)):
        text = words(rng, n)
        a, b = sorted((print_of(text), print_of(text[:m // 2] + words(rng, m - m // 2))), key=lambda p: p.zeros)
        levels_a = [(a.zeros + k, set_bits(r)) for k, r in enumerate(a.small)]
        levels_b = [(b.zeros + k, set_bits(r)) for k, r in enumerate(b.small)]
        top = a.zeros + D.SMALL_FILTERS - 1
        pairs = [(set().union(*(s for z, s in levels_a if z == k)),
                  set().union(*(s for z, s in levels_b if z == k or k == top and z > k))) for k in range(b.zeros, top + 1)]
        scores = [over(x, y) for x, y in pairs]
        small = min(1.0, max(0.0, sum(o for o, _ in scores) / sum(t for _, t in scores))) if pairs else 0.0
        s = 8 * sum(min(len(x), len(y)) for x, y in pairs)
        one, two = sorted(([set_bits(r) for r in p.wide] for p in (a, b)), key=len)
        best = [max(min(1.0, max(0.0, o / t)) for o, t in (over(x, y) for y in two)) for x in one]
        w = 32 * sum(map(len, one))
        wide = sum(v * len(x) for v, x in zip(best, one)) * 32
        assert abs(D.likeness(a, b) - (wide + small * s) / (w + s)) < 1e-5, (n, m)
