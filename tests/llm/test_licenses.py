import re

from retentio.llm import licenses
from retentio.llm.license_rules import RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = sorted((i, k) for k, p in BASE.items() for i in range(len(words)) if words[i:i + len(p)] == p)
    return (len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({k for _, k in at})))


def test_base_places_match_brute_force(spark, edge_docs):
    docs = edge_docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), allowMissingColumns=True)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=repr)
    got = licenses.scan(docs).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr) == want
    for r in got:
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert r.labels == ",".join(sorted({d.label for d in r.detections}))


def test_hundreds_of_rules_parse_and_name_their_keywords():
    rules = licenses.parse(RULES)
    assert len(rules) >= 250
    for r in rules:
        # a gate must be open wherever the pattern can match: every keyword is a word of it
        plain = re.sub(rb"\[([a-z])[a-z0-9]*\]", rb"\1", r.pattern.pattern)
        assert r.keywords <= set(re.findall(rb"[a-z0-9]+", plain)), r


def test_weaker_detections_inside_stronger_ones_are_suppressed():
    s = licenses.Scanner()
    n, found = s.scan("Licensed under the GNU Lesser General Public License, version 2.1 and CC BY-NC-SA 4.0")
    labels = [s.rules[d.rule].label for d in found]
    assert "lgpl-2.1" in labels and "cc-by-nc-sa-4.0" in labels
    assert "lgpl-unversioned" not in labels and "cc-by-nc-sa" not in labels  # contained and weaker
    assert "gpl" in labels and "cc-by" in labels  # base places stay


def test_suppression_equals_all_pairs():
    s = licenses.Scanner()
    import random
    rng = random.Random(3)
    ranked = [i for i, r in enumerate(s.rules)]
    for _ in range(200):
        found = [licenses.Detection(a, a + rng.randint(1, 6), rng.choice(ranked)) for a in
                 (rng.randint(0, 10) for _ in range(12))]
        rank = lambda d: s.rules[d.rule].rank
        order = sorted(found, key=lambda d: (d.start, -d.end, rank(d), d.rule))

        def beaten(i):
            d = order[i]
            return rank(d) > 0 and any(
                rank(e) > 0 and e.start <= d.start and d.end <= e.end
                and (rank(e) < rank(d) or rank(e) == rank(d) and j < i) and (rank(e), j) != (rank(d), i)
                for j, e in enumerate(order) if j != i and (j < i or (e.start, e.end) != (d.start, d.end)))
        want = [d for i, d in enumerate(order) if not beaten(i)]
        assert s._standing(list(found)) == want


def test_empty_table(spark, edge_docs):
    assert licenses.scan(edge_docs.limit(0)).collect() == []


def test_either_spelling():
    s = licenses.Scanner()
    assert {s.rules[d.rule].label for d in s.scan("under the MIT Licence")[1]} == {"mit"}
