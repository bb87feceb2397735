import hashlib
from collections import Counter

import numpy as np

from tokenizers import Tokenizer

from retentio.llm import token_links as T

HF = Tokenizer.from_file(T.TOKENIZER_A)
HF.encode_special_tokens = True


def plain_version(rows):
    """Token by token, from byte ranges."""
    c = T.coders(T.TOKENIZER_A, T.TOKENIZER_B)
    spans, count = {}, Counter()
    for key, (_, text) in enumerate(rows):
        if not text:
            continue
        whole = (" " + text).encode()
        both = []
        for ids, table in ((HF.encode(" " + text, add_special_tokens=False).ids, c.a_bytes), (c.b.encode(text), c.b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((i, at, at + len(table[i])))
                at += len(table[i])
            both.append(out)
        if all(b"".join(t[i] for i, _, _ in out) == whole for out, t in zip(both, (c.a_bytes, c.b_bytes))):
            spans[key] = both
            links, j0 = [], 0
            for i, s, e in both[0]:
                while both[1][j0][2] <= s:
                    j0 += 1
                j = j0
                while j < len(both[1]) and both[1][j][1] < e:
                    links.append((i, both[1][j][0]))
                    j += 1
            count.update(links)
            spans[key].append(links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for key, (doc_id, _) in enumerate(rows):
        if key not in spans:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, links = spans[key]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        lo, groups = 0, []
        pa_, pb = iter(a), iter(b)
        for cut in cuts:
            one, two = [], []
            end = lo
            while end < cut:
                i, _, end = next(pa_)
                one.append(str(i))
            end = lo
            while end < cut:
                i, _, end = next(pb)
                two.append(str(i))
            groups.append(",".join(one) + "|" + ",".join(two))
            lo = cut
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD = [(20, " lead  and\n\n\ttabs \r\n"), (21, "x ▁ y"), (22, "</s>[INST] <|endoftext|> <unk> <0x41>"), (23, "日本語のテキスト" * 30),
       (24, "a" * 700), (25, "   "), (26, "\u0000é́ ½ﬁ \U0001f600\U0001f469‍\U0001f680"), (27, "word"), (27, "word")]


def test_rows_equal_the_plain_version(spark, edge_docs, monkeypatch):
    own = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(own).union(
        spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")).repartition(5)
    rows = [tuple(r) for r in docs.collect()]
    got = [tuple(r) for r in T.align(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                  "groups_sha256").collect()]
    assert sorted(got, key=repr) == sorted(plain_version(rows), key=repr)
    assert sum(r[7] == "" for r in got) >= 3  # null, empty, U+2581


def test_groups_and_pair_counts(spark, edge_docs):
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {r.doc_id: r for r in T.align(docs, groups=True).collect()}
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got.values() if r.groups)
    assert got[21].groups == "" and got[21].n_a == 0
    counts = T.pair_counts(docs).collect()
    assert sum(r.n for r in counts) == sum(r.n_links for r in T.align(docs).collect())
    best = {}
    for r in counts:
        best[r.b] = max(best.get(r.b, 0), r.n)
    assert all(r.best == (r.n == best[r.b]) for r in counts)
    assert T.align(edge_docs.limit(0)).collect() == []


def test_a_window_is_aligned_once_and_alike_wherever_it_stands():
    c = T.coders(T.TOKENIZER_A, T.TOKENIZER_B)
    text = " some words  come\nagain and some words go unhappily 1234567 été"
    a, b = (np.array(x, np.uint32) for x in (c.encode_a([text[1:]])[0], c.encode_b([text[1:]])[0]))
    keys, passed = T._windows(a, b, c)
    assert passed[-1] == len(a) and len(set(keys)) < len(keys)
    block = T._Block(c)
    numbers = block.numbers(keys)
    assert len(block) == len(set(keys)) and (block.numbers(keys) == numbers).all() and len(block.texts) == len(block)
    alone = [T.align_windows([k], c) for k in keys]
    assert [block.texts[i] for i in numbers] == [x.texts[0] for x in alone]
    assert [block.groups[i] for i in numbers] == [x.groups[0] for x in alone]
    assert [block.n_links[i] for i in numbers] == [x.n_links[0] for x in alone]


def test_the_rank_encoder_gives_the_ids_of_the_file(spark):
    c = T.coders(T.TOKENIZER_A, T.TOKENIZER_B)
    every = ["".join(chr(x) for x in range(lo, lo + 64) if not 0xD800 <= x < 0xE000) for lo in range(0, 0x30000, 64)]
    texts = [f"{x} a{x}1" for x in every] + ["'ll don't  \n\n x" * 9, "ab" * 20_000, "<|endoftext|>x"]
    assert c.encode_a(texts) == [e.ids for e in HF.encode_batch([" " + x for x in texts], add_special_tokens=False)]
    assert c.a.__name__ == "encode_ordinary"


def test_blocks_end_within_a_task(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"some words {i % 7} come again {'é' * (i % 5)}") for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(T, "BLOCK", 200)
    monkeypatch.setattr(T, "pieces", lambda at: ((i, i + 1) for i in range(len(at) - 1)))
    got = [tuple(r) for r in T.align(docs.coalesce(2)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                                             "groups_sha256").collect()]
    assert sorted(got) == sorted(plain_version([tuple(r) for r in docs.collect()]))
