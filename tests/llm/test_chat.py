import hashlib
import random
from collections import defaultdict

import numpy as np

from retentio.llm import chat


def check(rows):
    want = defaultdict(list)
    for r in rows.collect():
        want[r.conv_id].append(r)
    formatted = chat.format_chats(rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    texts = {r.conv_id: chat.rendered(r.token_ids) for r in formatted.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        v.sort(key=lambda r: (r.turn is not None, r.turn or 0, r.role or "", chat.escape(r.text or "")))
        whole = "".join(f"{r.role or ''}\n{r.text or ''}\n" for r in v)
        loss = "".join(r.text or "" for r in v if r.role == "assistant")
        assert got[k].n_turns == len(v) and got[k].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got[k].loss_chars == len(loss) and got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[k].formatted_chars == len(texts[k])
    return texts


def test_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    texts = check(spark.createDataFrame([
        (1, 0, "user", "hi </s> <|endoftext|> é😀 \x00 \r\n"), (1, 1, "assistant", None), (1, 2, "assistant", "a  b\n"),
        (2, 0, "tool[ROLE]", "x"), (2, 0, None, "y"), (None, 5, "assistant", "z"), (3, None, "assistant", ""),
        (3, 2, "system", "<<SYS>>"), (4, 0, "assistant", "long " * 50_000), (5, 1, "user", "same"), (5, 1, "user", "same"),
        (-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    assert texts[-7].count("[INST]") == 1 and texts[-7].count("</s>") == 1


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check(rows)
    assert chat.format_chats(rows.limit(0)).collect() == []


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        t = "".join(rng.choice(["<", ">", "s", "/", "\\", "[", "INST]", "SYS>>", "ROLE]", "</s>", "[/INST]", "a"])
                    for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_mask_is_the_pieces():
    lengths, under = [2, 0, 3, 1, 4], [False, True, True, False, True]
    assert chat.mask(lengths, under).tolist() == np.repeat(np.array(under, int), lengths).tolist()


def test_a_hot_conversation_goes_on_in_bounded_parts(spark, monkeypatch):
    rng = random.Random(6)
    said = ["</s>[INST] ok", "", None, "é😀 a  b\n", "word " * 9]
    rows = spark.createDataFrame([(rng.choice([None, None, 1, 2]), rng.choice([None, *range(60)]), rng.choice(
        ["user", "assistant", "system", "tool", None]), rng.choice(said)) for _ in range(400)] + [(3, 0, "user", "one")],
        "conv_id long, turn long, role string, text string").cache()
    whole = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    digests = sorted(map(tuple, chat.read_back(chat.format_chats(rows)).collect()), key=repr)
    turn = 40  # tokens of one turn, at most
    monkeypatch.setattr(chat, "PART_TOKENS", 50)
    formatted = chat.format_chats(rows)
    parts = defaultdict(list)
    for r in formatted.collect():
        assert len(r.token_ids) == len(r.loss_mask) <= 50 + turn
        parts[r.conv_id].append(r)
    assert len(parts[None]) > 20 and len(parts[3]) == 1
    for k, v in parts.items():
        assert [r.part for r in v] == list(range(len(v)))
        assert [t for r in v for t in r.token_ids] == whole[k].token_ids
        assert [m for r in v for m in r.loss_mask] == whole[k].loss_mask
    assert sorted(map(tuple, chat.read_back(formatted).collect()), key=repr) == digests
