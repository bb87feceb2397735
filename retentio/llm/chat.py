"""Chat formatting at token level.

Each text is escaped and encoded by itself, row by row, before anything is
shuffled; a conversation is then spliced together from those ids and reserved
ids that no text can produce. The loss mask comes from prefix sums over the
lengths of the pieces. Within a conversation rows stream in order of turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Control strings of the template; each has an id of its own beyond the vocabulary, in this order.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
BOS, EOS, INST, END_INST, SYS, END_SYS, ROLE, END_ROLE = range(8)

# a control string, or one with backslashes after its first character
_BODIES = sorted({c[1:] for c in CONTROLS}, key=len, reverse=True)
_RISKY = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))


def escape(text: str) -> str:
    """``text`` without control strings: each gets a backslash after its first character, one more if it has some."""
    return _RISKY.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


class Codec(NamedTuple):
    tokenizer: object
    first: int  # id of the first control string

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return Codec(t, t.get_vocab_size(with_added_tokens=True))


def _encoded(rows: DataFrame, path: str) -> DataFrame:
    """Rows with ``role_ids`` and ``ids``: role and escaped text, each encoded by itself."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                roles = [r or "" for r in part.column(2).to_pylist()]
                texts = [escape(t or "") for t in part.column(3).to_pylist()]
                known = [[] if r in ("user", "assistant", "system") else c.encode([escape(r)])[0] for r in roles]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(roles, pa.string()), pa.array(texts, pa.string()),
                     pa.array(known, pa.list_(pa.int32())), pa.array(c.encode(texts), pa.list_(pa.int32()))],
                    ["conv_id", "turn", "role", "text", "role_ids", "ids"])

    return rows.select("conv_id", "turn", "role", "text").mapInArrow(
        batches, "conv_id long, turn long, role string, text string, role_ids array<int>, ids array<int>")


def _pieces(role: str, role_ids: list[int], ids: list[int], first: int) -> list[tuple[list[int], bool]]:
    """(ids, under loss) of one turn."""
    def mark(k: int) -> tuple[list[int], bool]:
        return [first + k], False

    if role == "user":
        return [mark(INST), (ids, False), mark(END_INST)]
    if role == "system":
        return [mark(SYS), (ids, False), mark(END_SYS)]
    if role == "assistant":
        return [(ids, True), mark(EOS)]
    return [mark(ROLE), (role_ids, False), mark(END_ROLE), (ids, False), mark(EOS)]


def mask(lengths: list[int], under: list[bool]) -> np.ndarray:
    """1 for tokens of pieces under loss: +1 where such a piece starts, -1 where it ends, summed up."""
    ends = np.cumsum(lengths)
    steps = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    chosen = np.asarray(under, bool)
    np.add.at(steps, (ends - lengths)[chosen], 1)
    np.add.at(steps, ends[chosen], -1)
    return np.cumsum(steps)[:-1].astype(np.int8)


#: Tokens after which a row ends, at the end of its turn; the conversation goes on in the next.
PART_TOKENS = 1 << 18
FORMATTED = "conv_id long, part int, token_ids array<int>, loss_mask array<byte>"


def format_chats(rows: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Each conversation of ``rows`` (conv_id, turn, role, text): (conv_id, part, token_ids, loss_mask).

    One row per conversation, part 0; one of more than PART_TOKENS tokens goes
    on in parts 1, 2, .., each of whole turns, next to one another in order.
    Rows go by turn, then role and text. User turns read ``[INST]..[/INST]``,
    system turns ``<<SYS>>..<</SYS>>``, assistant turns ``..</s>``, others
    ``[ROLE]role[/ROLE]..</s>``, after one ``<s>``. Loss is on assistant texts,
    without their end mark. A null text or role is an empty one; rows without
    conv_id are one conversation with a null id; repeated rows are turns as
    others; other columns are not read; an empty table gives an empty table.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = codec(path).first
        now, pieces, size, at = None, [], 0, 0  # at: number of the part at hand

        def done() -> pa.RecordBatch:
            lengths = [len(i) for i, _ in pieces]
            ids = np.fromiter((t for i, _ in pieces for t in i), np.int32, sum(lengths))
            m = mask(lengths, [u for _, u in pieces])
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([at], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids)),
                 pa.ListArray.from_arrays(pa.array([0, len(m)], pa.int32()), pa.array(m))],
                ["conv_id", "part", "token_ids", "loss_mask"])

        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                for r in batch.slice(lo, 256).to_pylist():
                    if now != (r["conv_id"],):
                        if now:
                            yield done()
                        now, pieces, size, at = (r["conv_id"],), [([first + BOS], False)], 1, 0
                    elif size >= PART_TOKENS:
                        yield done()
                        pieces, size, at = [], 0, at + 1
                    turn = _pieces(r["role"], r["role_ids"], r["ids"], first)
                    pieces += turn
                    size += sum(len(i) for i, _ in turn)
        if now:
            yield done()

    encoded = _encoded(rows, path)
    return (encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
            .select("conv_id", "role", "role_ids", "ids").mapInArrow(batches, FORMATTED))


def turns_of(ids: np.ndarray, c: Codec) -> list[tuple[str, str]]:
    """(role, text) of each turn, read from the ids alone."""
    marks = np.flatnonzero(ids >= c.first)
    out, role, named = [], "assistant", None
    for a, b in zip(marks[:-1], marks[1:]):
        opened, closed = int(ids[a]) - c.first, int(ids[b]) - c.first
        if closed in (INST, SYS, ROLE):  # nothing stands before an opening mark
            continue
        inside = unescape(c.decode(ids[a + 1:b].tolist()))
        if opened == ROLE:
            named = inside
            continue
        role = {INST: "user", SYS: "system", END_ROLE: named}.get(opened, "assistant")
        out.append((role, inside))
    return out


def read_back(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Digests of ``format_chats``'s rows, from ids and mask alone, one per conversation.

    Parts are read as ``format_chats`` emits them, in order; digests and counts run on from part to part.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        now, rows = None, []

        def done() -> None:
            rows.append({"conv_id": now[0], "n_turns": n_turns, "turns_sha256": whole.hexdigest(), "loss_chars": n_loss,
                         "loss_sha256": loss.hexdigest(), "formatted_chars": n})

        for batch in it:
            for k in range(batch.num_rows):
                ids = batch.column(2)[k].values.to_numpy()
                under = batch.column(3)[k].values.to_numpy().astype(bool)
                if batch.column(1)[k].as_py() == 0:
                    if now:
                        done()
                    now, n_turns, n_loss, n = (batch.column(0)[k].as_py(),), 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                else:  # the mark that its first turn follows
                    ids, under = np.r_[np.int32(c.first + BOS), ids], np.r_[False, under]
                    n -= len(CONTROLS[BOS])
                turns = turns_of(ids, c)
                n_turns += len(turns)
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                # runs under the mask, each decoded by itself
                edges = np.flatnonzero(np.diff(np.r_[False, under, False].astype(np.int8)))
                for a, b in edges.reshape(-1, 2):
                    text = unescape(c.decode(ids[a:b].tolist()))
                    loss.update(text.encode())
                    n_loss += len(text)
                marks = np.flatnonzero(ids >= c.first)
                n += sum(len(CONTROLS[int(ids[m]) - c.first]) for m in marks) + sum(
                    len(c.decode(ids[a + 1:b].tolist())) for a, b in zip(marks[:-1], marks[1:]) if b > a + 1)
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows.clear()
        if now:
            done()
            yield pa.RecordBatch.from_pylist(rows, schema)

    return formatted.mapInArrow(batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                         "loss_sha256 string, formatted_chars long")


def rendered(ids: list[int], path: str = TOKENIZER) -> str:
    """The formatted text of a row's ids."""
    c = codec(path)
    out, run = [], []
    for i in ids:
        if i >= c.first:
            out += [c.decode(run) if run else "", CONTROLS[i - c.first]]
            run = []
        else:
            run.append(i)
    return "".join(out) + (c.decode(run) if run else "")
