"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Texts are encoded whole by both. A byte where tokens of both end and a
space-marked token of both begins is an anchor; anchors split a text into
windows, pairs of id tuples, which repeat like words do. Within a block of
documents each window is aligned once and remembered by its ids.

How often an id pair is linked in the whole corpus takes three steps. Documents
lie in blocks of about BLOCK bytes; a block's distinct windows and pairs, with
their counts, are one row. Pairs are summed over blocks, and each block gets
the sums of its own pairs back: what is shuffled for this grows with the
distinct pairs of blocks, not with the tokens, and nothing is broadcast. Then
a block's documents, which hold window numbers, are summed up beside it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import saved
from retentio.llm.words import pieces, utf8

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose windows are numbered together.
BLOCK = 1 << 20
#: Between the A ids and the B ids of a window.
_BETWEEN = np.uint32(0xFFFFFFFF)


class Coders(NamedTuple):
    """Both tokenizers, and what each id stands for: bytes, their number, and whether they start with a space."""
    a: object
    b: object
    a_bytes: list[bytes]
    b_bytes: list[bytes]
    a_len: np.ndarray
    b_len: np.ndarray
    a_space: np.ndarray
    b_space: np.ndarray
    shown: list[str]  # every A id before ',' and '|', then every B id before ',', ';' and a new line

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        return [self.a(" " + t) for t in texts]

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


#: How a byte-level tokenizer splits a text before it merges.
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """Byte-level characters: printable Latin-1 stands for itself, the other bytes for U+0100 and up, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _encoder(path: str, byte_of: dict[str, int]):
    """text -> ids of the byte-level tokenizer in a JSON file; no string is special.

    Where merges are numbered in their order, ids are ranks: a rank encoder gives the same ids in a fifth of the time.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    added = {t["content"] for t in spec["added_tokens"]}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    if (spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not spec["normalizer"] and [vocab.get(m) for m in merged] == [*range(256, 256 + len(merged))]
            and len(vocab) == 256 + len(merged) + len(added & set(vocab))):
        import tiktoken

        ranks = {bytes(byte_of[x] for x in t): i for t, i in vocab.items() if t not in added}
        return tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda text: t.encode(text, add_special_tokens=False).ids


@lru_cache(maxsize=2)
def coders(path_a: str, path_b: str) -> Coders:
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path_a).get_vocab(with_added_tokens=True)
    byte_of = _byte_of()
    a_bytes = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        a_bytes[i] = bytes(byte_of[x] for x in token) if all(x in byte_of for x in token) else token.encode()
    b = SentencePieceProcessor(model_file=path_b)
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()
               for i, p in ((i, b.id_to_piece(i)) for i in range(b.vocab_size()))]
    size = [np.array([len(x) for x in t], np.int64) for t in (a_bytes, b_bytes)]
    space = [np.array([x[:1] == b" " for x in t]) for t in (a_bytes, b_bytes)]
    shown = [f"{i}{end}" for i in range(len(a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(b_bytes)) for end in ",;\n"]
    return Coders(_encoder(path_a, byte_of), b, a_bytes, b_bytes, *size, *space, shown)


class Aligned(NamedTuple):
    """What windows align to, window by window."""
    texts: list[str]  # groups as a1,a2|b1;a3|b2
    groups: np.ndarray  # how many
    n_links: np.ndarray
    links: np.ndarray  # a * (number of B ids) + b of every link of the first window, the second, ..


def align_windows(windows: list[bytes], c: Coders) -> Aligned:
    """Groups and links of windows (A ids, BETWEEN, B ids; 32 bits each), all laid on one axis of bytes."""
    ids = np.frombuffer(b"".join(windows), np.uint32)
    w = np.repeat(np.arange(len(windows)), [len(x) // 4 for x in windows])
    between = ids == _BETWEEN
    second = np.cumsum(between) - w == 1
    of_a, of_b = ~second, second & ~between
    a, b = ids[of_a].astype(np.int64), ids[of_b].astype(np.int64)
    a_end, b_end = np.cumsum(c.a_len[a]), np.cumsum(c.b_len[b])
    a_start, b_start = a_end - c.a_len[a], b_end - c.b_len[b]
    # links: from the first B token that ends behind an A token's start to the last that starts before its end
    from_ = np.searchsorted(b_end, a_start, "right")
    each = np.searchsorted(b_start, a_end, "left") - from_
    upto = np.cumsum(each)
    j = np.arange(upto[-1]) - np.repeat(upto - each - from_, each)
    links = np.repeat(a, each) * len(c.b_bytes) + b[j]
    # groups: both end
    place = np.searchsorted(b_end, a_end)
    a_last = b_end[place] == a_end
    b_last = np.zeros(len(b), bool)
    b_last[place[a_last]] = True
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    a_passed, b_passed = np.cumsum(np.bincount(a_group)), np.cumsum(np.bincount(b_group))
    b_ends_window = np.r_[w[of_b][1:] != w[of_b][:-1], True]
    order = np.empty(len(a) + len(b), np.int64)  # A tokens of a group, then its B tokens
    order[np.arange(len(a)) + np.r_[0, b_passed][a_group]] = 2 * a + a_last
    order[np.arange(len(b)) + a_passed[b_group]] = 2 * len(c.a_bytes) + 3 * b + b_last + b_ends_window
    texts = "".join(map(c.shown.__getitem__, order.tolist())).split("\n")[:-1]
    n = len(windows)
    return Aligned(texts, np.bincount(w[of_a][a_last], minlength=n),
                   np.bincount(w[of_a], each, n).astype(np.int64), links)


class _Block(dict):
    """Numbers of a block's distinct windows, by their ids; each is aligned once, together with those new beside it."""

    def __init__(self, c: Coders):
        self.coders, self.new, self.size = c, [], 0
        self.texts: list[str] = []
        self.groups, self.n_links, self.links, self.seen = np.zeros(0, np.int64), np.zeros(0, np.int64), [], []

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        self.new.append(key)
        return number

    def numbers(self, windows: list[bytes]) -> np.ndarray:
        out = np.array(list(map(self.__getitem__, windows)), np.int64)
        self.seen.append(out)
        if self.new:
            found = align_windows(self.new, self.coders)
            self.texts += found.texts
            self.groups, self.n_links = np.r_[self.groups, found.groups], np.r_[self.n_links, found.n_links]
            self.links.append(found.links)
            self.new = []
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pairs, how often each is linked, the links of all windows as places among the pairs)."""
        pairs, links = np.unique(np.concatenate(self.links), return_inverse=True)
        often = np.bincount(np.concatenate(self.seen), minlength=len(self))
        return pairs, np.bincount(links, np.repeat(often, self.n_links), len(pairs)).astype(np.int64), links


def _windows(a: np.ndarray, b: np.ndarray, c: Coders) -> tuple[list[bytes], np.ndarray]:
    """The ids of each window of two id sequences over the same bytes, and how many A ids have passed at its end."""
    a_ends, b_ends = np.cumsum(c.a_len[a]), np.cumsum(c.b_len[b])
    place = np.searchsorted(b_ends, a_ends)
    both = np.flatnonzero(b_ends[place] == a_ends)
    i, j = both + 1, place[both] + 1  # the tokens after a shared end
    anchor = np.r_[c.a_space[a[i[:-1]]] & c.b_space[b[j[:-1]]], True]
    i, j = i[anchor], j[anchor]
    w = np.arange(len(i))
    n_a, n_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
    flat = np.full(len(a) + len(b) + len(w), _BETWEEN)  # A ids, BETWEEN, B ids of each window
    flat[np.arange(len(a)) + np.repeat(j - n_b + w, n_a)] = a
    flat[np.arange(len(b)) + np.repeat(i + w + 1, n_b)] = b
    raw, upto = flat.tobytes(), (4 * (i + j + w + 1)).tolist()
    return [raw[x:y] for x, y in zip([0, *upto], upto)], i


def _packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, and that width."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return x.astype(kind).tobytes() + bytes([kind.itemsize])


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[-1]}", (len(x) - 1) // x[-1])


_WORK = ("block long, kind int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
         "windows binary, pairs array<long>, times array<long>, links binary, n_of binary")
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("block",)] + [("kind", pa.int32())]
                    + [(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                    + [("groups_sha256", pa.string()), ("groups", pa.string()), ("windows", pa.binary()),
                       ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
                       ("links", pa.binary()), ("n_of", pa.binary())])
_TOLD_ROW, _BLOCK_ROW, _DOC_ROW = 0, 1, 2  # in this order within a block


def _list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _sums(x: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """Sums of x up to upto[0], from there to upto[1], .."""
    total = np.r_[0, np.cumsum(x)]
    return np.diff(total[upto], prepend=0)


def _encoded(docs: DataFrame, path_a: str, path_b: str, with_groups: bool) -> DataFrame:
    """A row per document with the numbers of its windows, and a row per block with the windows and pairs of all its documents."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coders(path_a, path_b)
        block, number = _Block(c), TaskContext.get().partitionId() << 32

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block, number
            if block:
                pairs, times, links = block.pairs()
                yield _batch(1, block=pa.array([number], pa.int64()), kind=pa.array([_BLOCK_ROW], pa.int32()), pairs=_list(pairs),
                             times=_list(times), links=pa.array([_packed(links)]), n_of=pa.array([_packed(block.n_links)]))
            block, number = _Block(c), number + 1

        for batch in it:
            at = utf8(batch.column(1))[1]
            for lo, hi in pieces(at):
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                some = [k for k, t in enumerate(texts) if t]
                chosen = [texts[k] for k in some]
                of: list = [([], [])] * len(texts)
                for k, t, a, b in zip(some, chosen, c.encode_a(chosen), c.encode_b(chosen) if some else []):
                    whole = b" " + t.encode()
                    if b"".join(map(c.a_bytes.__getitem__, a)) == whole == b"".join(map(c.b_bytes.__getitem__, b)):
                        of[k] = a, b
                n_a, n_b = (np.array([len(x[k]) for x in of], np.int64) for k in (0, 1))
                a, b = (np.fromiter(chain.from_iterable(x[k] for x in of), np.uint32, n.sum()) for k, n in ((0, n_a), (1, n_b)))
                keys, passed = _windows(a, b, c) if len(a) else ([], np.zeros(0, np.int64))
                numbers = block.numbers(keys)
                ends = np.searchsorted(passed, np.cumsum(n_a), "right")  # a document ends where a window does
                at_end = list(zip([0, *ends.tolist()], ends.tolist()))
                listed = numbers.tolist()
                shown = [";".join(map(block.texts.__getitem__, listed[x:y])) for x, y in at_end]
                yield _batch(
                    hi - lo, block=pa.array([number] * (hi - lo), pa.int64()), kind=pa.array([_DOC_ROW] * (hi - lo), pa.int32()),
                    doc_id=batch.column(0).slice(lo, hi - lo), n_a=pa.array(n_a), n_b=pa.array(n_b),
                    n_groups=pa.array(_sums(block.groups[numbers], ends)), n_links=pa.array(_sums(block.n_links[numbers], ends)),
                    groups_sha256=pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in shown]),
                    groups=pa.array(shown) if with_groups else pa.nulls(hi - lo, pa.string()),
                    windows=pa.array([_packed(numbers[x:y]) for x, y in at_end]))
                block.size += int(at[hi] - at[lo])
                if block.size >= BLOCK:
                    yield from done()
        yield from done()

    return docs.select("doc_id", "text").mapInArrow(batches, _WORK)


def _counted(work: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): links of each pair in the corpus, and whether its B id has none more often linked."""
    summed = saved(work.where(F.col("kind") == _BLOCK_ROW).select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
                   .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")))
    most = summed.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("most"))
    return summed.join(most, F.col("pair") % n_b == most["b"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """(a, b, n, best): how often each A id and B id are linked in all texts of ``docs``, and whether no A id is more often with b."""
    n_b = len(coders(path_a, path_b).b_bytes)
    return _counted(saved(_encoded(docs, path_a, path_b, False)), n_b).select(
        F.floor(F.col("pair") / n_b).cast("int").alias("a"), (F.col("pair") % n_b).cast("int").alias("b"), "n", "best")


def align(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, groups: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    A encodes a space and the text, B the text, to which it adds a space.
    Tokens are cut into groups where both end; tokens whose bytes overlap are
    linked. ``n_best``: links whose pair no other A id of that B id exceeds in
    the corpus; ``count_sum``: the corpus counts of all links. ``groups=True``
    adds the groups themselves as text. Null and empty texts, and those that
    one tokenizer does not give back byte for byte (B: with U+2581 in them),
    have no tokens: zeros, and an empty digest. Null ids pass through; repeated
    rows count each; other columns are not read; an empty table gives an empty table.
    """
    work = saved(_encoded(docs, path_a, path_b, groups))
    counted = _counted(work, len(coders(path_a, path_b).b_bytes))
    asked = work.where(F.col("kind") == _BLOCK_ROW).select("block", F.explode("pairs").alias("pair"))
    # in the order of the block's pairs; as many as a block has
    told = asked.join(counted, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pair", "n", "best"))).alias("x")).select(
        "block", F.lit(_TOLD_ROW).alias("kind"), F.col("x.n").alias("pairs"), F.col("x.best").alias("best"))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    rows = (work.drop("times").withColumn("pairs", F.lit(None).cast("array<long>")).unionByName(told, allowMissingColumns=True)
            .select("block", "kind", *own, "windows", "links", "n_of", "pairs", "best"))
    schema = pa.schema([_SCHEMA.field(n) for n in own] + [("n_best", pa.int64()), ("count_sum", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = best = counts = bests = None  # of a block's pairs; summed up for each of its windows
        for batch in it:
            kinds = batch.column("kind").to_pylist()
            windows, links, n_of, pairs, told_best = (batch.column(i) for i in ("windows", "links", "n_of", "pairs", "best"))
            best_sums, count_sums = [], []
            for k, kind in enumerate(kinds):
                if kind == _TOLD_ROW:
                    n, best = (x[k].values.to_numpy(zero_copy_only=False) for x in (pairs, told_best))
                elif kind == _BLOCK_ROW:
                    of, upto = _unpacked(links[k].as_py()), np.cumsum(_unpacked(n_of[k].as_py()), dtype=np.int64)
                    bests, counts = _sums(best[of], upto), _sums(n[of], upto)
                else:
                    w = _unpacked(windows[k].as_py())
                    best_sums.append(int(bests[w].sum()) if len(w) else 0)
                    count_sums.append(int(counts[w].sum()) if len(w) else 0)
            mine = batch.filter(pa.array([kind == _DOC_ROW for kind in kinds], pa.bool_()))
            yield pa.RecordBatch.from_arrays([mine.column(f) for f in own] + [pa.array(best_sums, pa.int64()),
                                                                             pa.array(count_sums, pa.int64())], schema=schema)

    out = rows.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(
        batches, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
                 "n_best long, count_sum long")
    return out if groups else out.drop("groups")
