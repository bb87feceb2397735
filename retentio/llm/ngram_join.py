"""N-gram Jaccard join: documents whose sets of word shingles are alike, and their components.

Sets of sizes s and t are linked when they share T = ceil(j (s + t) / (1 + j))
shingles. Equal sets are one class from the start; one of each class goes on.
A T-occurrence search (DivideSkip) merges the short inverted lists and only
probes the long ones:

1. Short lists. A partner misses at most s - ceil(j s) of a set's shingles, so it
   stands on the list of one of its s - ceil(j s) + 1 rarest. A fixed share of all
   shingles (by hash) comes first in that order, by true frequency, then the
   others, by hash. Most of a set's shingles are its own, and a set with enough
   lists of its own has no partner.
2. Candidates. Each list names a hub, and all others on it are its candidates: a
   group of copies costs a pair a member, not all pairs. What these links join is
   one component, its least class the label of all. On lists that still hold several
   labels, pairs across labels follow that pass the length and position bounds.
3. Blocks. Each set is sent once to a block, where it is searched for among the sets
   it is paired with: short lists are heap-merged; what can still reach T is probed
   in the long lists by bisection.

Nothing is capped: which shingles come first and who is a hub decide only the
order of work. Shingles and sets are known by 64- and 128-bit hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from retentio.llm.decontaminate import bloom
from retentio.llm.tables import components, saved, text_key, without
from retentio.llm.words import NOT_SPACE, U64, Words, pieces, shingles, utf8

SHINGLE = 4
PERCENT = 85
#: Share of all shingles, by hash, that comes first in the order (of 2 ** 32); a set with too few of them adds others.
FIRST = int(0.2 * (1 << 32))
#: A list longer than this counts as so long.
LONG_LIST = 1 << 16
#: Bits of a set's signature: as many as two signatures differ in, at least, so many shingles do their sets.
SIGN = 512
#: Pairs that are looked at together.
CHUNK = 1 << 17
#: Sets that meet at a time.
BLOCK = 256
#: Classes of a hub that are paired up in one place, with as many others.
PART = 8192
#: Shingles of a hub's sets that lie in one place, with as many others.
PART_SHINGLES = 1 << 22
#: Pairs that a task holds to tell repeated ones apart.
FOUND = 1 << 21
#: Classes that a task remembers, to send each one's shingles once.
REMEMBERED = 100_000
#: DivideSkip's weight of a probe against a merge step.
PROBE = 0.0085


def needed(size, percent: int):
    """Least overlap of a set of ``size`` with a partner: ceil(j * size)."""
    return (size * percent + 99) // 100


def overlap(s, t, percent: int):
    """T: least overlap of linked sets of sizes s and t."""
    return ((s + t) * percent + 99 + percent) // (100 + percent)


def lonely(size: int, percent: int) -> bool:
    """Whether a set of ``size`` can only be linked with an equal one."""
    return size * 100 // percent <= size and overlap(size, size, percent) >= size


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, id, key, n, cls, first_n, sign, grams): per row set size, 128-bit class, and the shingles to list.

    ``sign``: for each of SIGN bits the parity of the set's shingles that fall on it.

    ``grams``: the shingles that come first, and the least others where they
    are fewer than needed; none for a class that the task sent before.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()),
                        ("cls", pa.binary()), ("first_n", pa.int32()), ("sign", pa.list_(pa.int64())), ("grams", pa.list_(pa.int64()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in it:
            raw, at = utf8(batch.column(3))
            for lo, hi in pieces(at):
                w = Words(raw, at, lo, hi, NOT_SPACE)
                n, cls, first, signs, grams = [], [], [], [], []
                for s in shingles(w, k):
                    n.append(len(s))
                    c = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    cls.append(c)
                    upto = int(np.searchsorted(s, U64(FIRST) << U64(32)))
                    first.append(upto)
                    if c is None or c in sent or lonely(len(s), percent):
                        signs.append(None)
                        grams.append(s[:0].view(np.int64))
                        continue
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(c)
                    signs.append(_signature(s).tolist())
                    grams.append(s[:max(upto, len(s) - needed(len(s), percent) + 1)].view(np.int64))
                ends = np.cumsum([0] + [len(g) for g in grams])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(n, pa.int64()),
                     pa.array(cls, pa.binary()), pa.array(first, pa.int32()), pa.array(signs, pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(grams)))], schema=schema)

    return docs.select("doc_id", F.xxhash64("doc_id").alias("id"), text_key().alias("key"), "text").mapInArrow(
        batches, "doc_id long, id long, key binary, n long, cls binary, first_n int, sign array<long>, grams array<long>")


def _pairs_of(column: pa.Array) -> np.ndarray:
    """16-byte values as rows of two numbers."""
    _, offsets, data = column.buffers()
    start = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint8)[start:start + 16 * len(column)].view(np.uint64).reshape(-1, 2)


def _shared(postings: DataFrame) -> DataFrame:
    """``postings`` (gram, cls) whose gram has two classes or more, once each, with ``often``: how many classes.

    Rows stream by gram and class; only a list's rows are held, and those of
    one longer than LONG_LIST go on at once, as so long.
    """
    schema = pa.schema([("gram", pa.int64()), ("cls", pa.binary()), ("often", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, long_ = None, None  # rows of the last list; its gram, once it is too long

        def counted(t: pa.Table, often: np.ndarray | None) -> pa.RecordBatch:
            t = t.combine_chunks()
            gram = t["gram"].chunk(0).to_numpy()
            cls = _pairs_of(t["cls"].chunk(0))
            list_start = np.r_[True, gram[1:] != gram[:-1]]
            fresh = list_start | np.r_[True, (cls[1:] != cls[:-1]).any(1)]
            if often is None:
                which = np.cumsum(list_start) - 1
                often = np.bincount(which, fresh).astype(np.int32)[which]
            keep = pa.array(fresh & (often >= 2))
            return t.append_column("often", pa.array(often, pa.int32())).filter(keep).combine_chunks()

        def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from t.cast(schema).to_batches()

        for batch in it:
            t = pa.Table.from_batches([batch])
            if long_ is not None:
                same = int(np.searchsorted(batch.column(0).to_numpy(), long_, "right"))
                if same:
                    yield from out(counted(t.slice(0, same), np.full(same, LONG_LIST, np.int32)))
                if same == len(t):
                    continue
                t, long_ = t.slice(same), None
            if held is not None:
                t = pa.concat_tables([held, t])
            gram = t["gram"].to_numpy()
            last = int(np.searchsorted(gram, gram[-1], "left")) if len(gram) else 0
            if last:
                yield from out(counted(t.slice(0, last), None))
            held = t.slice(last)
            if len(held) > LONG_LIST:
                long_ = int(gram[-1])
                yield from out(counted(held, np.full(len(held), LONG_LIST, np.int32)))
                held = None
        if held is not None and len(held):
            yield from out(counted(held, None))

    return (postings.repartition("gram").sortWithinPartitions("gram", "cls").select("gram", "cls")
            .mapInArrow(batches, "gram long, cls binary, often int"))


def _prefixes(rows: DataFrame, percent: int) -> DataFrame:
    """(gram, cls, n, at): the rarest shingles of each class that others have too, ``at`` their place in its order."""
    listed = rows.where(F.size("grams") > 0)
    sizes = listed.select("cls", "n", "first_n").dropDuplicates(["cls"])
    # sizes grow with the classes: no broadcast, and the window below needs the same dealing
    shared = _shared(listed.select("cls", F.explode("grams").alias("gram"))).join(sizes.hint("merge"), "cls")
    other = F.shiftrightunsigned("gram", 32) >= F.lit(FIRST)
    own = W.partitionBy("cls")
    shared = shared.withColumn("other", other).withColumn(
        "r", F.row_number().over(own.orderBy("other", "often", "gram"))).withColumn(
        "shared_first", F.count(F.when(~F.col("other"), 1)).over(own))
    length = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    alone = F.col("first_n") - F.col("shared_first")  # shingles that no one else has come before all
    keep = F.col("other") | (F.col("r") <= F.least(length, F.col("first_n")) - alone)
    at = F.when(F.col("other"), F.col("first_n")).otherwise(alone + F.col("r") - 1)
    return shared.where(keep).select("gram", "cls", "n", at.cast("long").alias("at"))


def _hub_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """(hub, cls): each class on a list with the list's hub, its least class, where the bounds allow it."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram0, hub = None, None
        for batch in it:
            if not len(batch):
                continue
            gram, n, at = (batch.column(i).to_numpy() for i in (0, 2, 3))
            start = np.r_[gram[0] != gram0, gram[1:] != gram[:-1]]
            # the hub of each row: the first row of its list, in this batch or held from before
            which = np.maximum.accumulate(np.where(start, np.arange(len(gram)), -1))
            cls = batch.column(1)
            hub_n = np.where(which >= 0, n[which], hub[1] if hub else 0)
            hub_at = np.where(which >= 0, at[which], hub[2] if hub else 0)
            ok = ((which != np.arange(len(gram))) & (np.minimum(n, hub_n) * 100 >= np.maximum(n, hub_n) * percent)
                  & (np.minimum(n - at, hub_n - hub_at) >= overlap(n, hub_n, percent)))
            rows = np.flatnonzero(ok)
            held = which[rows] < 0
            hubs = cls.take(pa.array(np.maximum(which[rows], 0)))
            if held.any():
                hubs = pa.array([hub[0] if h else x.as_py() for h, x in zip(held, hubs)], pa.binary())
            yield pa.RecordBatch.from_arrays([hubs, cls.take(pa.array(rows))], ["hub", "cls"])
            gram0 = gram[-1]
            if which[-1] >= 0:
                hub = (cls[int(which[-1])].as_py(), int(n[which[-1]]), int(at[which[-1]]))

    return (prefixes.repartition("gram").sortWithinPartitions("gram", "cls").select("gram", "cls", "n", "at")
            .mapInArrow(batches, "hub binary, cls binary").where("hub <> cls").distinct())


def _dealt(rows: DataFrame, signs: DataFrame) -> DataFrame:
    """Lists with several labels, each row once for every part that its list meets: (hub, p, q) is worked through in one place.

    The classes of a hub (the least class of each of its lists) fall into parts of about PART
    classes and PART_SHINGLES shingles, the same on all its lists, so a pair of classes has its
    place, and a place has two parts at most.
    """
    # lists of two have met already
    lists = rows.groupBy("gram").agg(F.count("*").alias("k"), F.min("cls").alias("hub"), F.min("label").alias("l1"),
                                     F.max("label").alias("l2")).where("k > 2 and l1 <> l2").select("gram", "hub")
    listed = rows.join(lists, "gram")
    # the number of parts decides the order of work alone: an estimate will do
    crowded = (listed.groupBy("hub").agg(F.approx_count_distinct("cls").alias("k"), F.avg("n").alias("mean"))
               .select("hub", F.ceil(F.greatest(F.col("k") / PART, F.col("k") * F.col("mean") / PART_SHINGLES)).alias("k"))
               .where("k > 1"))
    parts = F.coalesce("k", F.lit(1).cast("long"))
    placed = listed.join(crowded, "hub", "left").withColumn("own", F.pmod(F.xxhash64("cls"), parts)).drop("k")
    meets = (placed.join(crowded.select("hub"), "hub", "left_semi").groupBy("gram")
             .agg(F.collect_set("own").alias("others")))
    return (placed.join(meets, "gram", "left").join(signs, "cls")
            .withColumn("other", F.explode(F.coalesce("others", F.array("own"))))
            .select("hub", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "gram", "own",
                    "label", "cls", "n", "at", "sign"))


def _whole_lists(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows (hub, p, q, gram, ..) that come in this order, a batch or so at a time, no list cut; without a gram they pass at once."""
    held = None
    for batch in it:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        at = _starts(t)
        last = len(t) if t["gram"][len(t) - 1].as_py() is None else int(at[-1])
        held = t.slice(last) if last < len(t) else None
        if last:
            yield t.slice(0, last)
    if held is not None:
        yield held


def _starts(t: pa.Table, *columns: str) -> np.ndarray:
    """Rows that begin another (hub, p, q) and ``columns`` (the gram, if none is named)."""
    hub = _pairs_of(t["hub"].combine_chunks())
    fresh = np.r_[True, (hub[1:] != hub[:-1]).any(1)]
    for c in ("p", "q", *(columns or ("gram",))):
        x = t[c].combine_chunks().fill_null(0).to_numpy()
        fresh[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(fresh)


def _across(t: pa.Table, signs: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of rows of one list in ``t``, whole lists, that may be linked: CHUNK at a time.

    Pairs of one label are joined already, those with the list's hub have met; where two parts
    meet, pairs within one arise elsewhere. Bounds: size, place on the list, and signatures
    (linked sets differ in n1 + n2 - 2 T shingles at most).
    """
    n, at, own, label = (t[c].combine_chunks().to_numpy() for c in ("n", "at", "own", "label"))
    cls, hub = _pairs_of(t["cls"].combine_chunks()), _pairs_of(t["hub"].combine_chunks())
    is_hub, apart = (cls == hub).all(1), t["p"].combine_chunks().to_numpy() != t["q"].combine_chunks().to_numpy()
    begin = np.zeros(len(t), np.int64)
    begin[_starts(t)] = 1
    lists = np.cumsum(begin)
    order = np.lexsort((label, lists))
    n, at, own, label, lists, is_hub, apart = (v[order] for v in (n, at, own, label, lists, is_hub, apart))
    bits = signs.view(U64)[order]

    def ends(fresh: np.ndarray) -> np.ndarray:
        """For each row the first one of the next run."""
        cut = np.r_[np.flatnonzero(fresh), len(fresh)]
        return np.repeat(cut[1:], np.diff(cut))

    other_list = np.r_[True, lists[1:] != lists[:-1]]
    upto = ends(other_list | np.r_[True, label[1:] != label[:-1]])  # where other labels begin
    todo = ends(other_list) - upto
    todo[is_hub] = 0
    before = np.r_[0, np.cumsum(todo)]
    lo = 0
    while lo < len(todo):
        hi = max(lo + 1, int(np.searchsorted(before, before[lo] + CHUNK, "right")) - 1)
        k = todo[lo:hi]
        x = np.repeat(np.arange(lo, hi), k)
        y = np.arange(len(x)) - np.repeat(before[lo:hi] - before[lo], k) + np.repeat(upto[lo:hi], k)
        least = overlap(n[x], n[y], percent)
        ok = ((np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent)
              & (np.minimum(n[x] - at[x], n[y] - at[y]) >= least) & ~is_hub[y] & (~apart[x] | (own[x] != own[y])))
        x, y, least = x[ok], y[ok], least[ok]
        differ = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64)
        near = differ <= n[x] + n[y] - 2 * least
        yield order[x[near]], order[y[near]]
        lo = hi


def _signature(s: np.ndarray) -> np.ndarray:
    return np.packbits(np.bincount((s >> U64(3)) % U64(SIGN), minlength=SIGN) & 1).view(np.int64)


def _open_rows(prefixes: DataFrame, labels: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """(hub, p, q, gram, own, label, cls, n, at): rows of lists that have a possible partner of another label there.

    Never more rows than the dealt lists have: pairs are looked at and dropped where they arise.
    """
    rows = saved(prefixes.join(labels, "cls", "left").select(
        "gram", "cls", "n", "at", F.xxhash64(F.coalesce("label", "cls")).alias("label")))
    names = ["hub", "p", "q", "gram", "own", "label", "cls", "n", "at"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_lists(it):
            paired = np.zeros(len(t), bool)
            bits = t["sign"].combine_chunks().flatten().to_numpy().reshape(-1, SIGN // 64)
            for x, y in _across(t, bits, percent):
                paired[x] = paired[y] = True
            yield from t.select(names).filter(pa.array(paired)).combine_chunks().to_batches()

    return (_dealt(rows, signs).repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q", "gram")
            .select(*names, "sign").mapInArrow(
        batches, "hub binary, p long, q long, gram long, own long, label long, cls binary, n long, at long"))


class _Place:
    """The sets and lists of one (hub, p, q): what its links join, beyond what labels join, is its spanning forest."""

    def __init__(self, key: tuple, percent: int):
        self.key, self.percent = key, percent
        self.code: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.sets: list[np.ndarray] = []
        self.signs: list[np.ndarray] = []
        self.above: list[int] = []
        self.of_label: dict[int, int] = {}
        self.found: list[np.ndarray] = []
        self.size = 0

    def put(self, cls: bytes, grams: np.ndarray) -> None:
        self.code[cls] = len(self.names)
        self.names.append(cls)
        self.sets.append(grams)
        self.signs.append(_signature(grams))
        self.above.append(len(self.above))

    def top(self, x: int) -> int:
        while self.above[x] != x:
            self.above[x] = x = self.above[self.above[x]]
        return x

    def meet(self, t: pa.Table) -> Iterator[tuple[bytes, bytes]]:
        """Hold the pairs of lists; yields links found so far, if there are many."""
        codes = np.array([self.code[c] for c in t["cls"].to_pylist()], np.int64)
        for c, label in set(zip(codes.tolist(), t["label"].to_pylist())):
            self.above[self.top(c)] = self.top(self.of_label.setdefault(label, c))
        for x, y in _across(t, np.stack(self.signs)[codes], self.percent):
            c1, c2 = codes[x], codes[y]
            self.found.append(np.unique(np.minimum(c1, c2) << 32 | np.maximum(c1, c2)))
            self.size += len(self.found[-1])
            if self.size > FOUND:
                self.found = [np.unique(np.concatenate(self.found))]
                self.size = len(self.found[0])
                if self.size > FOUND // 2:  # a pair that comes again is joined, or tried again
                    yield from self.links()

    def links(self) -> Iterator[tuple[bytes, bytes]]:
        if not self.found:
            return
        every = np.unique(np.concatenate(self.found))
        self.found, self.size = [], 0
        one, two = every >> 32, every & 0xFFFFFFFF
        cut = np.flatnonzero(np.r_[True, one[1:] != one[:-1], True]) if len(one) else np.zeros(1, int)
        for lo, hi in zip(cut[:-1], cut[1:]):
            query = int(one[lo])
            others = two[lo:hi].tolist()
            for i in range(0, len(others), BLOCK):
                mine = self.top(query)
                todo = [c for c in others[i:i + BLOCK] if self.top(c) != mine]
                q, against = self.sets[query], [self.sets[c] for c in todo]
                for w in divide_skip(q, against, [overlap(len(q), len(s), self.percent) for s in against]):
                    mine, other = self.top(query), self.top(todo[w])
                    if mine != other:
                        self.above[other] = mine
                        yield self.names[query], self.names[todo[w]]


def _cross_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between classes of different labels, a spanning forest a place. ``rows`` as of _open_rows.

    A set is sent once to each (hub, p, q) that it has a possible partner in, and pairs are
    verified there where they arise: pairs never become rows. A place holds the sets of two
    parts, about PART_SHINGLES each.
    """
    none = F.lit(None)
    needs = rows.select("hub", "p", "q", "cls").distinct()
    # what meets grows with the data on both sides: dealt by class at every size
    given = needs.join(sets.hint("merge"), "cls").select(
        "hub", "p", "q", none.cast("long").alias("gram"), none.cast("long").alias("own"), none.cast("long").alias("label"),
        "cls", none.cast("long").alias("n"), none.cast("long").alias("at"), "grams")
    every = rows.withColumn("grams", none.cast("binary")).unionByName(given)
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, out = None, []

        def told() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], schema=schema)
            out.clear()
            return batch

        for t in _whole_lists(it):
            cut = np.r_[_starts(t, "p"), len(t)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                mine = t.slice(lo, hi - lo)
                key = tuple(mine[c][0].as_py() for c in ("hub", "p", "q"))
                if place is None or key != place.key:
                    if place is not None:
                        out.extend(place.links())
                    place = _Place(key, percent)
                n_sets = mine["gram"].null_count
                for cls, grams in zip(mine["cls"].slice(0, n_sets).to_pylist(), mine["grams"].slice(0, n_sets).to_pylist()):
                    if cls not in place.code:  # two tasks may send one set
                        place.put(cls, np.frombuffer(grams, U64))
                if n_sets < len(mine):
                    out.extend(place.meet(mine.slice(n_sets)))
            if len(out) >= 1 << 12:
                yield told()
        if place is not None:
            out.extend(place.links())
        yield told()

    # sets (without a gram) come before the lists of their place
    return (every.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q", F.col("gram").asc_nulls_first())
            .select("hub", "p", "q", "gram", "own", "label", "cls", "n", "at", "grams")
            .mapInArrow(batches, "a binary, b binary"))


def _near(pairs: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (hub, cls) that their signatures allow."""
    one = signs.select(F.col("cls").alias("hub"), F.col("n").alias("n1"), F.col("sign").alias("s1"))
    two = signs.select("cls", F.col("n").alias("n2"), F.col("sign").alias("s2"))
    apart = F.aggregate(F.zip_with("s1", "s2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    both = F.col("n1") + F.col("n2")
    t = F.floor((both * percent + 99 + percent) / (100 + percent))
    return pairs.join(one, "hub").join(two, "cls").where(apart <= both - 2 * t).select("hub", "cls")


def divide_skip(query: np.ndarray, sets: list[np.ndarray], least: list[int]) -> list[int]:
    """Which of ``sets`` share at least ``least`` shingles with ``query`` (all sorted, distinct).

    Lists: for each shingle of the query, the sets that hold it. The longest
    ones are set aside; a set that reaches its T must be on T less their number
    of the short ones, which are merged by a heap. Those that are get probed in
    the long lists by bisection.
    """
    if not sets:
        return []
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    every = np.concatenate(sets)
    place = np.minimum(np.searchsorted(query, every), len(query) - 1)
    hit = query[place] == every
    place, owner = place[hit], owner[hit]
    order = np.argsort(place, kind="stable")  # by shingle, sets in order
    place, owner = place[order], owner[order]
    length = np.bincount(place, minlength=len(query))
    start = np.r_[0, np.cumsum(length)]
    t = min(least)
    n_long = min(t - 1, len(query), int(t / (PROBE * math.log2(max(2, int(length.max()))) + 1)))
    by_length = np.argsort(length, kind="stable")
    short, long_ = by_length[:len(query) - n_long], by_length[len(query) - n_long:]
    merged = heapq.merge(*[owner[start[i]:start[i + 1]].tolist() for i in short if length[i]])
    count = {s: sum(1 for _ in g) for s, g in groupby(merged)}
    open_ = np.array([s for s, c in count.items() if c >= least[s] - n_long], np.int64)
    if n_long and len(open_):
        # one bisection for all long lists: an entry is (list, set)
        keys = np.concatenate([i * len(sets) + owner[start[q]:start[q + 1]] for i, q in enumerate(long_)])
        wanted = (np.arange(n_long)[:, None] * len(sets) + open_).ravel()
        found = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
        probed = (keys[found] == wanted).reshape(n_long, -1).sum(0) if len(keys) else np.zeros(len(open_), int)
    else:
        probed = np.zeros(len(open_), int)
    return [int(s) for s, p in zip(open_, probed) if count[int(s)] + p >= least[s]]


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the ``pairs`` (hub, a, b) whose sets are linked. ``sets``: (cls, grams as bytes).

    Pairs of one hub are blocks: its classes fall into parts of about BLOCK, and each
    pair of parts with the sets that it needs, each sent once, is worked through by itself;
    what its links have joined is not tried again.
    """
    members = pairs.select("hub", F.col("a").alias("cls")).union(pairs.select("hub", F.col("b").alias("cls"))).distinct()
    crowded = members.groupBy("hub").agg(F.count("*").alias("k")).where(F.col("k") > 2 * BLOCK)
    parts = F.coalesce(F.ceil(F.col("k") / BLOCK), F.lit(1).cast("long"))
    dealt = pairs.join(crowded, "hub", "left").withColumn("parts", parts).select(
        "hub", F.pmod(F.xxhash64("a"), "parts").alias("p"), F.pmod(F.xxhash64("b"), "parts").alias("q"), "a", "b")
    dealt = saved(dealt)
    needs = dealt.select("hub", "p", "q", F.col("a").alias("cls")).union(
        dealt.select("hub", "p", "q", F.col("b").alias("cls"))).distinct()
    none = F.lit(None).cast("binary")
    # what meets grows with the data on both sides: dealt by class at every size
    rows = needs.join(sets.hint("merge"), "cls").select("hub", "p", "q", F.lit(0).alias("kind"), F.col("cls").alias("a"), none.alias("b"), "grams")
    rows = rows.unionByName(dealt.select("hub", "p", "q", F.lit(1).alias("kind"), "a", "b", none.alias("grams")))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, have, query, names, above = None, {}, None, [], {}

        def top(x: bytes) -> bytes:
            while x in above:
                above[x] = x = above.get(above[x], above[x])
            return x

        def solved() -> pa.RecordBatch:
            mine = top(query)
            todo = [x for x in names if top(x) != mine]
            q, against = have[query], [have[x] for x in todo]
            won = []
            for i in divide_skip(q, against, [overlap(len(q), len(x), percent) for x in against]):
                mine, other = top(query), top(todo[i])
                if mine != other:
                    above[other] = mine
                    won.append(todo[i])
            return pa.RecordBatch.from_arrays([pa.array([query] * len(won), pa.binary()), pa.array(won, pa.binary())], ["a", "b"])

        for batch in it:
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(6))))
            for i, (h, p, q, kind, one, two) in enumerate(ids):
                if (h, p, q) != key:
                    if names:
                        yield solved()
                    key, have, query, names, above = (h, p, q), {}, None, [], {}
                if kind == 0:
                    have[one] = np.frombuffer(batch.column(6)[i].as_buffer().to_pybytes(), U64)
                    continue
                if names and (one != query or len(names) == BLOCK):
                    yield solved()
                    names = []
                query = one
                names.append(two)
        if names:
            yield solved()

    return (rows.repartition("hub", "p", "q").sortWithinPartitions("hub", "p", "q", "kind", "a")
            .select("hub", "p", "q", "kind", "a", "b", "grams").mapInArrow(batches, "a binary, b binary"))


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, grams): the whole sets of the ``wanted`` classes, from one document each."""
    chosen = saved(classes.join(wanted.hint("merge"), "cls").groupBy("cls").agg(F.min("id").alias("id"))
                   .select("id", F.conv(F.hex(F.substring("cls", 1, 8)), 16, -10).cast("long").alias("name")))
    context = docs.sparkSession.sparkContext
    ids, names = (context.broadcast(bloom(chosen.select(F.col(c).alias("id")), "id")[0]) for c in ("id", "name"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in it:
            batch = batch.filter(pa.array(ids.value.has(batch.column(0).to_numpy().view(U64))))
            raw, at = utf8(batch.column(1))
            for lo, hi in pieces(at):
                found = []
                for s in shingles(Words(raw, at, lo, hi, NOT_SPACE), k):
                    c = hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                    # repeated rows of an id send their set once a task
                    if c is None or c in sent or not names.value.has(np.frombuffer(c[:8], ">u8").astype(U64))[0]:
                        continue
                    if len(sent) >= REMEMBERED:
                        sent.clear()
                    sent.add(c)
                    found.append((c, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["cls", "grams"])

    # what the filter of ids lets through beside the chosen is dropped by the filter of classes; both are bounded
    every = docs.select(F.xxhash64("doc_id").alias("id"), "text").mapInArrow(batches, "cls binary, grams binary")
    return saved(every)


def _classes_of(pairs: DataFrame, *columns: str) -> DataFrame:
    out = pairs.select(F.col(columns[0]).alias("cls"))
    for c in columns[1:]:
        out = out.union(pairs.select(c))
    return saved(out.distinct())


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows (doc_id, id, n, cls), class components (cls, component)); classes without links are not among the latter."""
    rows = saved(_classes(docs, k, percent))
    prefixes = saved(_prefixes(rows, percent))
    pairs = saved(_hub_pairs(prefixes, percent))
    signs = saved(rows.where("sign is not null").select("cls", "n", "sign").dropDuplicates(["cls"]))
    near = saved(_near(pairs, signs, percent))
    sets = _sets(docs, rows.select("cls", "id"), _classes_of(near, "hub", "cls"), k)
    links = saved(_links(near.select("hub", F.col("hub").alias("a"), F.col("cls").alias("b")), sets, percent))
    # what hub links join needs no pairs of its own
    labels = saved(components(links).select(F.col("node").alias("cls"), F.col("component").alias("label")))
    rest = saved(_open_rows(prefixes, labels, signs.select("cls", "sign"), percent))
    if rest.head(1):
        sets = _sets(docs, rows.select("cls", "id"), _classes_of(rest, "cls"), k)
        links = saved(links.unionByName(_cross_links(rest, sets, percent)))
    return rows, components(links).select(F.col("node").alias("cls"), "component")


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``component_id``: the smallest doc_id reachable by links (100 * common >=
    ``percent`` * all shingles), itself included. Null and empty texts have no
    shingles and no links; texts of fewer than ``shingle`` words are one
    shingle; rows with a null id link as others but are not smallest; repeated
    rows are linked; other columns are not read; an empty table gives an empty
    table.
    """
    rows, found = _joined(docs, shingle, percent)
    whole = rows.select("doc_id", "n", "cls").join(found, "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    smallest = whole.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return (whole.where("component is not null").join(smallest, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
        .unionByName(whole.where("component is null").select("doc_id", F.col("n").alias("n_shingles"),
                                                             F.col("doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that are linked to one that stays: of each component the smallest doc_id (then text) stays.

    Rows without shingles all stay. Repeated rows are linked: one stays.
    """
    rows, found = _joined(docs, shingle, percent)
    whole = saved(rows.where("cls is not null").join(found, "cls", "left").select(
        "doc_id", "key", F.coalesce("component", "cls").alias("component")))
    first = whole.groupBy("component").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    rejected = whole.join(first, "component").where(~F.struct("doc_id", "key").eqNullSafe(F.col("first")))
    left = without(docs, saved(rejected.select("doc_id", "key")))
    repeated = saved(whole.groupBy("doc_id", "key").agg(F.count("*").alias("k")).where("k > 1").select("doc_id", "key"))
    if not repeated.head(1):
        return left
    again = repeated.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"))
    keyed = left.withColumn("__key", text_key())
    some = keyed.join(again, keyed["doc_id"].eqNullSafe(again["__id"]) & (keyed["__key"] == again["__k"]), "left_semi")
    return without(left, repeated).unionByName(some.dropDuplicates(["doc_id", "__key"]).drop("__key"))
