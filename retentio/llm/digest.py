"""Document fingerprints: improbable byte windows in chained Bloom filters.

Every window of 32 bytes has a Shannon entropy; how often that level occurs
over all documents tells how improbable the window is. In each neighbourhood
the rarest window wins, and windows that win often enough are the features.
Their hashes go into Bloom filters, a new one after so many. Every text, long
or short, also has small features: of its windows of 8 bytes those whose hash
starts with enough zero bits that about as many remain at any length, in one
filter for each number of zeros, so that texts of different lengths meet in the
filters that both have. Two fingerprints are as alike as their filters' common
bits beyond what chance would give, weighed by the bytes the features cover.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.words import U64, mix, pieces, utf8

WINDOW = 32
#: A window competes with its neighbours in so many places, and must win so many of them.
NEIGHBOURS = 32
WINS = 12
#: Bytes of a small window, how many small features a text keeps at most (about), and their filters.
SMALL = 8
SMALL_FEATURES = 128
SMALL_FILTERS = 4
LEVELS = 256
FILTER_BITS = 2048
BITS_PER_FEATURE = 5
FEATURES_PER_FILTER = 128
#: Common bits, as a share of what is possible beyond chance, that do not count yet.
CUTOFF = 0.1
#: Bytes worked through at a time.
STRETCH = 1 << 20

# n log2 n in whole steps, so that sums are exact and a window has one level wherever it stands
_STEP = 1 << 16
_NLOGN = np.array([round(n * np.log2(n) * _STEP) if n else 0 for n in range(WINDOW + 1)], np.int64)
_MOST = int(_NLOGN[WINDOW])


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 .. LEVELS - 1) of each window of ``data``.

    From one window to the next a byte leaves and another enters. How many of
    each are in the window follows from places in the list of equal bytes, so
    the changes of sum(n log2 n) are taken at once and summed up.
    """
    size = len(data)
    n = size - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint8)
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (size + WINDOW) + order
    here = np.arange(size)
    # in the list of equal bytes: how many up to the end of the window that starts here,
    ahead = np.searchsorted(key, key + WINDOW) - here
    # and, as each is ahead of so many, how many from the start of the window that ends here
    back = here + 1 - np.cumsum(np.bincount(here + ahead, minlength=size + 1))[:size]
    change = np.empty(size, np.int64)
    change[order] = _NLOGN[ahead - 1] - _NLOGN[ahead]
    gone = change[:n - 1].copy()
    change[order] = _NLOGN[back] - _NLOGN[back - 1]
    total = np.empty(n, np.int64)
    total[0] = _NLOGN[np.bincount(data[:WINDOW], minlength=256)].sum()
    np.cumsum(gone + change[WINDOW:WINDOW + n - 1], out=total[1:])
    total[1:] += total[0]
    return ((_MOST - total) * (LEVELS - 1) // _MOST).astype(np.uint8)


def stretches(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Windows a .. b of a long text at a time."""
    n = max(0, len(data) - WINDOW + 1)
    for a in range(0, n, STRETCH):
        yield a, min(n, a + STRETCH)


def all_levels(data: np.ndarray) -> np.ndarray:
    parts = [levels(data[a:b + WINDOW - 1]) for a, b in stretches(data)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)


def fit_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level by how many windows of all texts of ``docs`` have it: 0 is the rarest.

    Level 0 (one byte repeated) says nothing and gets the highest rank. One
    number a level comes back.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, np.int64)
        for batch in it:
            raw, at = utf8(batch.column(0))
            for lo, hi in pieces(at):
                data = raw[at[lo]:at[hi]]
                lengths = np.diff(at[lo:hi + 1])
                row = np.repeat(np.arange(hi - lo), lengths)
                for a, b in stretches(data):
                    inside = row[a:b] == row[a + WINDOW - 1:b + WINDOW - 1]  # windows do not cross texts
                    total += np.bincount(levels(data[a:b + WINDOW - 1])[inside], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS), pa.int32()), pa.array(total)], ["level", "n"])

    counts = docs.select("text").mapInArrow(batches, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    often = np.zeros(LEVELS, np.int64)
    for r in counts.collect():
        often[r.level] = r.n
    often[0] = np.iinfo(np.int64).max
    ranks = np.empty(LEVELS, np.uint8)
    ranks[np.lexsort((np.arange(LEVELS), often))] = np.arange(LEVELS)
    return ranks


def features(ranks: np.ndarray) -> np.ndarray:
    """Places of the windows that win: lowest rank, leftmost, in WINS of the NEIGHBOURS spans they are in."""
    n = len(ranks)
    if n < NEIGHBOURS:
        return np.flatnonzero(ranks == ranks.min())[:1] if n else np.empty(0, np.int64)
    # rank and place in one number, so that the least is the leftmost rarest
    key = ranks.astype(np.int64) << 40 | np.arange(n)
    span, least = 1, key
    while span < NEIGHBOURS:
        step = min(span, NEIGHBOURS - span)
        least = np.minimum(least[:len(least) - step], least[step:])
        span += step
    winner = least & ((1 << 40) - 1)
    edge = np.flatnonzero(np.r_[True, winner[1:] != winner[:-1]])
    won = winner[edge][np.diff(np.r_[edge, len(winner)]) >= WINS]
    return won if len(won) else winner[edge[np.argmax(np.diff(np.r_[edge, len(winner)]))]][None]


def _lanes(data: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """64-bit hashes of the windows of ``data`` that start at ``at``; ``window`` is a multiple of 8."""
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    out = np.full(len(at), 0x243F6A8885A308D3, U64)
    for a in range(0, len(at), 1 << 16):
        lanes = np.ascontiguousarray(views[at[a:a + (1 << 16)]]).view(U64)
        for k in range(lanes.shape[1]):
            out[a:a + (1 << 16)] = mix(out[a:a + (1 << 16)] * U64(0x9E3779B97F4A7C15) + lanes[:, k])
    return out


class Print(NamedTuple):
    """A fingerprint: ``small`` filters of hashes with ``zeros``, ``zeros`` + 1, .. leading zero bits (the last: or more); ``wide`` chain."""

    zeros: int
    small: np.ndarray
    wide: np.ndarray


def _filled(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """``n`` filters (rows of FILTER_BITS / 8 bytes), each hash in that of its number ``at``."""
    filters = np.zeros((n, FILTER_BITS), bool)
    bits = FILTER_BITS.bit_length() - 1
    for k in range(BITS_PER_FEATURE):
        filters[at, ((hashes >> U64(bits * k)) & U64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(filters, axis=1)


def _small(data: np.ndarray) -> tuple[int, np.ndarray]:
    """Small filters; a text of fewer than SMALL bytes is one feature as a whole."""
    n = len(data) - SMALL + 1
    zeros = max(0, (-(-n // SMALL_FEATURES) - 1).bit_length())
    if n > 0:
        found = []
        for a in range(0, n, STRETCH):
            part = data[a:min(n, a + STRETCH) + SMALL - 1]
            hashes = _lanes(part, np.arange(len(part) - SMALL + 1), SMALL)
            found.append(hashes[hashes <= U64((1 << (64 - zeros)) - 1)])
        hashes = np.unique(np.concatenate(found))
    else:
        hashes = np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), U64) >> U64(1) | U64(1 << 63)
    row = np.zeros(len(hashes), np.int64)
    for k in range(1, SMALL_FILTERS):
        row += hashes < U64(1 << (64 - zeros - k))
    return zeros, _filled(mix(hashes), row, SMALL_FILTERS)  # zeros in front would show in a filter's bits


def fingerprint(data: np.ndarray, ranks: np.ndarray) -> Print:
    """Filters of a text whose windows have ``ranks``; an empty text has none."""
    none = np.zeros((0, FILTER_BITS // 8), np.uint8)
    if not len(data):
        return Print(0, none, none)
    zeros, small = _small(data)
    if not len(ranks):
        return Print(zeros, small, none)
    hashes = _lanes(data, features(ranks))
    # windows of equal bytes count once
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    return Print(zeros, small, _filled(hashes, np.arange(len(hashes)) // FEATURES_PER_FILTER, -(-len(hashes) // FEATURES_PER_FILTER)))


def _excess(na: np.ndarray, nb: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common bits beyond chance and cutoff, and the most there could be, of filters with ``na`` and ``nb`` bits."""
    chance = na * nb / FILTER_BITS
    most = np.minimum(na, nb)
    chance = chance + CUTOFF * (most - chance)
    return common - chance, most - chance


def _wide_likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """For each filter of the shorter chain the best of the other, on average; and the bits of the shorter chain."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0, 0.0
    wa = np.unpackbits(a, axis=1).astype(np.float32)
    weight = wa.sum(1)
    best = np.zeros(len(a))
    for lo in range(0, len(b), 64):
        wb = np.unpackbits(b[lo:lo + 64], axis=1).astype(np.float32)
        nb = wb.sum(1)
        for x in range(0, len(a), 1024):
            over, most = _excess(weight[x:x + 1024, None], nb[None, :], wa[x:x + 1024] @ wb.T)
            score = np.where(most > 0, over / np.maximum(most, 1e-9), 0.0)
            best[x:x + 1024] = np.maximum(best[x:x + 1024], score.clip(0, 1).max(1))
    return float((best * weight).sum() / weight.sum()), float(weight.sum())


def _small_likeness(a: Print, b: Print) -> tuple[float, float]:
    """Over the numbers of zeros that both keep; and the bits there that the two could share."""
    if a.zeros > b.zeros:
        a, b = b, a
    skip = b.zeros - a.zeros
    if skip >= SMALL_FILTERS or not len(a.small) or not len(b.small):
        return 0.0, 0.0
    n = SMALL_FILTERS - skip
    mine = np.unpackbits(a.small[skip:], axis=1)
    theirs = np.unpackbits(b.small, axis=1)
    theirs = np.concatenate([theirs[:n - 1], theirs[n - 1:].max(0, keepdims=True)])  # "or more" from the same number
    na, nb = mine.sum(1, dtype=np.int64), theirs.sum(1, dtype=np.int64)
    over, most = _excess(na, nb, (mine & theirs).sum(1, dtype=np.int64))
    if most.sum() <= 0:
        return 0.0, 0.0
    return float(min(1.0, max(0.0, over.sum() / most.sum()))), float(np.minimum(na, nb).sum())


def likeness(a: Print, b: Print) -> float:
    """0 .. 1: common bits beyond chance, as a share of what such filters can share beyond chance.

    The wide chains' and the small filters' likeness, each weighed by bits of
    the shorter one times bytes of a window. Two empty fingerprints are alike;
    an empty and another are not.
    """
    if packed(a) == packed(b):
        return 1.0
    if not len(a.small) or not len(b.small):
        return 0.0
    (wide, w), (small, s) = _wide_likeness(a.wide, b.wide), _small_likeness(a, b)
    w, s = w * WINDOW, s * SMALL
    return (wide * w + small * s) / (w + s) if w + s else 0.0


def packed(p: Print) -> str:
    """Base64 of a byte (zeros), the small filters and the wide ones; nothing of an empty text."""
    return base64.b64encode(bytes([p.zeros]) + p.small.tobytes() + p.wide.tobytes()).decode() if len(p.small) else ""


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, ahead): the rows in buckets of consecutive ids, with the first row of the next (ahead).

    Buckets are cut at approximate quantiles of the id, a few for each shuffle
    partition; rows of equal id go by a digest of their text. Every text
    travels once, and one more row a bucket. The last bucket is followed by
    the first row of all. A null id comes before all others.
    """
    spark = docs.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"),
                       F.xxhash64("text").alias("spread"))
    found = rows.agg(F.percentile_approx("place", [i / n for i in range(1, n)], 10 * n)).first()[0]
    cuts = sorted(set(found or []))

    def at(values: list[int], index: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast("array<long>"), index)

    # how many cuts are not above the place, by halving
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    bucket = F.aggregate(steps, F.lit(0), lambda have, step: have + F.when(
        (have + step <= len(cuts)) & (at(cuts, F.least(have + step, F.lit(len(cuts)))) <= F.col("place")), step)
        .otherwise(0)) if cuts else F.lit(0)
    rows = rows.withColumn("bucket", bucket)
    # a row a bucket
    heads = sorted((r.bucket, r.head.place, r.head.spread) for r in rows.groupBy("bucket").agg(
        F.min(F.struct("place", "spread")).alias("head")).collect())
    before = {b: heads[i - 1][0] for i, (b, _, _) in enumerate(heads)}
    last = heads[-1][0] + 1 if heads else 1
    by = {b: (p, s) for b, p, s in heads}
    index = F.col("bucket") + 1
    is_head = ((F.col("place") == at([by.get(b, (0, 0))[0] for b in range(last)], index))
               & (F.col("spread") == at([by.get(b, (0, 0))[1] for b in range(last)], index)))
    own = F.struct(F.col("bucket").cast("long").alias("bucket"), F.lit(False).alias("ahead"))
    other = F.struct(at([before.get(b, 0) for b in range(last)], index).alias("bucket"), F.lit(True).alias("ahead"))
    return (rows.withColumn("to", F.explode(F.when(is_head, F.array(own, other)).otherwise(F.array(own))))
            .select("doc_id", "text", "place", "spread", "to.bucket", "to.ahead").repartition("bucket")
            .sortWithinPartitions("bucket", "ahead", "place", "spread"))


class _Row:
    """A text with what its successor needs of it."""

    def __init__(self, doc_id: int | None, data: np.ndarray, ranks: np.ndarray):
        self.doc_id, self.data, self.ranks = doc_id, data, ranks
        self.text = data.tobytes().decode()
        self.print = fingerprint(data, ranks)

    def with_next(self, after: _Row, table: np.ndarray) -> dict:
        n = len(self.text)
        head, tail = self.text[:n - n // 2].encode(), after.text[:n // 2].encode()
        edited = np.frombuffer(head + tail, np.uint8)
        # windows of either part have the ranks they had; only those across the seam are new
        own, theirs = max(0, len(head) - WINDOW + 1), max(0, len(tail) - WINDOW + 1)
        seam = table[levels(edited[own:len(edited) - theirs])] if len(edited) else self.ranks[:0]
        ranks = np.concatenate([self.ranks[:own], seam, after.ranks[:theirs]])
        made = fingerprint(edited, ranks)
        return {"doc_id": self.doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited).hexdigest(),
                "fingerprint": packed(self.print), "edited_fingerprint": packed(made),
                "near_edited": likeness(self.print, made), "near_next": likeness(self.print, after.print)}


def _rows(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[_Row]:
    raw, at = utf8(batch.column(1))
    for lo, hi in pieces(at):
        data = raw[at[lo]:at[hi]]
        ranks = table[all_levels(data)]
        for i in range(lo, hi):
            a, b = at[i] - at[lo], at[i + 1] - at[lo]
            yield _Row(batch.column(0)[i].as_py(), data[a:b], ranks[a:max(a, b - WINDOW + 1)])


def compare_edits(docs: DataFrame, ranks: np.ndarray | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): fingerprints of the text and of its edited text, and likenesses.

    The edited text has the last half of its code points replaced by the first
    as many of the next document by id. A null text counts as an empty one,
    whose fingerprint is empty; equal ids go by text; other columns are not
    read; an empty table gives an empty table.
    """
    table = fit_ranks(docs) if ranks is None else ranks
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                        ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                        ("near_next", pa.float64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, closed = None, None, False
        for batch in it:
            out = []
            marks = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for (b, ahead), row in zip(marks, _rows(batch, table)):
                if b != bucket:
                    bucket, held, closed = b, None, False
                if held is not None and not closed:
                    out.append(held.with_next(row, table))
                held, closed = row, ahead  # only the first row ahead counts
                if len(out) >= 256:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return in_order(docs).select("doc_id", "text", "bucket", "ahead").mapInArrow(
        batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                 "near_edited double, near_next double")
