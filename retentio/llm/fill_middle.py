"""Fill-in-middle: texts cut at unit boundaries that a learned rank index finds.

A text's units are runs of ASCII letters and single other characters. Where the
r-th boundary lies grows almost in a straight line with r, so the index keeps a
few line segments, each off by ERROR bytes at most, and one signed byte a
boundary for what the line misses: a cut is predicted by its segment and set
right by its residual, without the offsets themselves. One index serves any
number of draws. Rows are independent: no shuffle, a lost executor costs its
tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.words import pieces, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = (b"<P>", b"<S>", b"<M>")
#: Most that a segment may be off, in bytes: residuals fit a signed byte.
ERROR = 127
#: Of 100 texts so many stay plain; of 100 others so many have their suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Boundaries looked at together while a segment grows.
STEP = 1 << 12


class RankIndex(NamedTuple):
    """Segments (first rank, offset there, bytes a rank) and a residual for every rank."""
    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def at(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of ``ranks``."""
        return self.predicted(ranks) + self.residual[ranks]


def fit(offsets: np.ndarray) -> RankIndex:
    """Segments as long as one line from their first boundary stays within ERROR of all others (a cone that narrows)."""
    first, base, slope = [], [], []
    i, n = 0, len(offsets)
    while i < n:
        low, high, j = -np.inf, np.inf, i + 1
        while j < n:
            k = min(n, j + STEP)
            run = np.arange(j - i, k - i)
            rise = offsets[j:k] - offsets[i]
            lows = np.maximum.accumulate(np.maximum((rise - ERROR) / run, low))
            highs = np.minimum.accumulate(np.minimum((rise + ERROR) / run, high))
            apart = lows > highs
            end = int(apart.argmax()) if apart.any() else k - j
            if end:
                low, high = lows[end - 1], highs[end - 1]
            j += end
            if end < len(run):
                break
        first.append(i)
        base.append(offsets[i])
        slope.append((low + high) / 2 if j > i + 1 else 0.0)
        i = j
    index = RankIndex(np.array(first, np.int64), np.array(base, np.int64), np.array(slope, np.float64),
                      np.zeros(n, np.int8))
    return index._replace(residual=(offsets - index.predicted(np.arange(n))).astype(np.int8))


class _Units:
    """Unit boundaries of the rows lo..hi of a column, all at once."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, lo: int, hi: int):
        self.data = raw[at[lo]:at[hi]]
        self.at = at[lo:hi + 1] - at[lo]
        low = self.data | 32
        letter = (low >= 97) & (low <= 122)
        self.inner = (self.data & 0xC0) == 0x80  # bytes inside a character
        goes_on = np.empty(len(letter), bool)
        goes_on[1:], goes_on[:1] = letter[1:] & letter[:-1], False
        goes_on[self.at[:-1][self.at[:-1] < len(letter)]] = False
        self.starts = np.flatnonzero(~self.inner & ~goes_on)
        self.first = np.searchsorted(self.starts, self.at)

    def offsets(self, d: int) -> np.ndarray:
        """Where row d's units start, and where the last one ends."""
        return np.r_[self.starts[self.first[d]:self.first[d + 1]], self.at[d + 1]] - self.at[d]

    def text(self, d: int) -> bytes:
        return self.data[self.at[d]:self.at[d + 1]].tobytes()

    def chars(self, d: int, a: int, b: int) -> int:
        return int(b - a - np.count_nonzero(self.inner[self.at[d] + a:self.at[d] + b]))


def draw(doc_id: int | None, seed: int, n: int) -> tuple[int, int, int, int]:
    """(first cut, second cut, the throw for plain, the throw for suffix first) of a text of n units."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = a % (n + 1), b % (n + 1)
    return min(a, b), max(a, b), c % 100, d % 100


def rank_index(docs: DataFrame) -> DataFrame:
    """The index of every row of ``docs`` (doc_id, text): (doc_id, n, segments, residuals).

    A null or empty text has no units, and one boundary. Null ids and repeated
    rows pass through; other columns are not read; an empty table gives an
    empty table.
    """
    segment = pa.struct([("first", pa.int64()), ("base", pa.int64()), ("slope", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("segments", pa.list_(segment)), ("residuals", pa.binary())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(1))
            for lo, hi in pieces(at):
                u = _Units(raw, at, lo, hi)
                found = [fit(u.offsets(d)) for d in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(x.residual) - 1 for x in found], pa.int64()),
                     pa.array([[{"first": a, "base": b, "slope": c} for a, b, c in zip(*(y.tolist() for y in x[:3]))]
                               for x in found], pa.list_(segment)),
                     pa.array([x.residual.tobytes() for x in found], pa.binary())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        batches, "doc_id long, n long, segments array<struct<first:long,base:long,slope:double>>, residuals binary")


def transform(docs: DataFrame, seeds: tuple[int, ...] = (1,), plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text) and seed: (doc_id, seed, n, form, prefix_chars, middle_chars, output).

    Both cuts are drawn from a hash of seed and id, in units. ``form``: psm
    (<P>prefix<S>suffix<M>middle), spm (<S>suffix<P>prefix<M>middle), or plain:
    the text itself, if it is empty, holds one of the three marks, or is drawn.
    A null text is an empty one; rows without an id draw as from an empty id;
    repeated rows each come out alike; other columns are not read; an empty
    table gives an empty table.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("seed", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
                        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in pieces(at):
                u = _Units(raw, at, lo, hi)
                rows: list[tuple] = []
                for d in range(hi - lo):
                    index, text = fit(u.offsets(d)), u.text(d)
                    n = len(index.residual) - 1
                    marked = not n or any(m in text for m in _MARKS)
                    for seed in seeds:
                        one, two, c, e = draw(ids[lo + d], seed, n)
                        if marked or c >= 100 - plain:
                            rows.append((ids[lo + d], seed, n, "plain", None, None, text))
                            continue
                        a, b = index.at(np.array([one, two])).tolist()
                        before, inside, after = text[:a], text[a:b], text[b:]
                        form, parts = (("spm", (_MARKS[1], after, _MARKS[0], before)) if e < suffix_first
                                       else ("psm", (_MARKS[0], before, _MARKS[1], after)))
                        rows.append((ids[lo + d], seed, n, form, u.chars(d, 0, a), u.chars(d, a, b),
                                     b"".join((*parts, _MARKS[2], inside))))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[i], schema.field(i).type) for i in range(6)]
                    + [pa.array(columns[6], pa.binary()).cast(pa.string())], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(
        batches, "doc_id long, seed long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. No mark can arise where a text meets one, so the first of each is it."""
    def between(one: str, two: str) -> tuple[Column, Column, Column]:
        """What follows mark ``one`` at the start, mark ``two`` after it, and MIDDLE after that."""
        at_two = F.locate(two, output, len(one) + 1)
        at_middle = F.call_function("locate", F.lit(MIDDLE), output, at_two + len(two))
        end = F.char_length(output)
        return (F.substring(output, F.lit(len(one) + 1), at_two - len(one) - 1),
                F.substring(output, at_two + len(two), at_middle - at_two - len(two)),
                F.substring(output, at_middle + len(MIDDLE), end))

    prefix, suffix, middle = between(PREFIX, SUFFIX)
    suffix_, prefix_, middle_ = between(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(prefix, middle, suffix))
            .when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output))


def digest(transformed: DataFrame) -> DataFrame:
    """``transform``'s rows with digests in place of texts: of the output, and of the text rebuilt from it."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


#: The same in SQL over the documents table.
ORACLE = f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || doc_id) AS h
  FROM documents
), thrown AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS h1,
         ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS h2, ('0x' || h[17:24])::BIGINT % 100 AS h3,
         ('0x' || h[25:32])::BIGINT % 100 AS h4
  FROM units
), cut AS (
  SELECT doc_id, text, n, coalesce(array_to_string(u[1:least(h1, h2)], ''), '') AS a,
         coalesce(array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], ''), '') AS b,
         coalesce(array_to_string(u[greatest(h1, h2) + 1:n], ''), '') AS c,
         CASE WHEN n = 0 OR h3 >= {100 - PLAIN} OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
              THEN 'plain' WHEN h4 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form
  FROM thrown
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                   ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256,
       sha256(a || b || c) AS restored_sha256
FROM cut
"""
