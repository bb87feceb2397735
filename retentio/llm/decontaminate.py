"""Benchmark decontamination: a prefix-filtered join of word shingles, verified word by word.

A window (so many consecutive words of an item) can only occur where all its
shingles occur, so one of them is enough to look for: its rarest in the corpus.
Two passes over the documents: one counts the shingles that windows have, one
lists where the chosen ones stand, with the words around. Both are gated by a
Bloom filter of the wanted shingles, whose size has a fixed bound; what it lets
through wrongly falls out of the join. Each place is then checked against the
windows of its shingle: bounds first, then all words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import saved, text_key, without
from retentio.llm.words import LETTERS, U64, Words, mix, pieces, rolled, utf8

WINDOW = 10
SHINGLE = 4
#: The Bloom filter has 16 bits a shingle up to this many bytes.
FILTER_BYTES = 8 << 20


def _lengths(k: int) -> range:
    return range(1, k + 1)


def _grams(words: Words, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes of so many consecutive words, wherever they start)."""
    for n in _lengths(k):
        yield n, rolled(words.hashes, n) ^ U64(n)


def windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(words, n, grams, items): distinct windows, their words joined by spaces, shingle hashes by place, item ids.

    A window of fewer than ``shingle`` words is one shingle of all its words.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(1))
            for lo, hi in pieces(at):
                w = Words(raw, at, lo, hi, LETTERS)
                rows = []
                for d in range(hi - lo):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    size = min(window, b - a)
                    k = min(shingle, size)
                    for s in range(a, b - size + 1) if size else ():
                        grams = (rolled(w.hashes[s:s + size], k) ^ U64(k)).view(np.int64)
                        rows.append({"item": batch.column(0)[lo + d].as_py(), "words": w.joined(s, s + size),
                                     "n": size, "grams": grams.tolist()})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("item", pa.int64()), ("words", pa.string()), ("n", pa.int32()), ("grams", pa.list_(pa.int64()))]))

    every = items.select(F.col("item_id").cast("long"), "text").mapInArrow(
        batches, "item long, words string, n int, grams array<long>")
    return every.groupBy("words").agg(F.first("n").alias("n"), F.first("grams").alias("grams"),
                                      F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("items"))


class Filter:
    """A Bloom filter over 64-bit hashes: two bits each, a bounded number of bytes."""

    def __init__(self, hashes: np.ndarray | None = None, n: int = 0, most: int = FILTER_BYTES):
        self.bits = 10
        while (1 << self.bits) < 16 * max(n, 1) and (1 << self.bits) < 8 * most:
            self.bits += 1
        self.table = np.zeros(1 << (self.bits - 3), np.uint8)
        if hashes is not None:
            self.add(hashes)

    def _at(self, h: np.ndarray) -> Iterator[np.ndarray]:
        yield h >> U64(64 - self.bits)
        yield mix(h) >> U64(64 - self.bits)

    def add(self, h: np.ndarray) -> None:
        for at in self._at(h):
            np.bitwise_or.at(self.table, (at >> U64(3)).astype(np.int64), np.uint8(1) << (at & U64(7)).astype(np.uint8))

    def __or__(self, other: Filter) -> Filter:
        self.table |= other.table
        return self

    def has(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._at(h):
            out &= (self.table[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1
        return out


def bloom(hashes: DataFrame, column: str) -> tuple[Filter, int]:
    """A filter of all values of ``column``, merged pairwise on the executors; and their number."""
    n = hashes.count()
    empty = Filter(n=n)

    def part(rows: Iterator) -> Iterator[Filter]:
        f = Filter(n=n)
        h = np.fromiter((r[0] for r in rows), np.int64).view(U64)
        f.add(h)
        yield f

    return hashes.select(column).rdd.mapPartitions(part).treeReduce(lambda a, b: a | b, depth=2) if n else empty, n


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, items (sorted ids as strings), and ``key`` of the text.

    A word is hit if it lies in any place where a window of an item of
    ``items`` (item_id, text) occurs. Null or empty texts have no words, and
    items without words no windows; null ids and repeated rows are rows as
    others; other columns are not read; empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    wins = saved(windows(items, window, shingle))
    grams = saved(wins.select(F.explode("grams").alias("gram")).distinct())
    lengths = sorted(r[0] for r in wins.select(F.least("n", F.lit(shingle)).alias("n")).distinct().collect())
    wanted, _ = bloom(grams, "gram")
    seen = spark.sparkContext.broadcast(wanted)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(0))
            found = [np.empty(0, U64)]
            for lo, hi in pieces(at):
                w = Words(raw, at, lo, hi, LETTERS)
                row = np.repeat(np.arange(hi - lo), w.counts())
                for n in lengths:
                    h = rolled(w.hashes, n) ^ U64(n)
                    ok = seen.value.has(h) & (row[:len(h)] == row[n - 1:]) if len(h) else np.zeros(0, bool)
                    found.append(h[ok])
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["gram", "n"])

    # rarity of the windows' shingles over all documents
    often = (docs.select("text").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("often")))
    # the necessary prefix for full containment is one shingle: the rarest
    placed = wins.select("words", "n", "items", F.posexplode("grams").alias("offset", "gram"))
    rare = placed.join(often, "gram", "left").groupBy("words").agg(
        F.first("n").alias("n"), F.first("items").alias("items"),
        F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "gram", "offset")).alias("r"))
    index = saved(rare.where("r.often > 0").groupBy(F.col("r.gram").alias("gram")).agg(
        F.collect_list(F.struct("words", "n", F.col("r.offset").alias("offset"), "items")).alias("wins")))
    chosen, _ = bloom(index, "gram")
    prefix = spark.sparkContext.broadcast(chosen)

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n_words", pa.int64()),
                            ("at", pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int64()), ("before", pa.int32()),
                                                       ("words", pa.string())])))])
        for batch in it:
            raw, at = utf8(batch.column(2))
            for lo, hi in pieces(at):
                w = Words(raw, at, lo, hi, LETTERS)
                row = np.repeat(np.arange(hi - lo), w.counts())
                hits: list[list[dict]] = [[] for _ in range(hi - lo)]
                for n in lengths:
                    h = rolled(w.hashes, n) ^ U64(n)
                    if not len(h):
                        continue
                    for s in np.flatnonzero(prefix.value.has(h) & (row[:len(h)] == row[n - 1:])):
                        d = row[s]
                        a, b = int(w.first[d]), int(w.first[d + 1])
                        left, right = max(a, s - window + 1), min(b, s + window)
                        hits[d].append({"gram": int(h[s].view(np.int64)), "pos": int(s - a), "before": int(s - left),
                                        "words": w.joined(left, right)})
                n_words = w.counts()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array(n_words, pa.int64()), pa.array(hits, schema.field("at").type)], schema=schema)

    scanned = saved(docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        places, "doc_id long, key binary, n_words long, at array<struct<gram:long,pos:long,before:int,words:string>>"))
    # equal rows are counted here, and their places, equal too, go on once
    rows = scanned.groupBy("doc_id", "key").agg(F.first("n_words").alias("n_words"), F.count("*").alias("rows"))
    joined = (scanned.where(F.size("at") > 0).select("doc_id", "key", F.posexplode("at").alias("k", "at"))
              .dropDuplicates(["doc_id", "key", "k"]).withColumn("gram", F.col("at.gram")).join(index, "gram"))
    words = F.split(F.col("at.words"), " ")

    def occurs(win):
        # positional bound, then length bound, then the words themselves
        begin = F.col("at.before") - win["offset"]
        return (begin >= 0) & (begin + win["n"] <= F.size(words)) & (
            F.array_join(F.slice(words, F.greatest(begin, F.lit(0)) + 1, win["n"]), " ") == win["words"])

    true = F.filter("wins", occurs)
    verified = joined.select(
        F.col("doc_id").alias("__id"), F.col("key").alias("__key"),
        F.transform(true, lambda x: F.struct((F.col("at.pos") - x["offset"]).alias("a"),
                                             (F.col("at.pos") - x["offset"] + x["n"]).alias("b"))).alias("spans"),
        F.flatten(F.transform(true, lambda x: x["items"])).alias("items"))
    hit = verified.where(F.size("spans") > 0).groupBy("__id", "__key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    grouped = rows.join(hit, rows["doc_id"].eqNullSafe(hit["__id"]) & (rows["key"] == hit["__key"]), "left").select(
        "doc_id", "key", "n_words", "rows", F.coalesce("spans", F.array().cast(hit.schema["spans"].dataType)).alias("spans"),
        F.coalesce("items", F.array().cast(hit.schema["items"].dataType)).alias("items"))
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end"))
    union = F.aggregate("spans", zero, lambda acc, s: F.struct(
        (acc["hit"] + F.greatest(s["b"] - F.greatest(s["a"], acc["end"]), F.lit(0).cast("long"))).alias("hit"),
        F.greatest(acc["end"], s["b"]).alias("end")), lambda acc: acc["hit"])
    return (grouped.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("__row")
            .select("doc_id", "key", "n_words", union.alias("n_hit"), "items"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    return without(docs, saved(scan(docs, items).where("n_hit > 0").select("doc_id", "key")))
