"""Mixing sources to target weights by balanced (cube) sampling.

A source's target over its size says how often each of its documents is taken:
whole copies for the integer part, and with the fractional part as inclusion
probability for one more. The cube method picks these so that every source's
words and number of documents stay balanced. Only (id, source, size) take part:
the flight runs within blocks of a source, what stays undecided (14 documents
a block at most) flies on in blocks of blocks, and the last few land: the best
of all their subsets is taken.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import ranked, saved, text_key
from retentio.llm.words import NOT_SPACE, Words, pieces, utf8

#: Documents of a first block; later blocks join so many blocks (14 documents each).
BLOCK = 4096
FAN_IN = 256
#: Documents that each flight keeps for the landing, where all subsets of the last are tried.
LANDING = 12
EDGE = 1e-9
CAP = 3.0


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, source, size): ``size`` counts the runs of characters that are not ASCII white space; null has none."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(3))
            n = [c for lo, hi in pieces(at) for c in Words(raw, at, lo, hi, NOT_SPACE, hashed=False).counts()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64())],
                                             ["doc_id", "key", "source", "size"])

    return docs.select("doc_id", text_key().alias("key"), "source", "text").mapInArrow(
        batches, "doc_id long, key binary, source string, size long")


def targets(by_source: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """``by_source`` (source, source_size) with ``target``: shares of the total by weight, ``cap`` times the size at most.

    Sources by code point, null last, weigh ``weights`` in turn. What capped
    sources cannot take is shared again among the others by weight, until no
    target is above its cap: one small aggregation a round, and each round caps
    one more source at least.
    """
    place = ranked(by_source, F.col("source").isNull(), F.col("source"), name="__place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights)).cast("int") + 1)
    t = saved(place.withColumn("weight", w.cast("double")).withColumn("__capped", F.lit(False)))
    total = t.agg(F.sum("source_size")).first()[0] or 0
    fixed = 0.0
    while True:
        open_ = t.where(~F.col("__capped")).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
        rate = (total - fixed) / open_.w if open_.n else 0.0
        over = ~F.col("__capped") & (F.lit(rate) * F.col("weight") > cap * F.col("source_size"))
        t = t.withColumn("__capped", F.col("__capped") | over)
        now = t.agg(F.sum(F.when(F.col("__capped"), F.col("source_size")).otherwise(0)).alias("s"),
                    F.count(F.when(~F.col("__capped"), 1)).alias("n")).first()
        if now.n == open_.n:
            break
        fixed = cap * float(now.s or 0)
    return t.withColumn("target", F.when(F.col("__capped"), cap * F.col("source_size"))
                        .otherwise(F.lit(float(rate)) * F.col("weight"))).drop("__place", "__capped", "weight")


def fly(units: list[tuple[float, float]], draw: Callable[[], float]) -> list[float]:
    """Move probabilities along the null-space of (1, size) until at most two are strictly between 0 and 1.

    ``units``: (probability, size). Three undecided units x, y, z have the null
    vector (size_y - size_z, size_z - size_x, size_x - size_y); a step along it
    keeps expected count and size, and decides one unit at least. Which way is
    drawn so that every probability keeps its mean.
    """
    p = [u[0] for u in units]
    active: list[int] = []

    def decided(i: int) -> bool:
        if p[i] < EDGE:
            p[i] = 0.0
        elif p[i] > 1 - EDGE:
            p[i] = 1.0
        return p[i] in (0.0, 1.0)

    for i in range(len(units)):
        if decided(i):
            continue
        active.append(i)
        while len(active) == 3:
            x, y, z = (units[k][1] for k in active)
            u = (y - z, z - x, x - y)
            if not any(u):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(active, u) if v)
            down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(active, u) if v)
            step = up if draw() * (up + down) < down else -down
            for k, v in zip(active, u):
                p[k] = min(1.0, max(0.0, p[k] + step * v))
            left = [k for k in active if not decided(k)]
            if len(left) == 3:  # rounding kept all three open: the nearest one is decided
                k = min(left, key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                left.remove(k)
            active = left
    return p


def land(units: list[tuple[float, float]]) -> list[float]:
    """Decide the few units still open: of all their subsets, one that is nearest in words, then in documents."""
    p = [u[0] for u in units]
    open_ = [i for i, q in enumerate(p) if 0.0 < q < 1.0]
    picks = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
    size = np.array([units[i][1] for i in open_])
    prob = np.array([p[i] for i in open_])
    off = np.abs(picks @ size - prob @ size) + np.abs(picks.sum(1) - prob.sum())
    for i, pick in zip(open_, picks[int(off.argmin())]):
        p[i] = float(pick)
    return p


def _flight(last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # equal rows came as one with their number here
        rows = rows.loc[rows.index.repeat(rows["alike"])].assign(alike=1)
        # large documents first, so that mostly small ones are left to land
        rows = rows.sort_values(["size", "spread", "doc_id"], ascending=[False, True, True], kind="stable")
        draw = random.Random(repr(tuple(map(str, key)))).random  # the block's own numbers: reruns agree
        units = list(zip(rows["p"].astype(float), rows["size"].astype(float)))
        # each flight leaves a dozen of all sizes on the ground: with them the landing can balance
        wait = [i for i, (q, _) in enumerate(units) if EDGE <= q <= 1 - EDGE]
        wait = {wait[i * len(wait) // min(LANDING, len(wait))] for i in range(min(LANDING, len(wait)))}
        flown = iter(fly([u for i, u in enumerate(units) if i not in wait], draw))
        p = [u[0] if i in wait else next(flown) for i, u in enumerate(units)]
        return rows.assign(p=land([(q, s) for q, (_, s) in zip(p, units)]) if last else p)

    return run


def deal(state: DataFrame) -> DataFrame:
    """Rows (spread, alike, blocks) with their ``block``: ``alike`` equal rows go evenly to as many blocks as they fill."""
    share = F.floor(F.col("alike") / F.col("blocks"))
    dealt = F.transform(F.sequence(F.lit(0).cast("long"), F.least("alike", "blocks") - 1), lambda j: F.struct(
        F.pmod(F.pmod(F.col("spread"), F.col("blocks")) + j, F.col("blocks")).alias("block"),
        (share + F.when(j < F.col("alike") % F.col("blocks"), 1).otherwise(0)).alias("alike")))
    return state.withColumn("deal", F.explode(dealt)).drop("alike").select("*", "deal.block", "deal.alike").drop("deal")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): key (of the text), source, size,
    source_size, target, copies, taken.

    ``copies`` (0 .. ceil(cap)) says how often the mix takes the document,
    ``taken`` = copies * size. A null or empty text has size 0 and may be taken
    without cost; null ids, a null source and repeated rows are rows as others;
    other columns are not read; an empty table gives an empty table.
    """
    narrow = saved(sizes(docs).groupBy("doc_id", "key", "source", "size").agg(F.count("*").alias("alike"))
                   .withColumn("spread", F.xxhash64("doc_id", "key", "source")))
    totals = narrow.groupBy("source").agg(F.sum(F.col("size") * F.col("alike")).alias("source_size"),
                                          F.sum("alike").alias("source_docs"))
    goal = saved(targets(totals, weights, cap))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    g = goal.withColumn("ratio", ratio).withColumnRenamed("source", "__source")
    state = (narrow.join(g, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
             .withColumn("whole", F.floor(F.col("ratio") + EDGE))
             .withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
             .withColumn("blocks", F.ceil(F.col("source_docs") / block)))
    most = totals.agg(F.max("source_docs")).first()[0] or 0
    blocks = -(-most // block)
    state = deal(state).select(
        "doc_id", "key", "source", "size", "spread", "source_size", "target", "whole", "p", "block", "alike")
    schema = state.schema
    done = []
    while True:
        last = blocks <= 1
        state = saved(state.groupBy("source", "block").applyInPandas(_flight(last), schema))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(state.where(~open_))
        if last:
            break
        state = state.where(open_).withColumn("block", F.floor(F.col("block") / FAN_IN).cast("long"))
        blocks = -(-blocks // FAN_IN)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    copies = (F.col("whole") + F.col("p")).cast("long")
    return out.select("doc_id", "key", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with all their columns.

    Rows of equal id, text and source share what the mix takes of them.
    """
    taken = saved(mix(docs, weights, cap).where("copies > 0").groupBy("doc_id", "key", "source").agg(
        F.sum("copies").alias("__copies")))
    t = taken.select(F.col("doc_id").alias("__id"), F.col("key").alias("__k"), F.col("source").alias("__s"), "__copies")
    keyed = docs.withColumn("__key", text_key())
    alike = keyed.groupBy("doc_id", "__key", "source").agg(F.count("*").alias("__n")).where("__n > 1").select(
        F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), F.col("source").alias("__s"))
    if alike.head(1):  # equal rows: one of them stands for all
        keyed = keyed.dropDuplicates(["doc_id", "__key", "source"])
    return (keyed.join(t, keyed["doc_id"].eqNullSafe(t["__id"]) & (keyed["__key"] == t["__k"])
                       & keyed["source"].eqNullSafe(t["__s"]))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
            .select(*docs.columns))
