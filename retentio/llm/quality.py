"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's and its host's.

A classifier fitted on labels gives each document a probability of being good.
Those probabilities, summed by path and by host, give each site a posterior
rate: hosts shrink towards the global rate, paths towards their host, the more
the fewer documents they have. The strength of each shrinkage is estimated from
the sites themselves. A document's odds are then moved by the odds of its path
against the global ones, its own evidence left out of its path's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import saved, text_key, without
from retentio.llm.words import LETTERS, U64, Words, pieces, utf8

#: Labelled documents to fit on, at most: those with the smallest hash of their id.
SAMPLE = 12_000
#: A word counts as evidence from so many documents and standard errors on.
LEAST_DOCS, LEAST_Z = 4, 5.5
#: Evidence of all words of a text, at most (log odds).
MOST = 12.0
SHAPES = ["symbols", "upper", "digits", "spaces", "beyond_ascii", "log_words", "distinct", "word_length", "runs", "bars",
          "marked_words"]


class Model(NamedTuple):
    """Two heads, toxic and poor: hashes of telling words with their log odds, then a logistic regression."""
    words: list[np.ndarray]
    odds: list[np.ndarray]
    coefficients: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray


def _shape(w: Words, raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of each word, shape features) of the rows lo..hi: shares that do not depend on which words there are."""
    n_rows, counts = hi - lo, w.counts()
    row = np.repeat(np.arange(n_rows), counts)
    data = raw[at[lo]:at[hi]]
    of_byte = np.repeat(np.arange(n_rows), np.diff(w.at))
    size, n = np.maximum(np.diff(w.at), 1), np.maximum(counts, 1)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of_byte[flags], minlength=n_rows) / size

    same = np.zeros(len(row), bool)
    same[1:] = (w.hashes[1:] == w.hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((w.hashes, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (w.hashes[order][1:] != w.hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    after = data[np.minimum(w.ends, len(data) - 1)] if len(row) else data[:0]
    marked = (after >= 33) & (after <= 42)  # a word followed by one of !"#$%&'()*
    shape = np.stack([
        share(~LETTERS[data] & ~space & ~upper), share(upper), share((data >= 48) & (data <= 57)), share(space),
        share(data >= 128), np.log1p(counts), np.bincount(row[order][fresh], minlength=n_rows) / n,
        np.bincount(row, w.ends - w.starts, n_rows) / n, np.bincount(row[same], minlength=n_rows) / n,
        share(data == 124), np.bincount(row[marked], minlength=n_rows) / n], axis=1)
    return row, shape


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Coefficients (the last one is the constant) by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def _unlike(words: list[np.ndarray]) -> list[int]:
    """Texts that are no near copies of one before: no band of three least hashes is equal."""
    seen, out = set(), []
    for i, h in enumerate(words):
        if not len(h):
            continue
        least = [int((h * U64(2 * k + 1) * U64(0x9E3779B97F4A7C15)).min()) for k in range(12)]
        bands = [(b, *least[3 * b:3 * b + 3]) for b in range(4)]
        if not seen.intersection(bands):
            out.append(i)
        seen.update(bands)
    return out


def _among(some: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(some), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, some), len(sorted_) - 1)] == some


def _quadratic(shape: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((shape - mean) / spread, -8, 8)
    return np.c_[z, z * z]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Telling words by their log odds over texts that are not near copies, and the shape of the text.

    ``sample`` bounds the labelled documents used; rows without both labels and
    labels without a document do not count. Rows that repeat an id count once,
    with one of their texts. Without labels nothing is rejected.
    """
    chosen = (labels.where("quality is not null and toxic is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"),
                                     F.max((F.col("quality") == 0).cast("int")).alias("poor"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    chosen = saved(chosen)  # so many rows at most: small enough to send to all

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(0))
            for lo, hi in pieces(at):
                w = Words(raw, at, lo, hi, LETTERS)
                _, shape = _shape(w, raw, at, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([np.unique(w.hashes[a:b]).tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary()),
                     pa.array([x.tobytes() for x in shape], pa.binary())], ["toxic", "poor", "words", "shape"])

    # one row an id, however often it is repeated: that of the least digest
    one = (docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id").groupBy("doc_id")
           .agg(F.min(F.struct(text_key().alias("key"), "text")).alias("r")))
    rows = (one.join(F.broadcast(chosen), "doc_id").select("r.text", "toxic", "poor")
            .mapInArrow(batches, "toxic int, poor int, words binary, shape binary").collect())
    # the same order in every run, whichever task ended first
    rows.sort(key=lambda r: hashlib.blake2b(bytes(r.words) + bytes(r.shape) + bytes([r.toxic, r.poor])).digest())
    k = len(SHAPES)
    if not rows:
        return Model([np.empty(0, U64)] * 2, [np.empty(0)] * 2, [np.r_[np.zeros(2 * k + 1), -9.0]] * 2, np.zeros(k), np.ones(k))
    words = [np.frombuffer(r.words, U64) for r in rows]
    shape = np.stack([np.frombuffer(r.shape) for r in rows])
    mean, spread = shape.mean(0), shape.std(0) + 1e-6
    x = _quadratic(shape, mean, spread)
    unlike = _unlike(words)
    every = np.concatenate([words[i] for i in unlike]) if unlike else np.empty(0, U64)
    kinds, place = np.unique(every, return_inverse=True)
    owner = np.repeat(np.arange(len(unlike)), [len(words[i]) for i in unlike])
    telling, odds, coefficients = [], [], []
    for y in (np.array([r.toxic for r in rows], float), np.array([r.poor for r in rows], float)):
        own = y[unlike]
        n1 = np.bincount(place, own[owner], len(kinds)) if len(kinds) else np.empty(0)
        n = np.bincount(place, minlength=len(kinds))
        share = min(max(own.mean() if len(own) else 0.5, 1e-6), 1 - 1e-6)
        z = (n1 - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
        ratio = (np.log((n1 + 0.5) / (n - n1 + 0.5)) - np.log(share / (1 - share)))
        pick = (n1 >= LEAST_DOCS) & (z >= LEAST_Z) & (ratio >= 1.5)
        telling.append(kinds[pick])
        odds.append(ratio[pick])
        evidence = np.array([min(MOST, ratio[pick][_among(kinds[pick], w)].sum()) for w in words])
        coefficients.append(_logistic(np.c_[evidence, x], y))
    return Model(telling, odds, coefficients, mean, spread)


def predict(model: Model, raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(toxic, poor) probabilities of the rows lo..hi."""
    w = Words(raw, at, lo, hi, LETTERS)
    row, shape = _shape(w, raw, at, lo, hi)
    x = _quadratic(shape, model.mean, model.spread)
    out = np.empty((hi - lo, 2))
    for k, (kinds, odds, c) in enumerate(zip(model.words, model.odds, model.coefficients)):
        evidence = np.zeros(hi - lo)
        if len(kinds):
            at_kind = np.minimum(np.searchsorted(kinds, w.hashes), len(kinds) - 1)
            hit = kinds[at_kind] == w.hashes
            pairs = np.unique(row[hit] * len(kinds) + at_kind[hit])
            evidence = np.minimum(MOST, np.bincount(pairs // len(kinds), odds[pairs % len(kinds)], hi - lo))
        out[:, k] = 1 / (1 + np.exp(-np.clip(np.c_[evidence, x] @ c[:-1] + c[-1], -30, 30)))
    return out


def evidence(docs: DataFrame, model: Model, host: Column, path: Column) -> DataFrame:
    """(doc_id, key, host, path, toxic, poor, good): the classifier's probabilities for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            raw, at = utf8(batch.column(4))
            p = [predict(sent.value, raw, at, lo, hi) for lo, hi in pieces(at)]
            p = np.concatenate(p) if p else np.empty((0, 2))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(p[:, 0]), pa.array(p[:, 1]),
                 pa.array((1 - p[:, 0]) * (1 - p[:, 1]))], ["doc_id", "key", "host", "path", "toxic", "poor", "good"])

    none = F.lit("")
    return docs.select("doc_id", text_key().alias("key"), F.coalesce(host, none).alias("host"),
                       F.coalesce(path, none).alias("path"), "text").mapInArrow(
        batches, "doc_id long, key binary, host string, path string, toxic double, poor double, good double")


def _strength(rates: DataFrame, mean: Column) -> Column:
    """Documents that a prior is worth, by moments: sites that differ no more than chance makes a strong one.

    ``rates``: n documents with the sum s, around ``mean``. Between sites the
    variance is what is left of the spread after binomial noise.
    """
    between = F.sum(F.col("n") * ((F.col("s") / F.col("n") - mean) ** 2 - mean * (1 - mean) / F.col("n"))) / F.sum("n")
    inside = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    return F.least(F.greatest(inside / F.greatest(between, F.lit(1e-6)) - 1, F.lit(2.0)), F.lit(1e6))


def sites(scored: DataFrame) -> DataFrame:
    """(host, path, path_n, path_s, host_rate, prior, global_rate): what each path is shrunk to, and how much.

    Three aggregations that combine before the shuffle, each of the one before:
    rows to paths, paths to hosts, hosts to the whole.
    """
    paths = saved(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    m = F.lit(min(max((whole.s + 0.5) / (whole.n + 1), 1e-6), 1 - 1e-6) if whole.n else 0.5)
    k_host = hosts.agg(_strength(hosts, m).alias("k")).first().k or 2.0
    hosts = hosts.select(F.col("host").alias("__host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"),
                         ((F.col("s") + k_host * m) / (F.col("n") + k_host)).alias("host_rate"))
    both = saved(paths.join(hosts, F.col("host") == F.col("__host")).drop("__host"))
    k_path = both.agg(_strength(both, F.col("host_rate")).alias("k")).first().k or 2.0
    return both.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s",
                       "host_rate", F.lit(float(k_host)).alias("host_prior"), F.lit(float(k_path)).alias("path_prior"),
                       m.alias("global_rate"))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None,
             sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; by default source as host and lang as path).

    Returns doc_id, key of the text, host, path, toxic, poor, good (the
    document's own evidence), host_rate, path_rate (posteriors without the
    document itself), score (posterior of the document) and accepted
    (score >= threshold). A null or empty text is judged by its shape and site;
    null ids, hosts and paths and repeated rows are rows as others; other
    columns are not read; an empty table gives an empty table, and without
    labels everything is accepted.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scored = saved(evidence(docs, fit(docs, labels, sample), host, path))
    s = sites(scored).withColumnsRenamed({"host": "__host", "path": "__path"})
    j = scored.join(s, (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path")))
    host_rate = ((F.col("host_s") - F.col("good") + F.col("host_prior") * F.col("global_rate"))
                 / (F.col("host_n") - 1 + F.col("host_prior")))
    j = j.withColumn("host_rate", host_rate).withColumn(
        "path_rate", (F.col("path_s") - F.col("good") + F.col("path_prior") * F.col("host_rate"))
        / (F.col("path_n") - 1 + F.col("path_prior")))

    def odds(p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.log(q / (1 - q))

    logit = odds(F.col("good")) + odds(F.col("path_rate")) - odds(F.col("global_rate"))
    return (j.withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("accepted", F.col("score") >= threshold)
            .select("doc_id", "key", "host", "path", "toxic", "poor", "good", "host_rate", "path_rate", "score", "accepted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classify`` accepts, with all their columns."""
    return without(docs, saved(classify(docs, labels).where(~F.col("accepted")).select("doc_id", "key")))
