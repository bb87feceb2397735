"""License scan: ordered signature rules behind a keyword gate.

A text's words are looked up once in the set of all rule keywords; only rules
whose keywords all occur are run, over the words joined by single spaces.
Where detections overlap, one that lies inside another of equal or stronger
rank is suppressed; base rules (rank 0) neither suppress nor are suppressed.
Rows are independent: no shuffle, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retentio.llm.license_rules import RULES

#: Bytes of words stay (A-Z lower-cased); all others turn to spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


#: Patterns take either spelling; keywords name one.
_SPELLINGS = {b"licence": b"license", b"licenced": b"licensed"}


class Rule(NamedTuple):
    label: str
    rank: int
    certainty: float
    keywords: frozenset
    pattern: re.Pattern
    literal: bytes | None


class Detection(NamedTuple):
    start: int  # in words
    end: int
    rule: int


def parse(rules: str) -> list[Rule]:
    out, label = [], ""
    for line in filter(None, map(str.strip, rules.splitlines())):
        head, bar, pattern = line.partition(" | ")
        if not bar:
            label = head
            continue
        rank, percent, keywords = head.split()
        out.append(Rule(label, int(rank), int(percent) / 100, frozenset(k.encode() for k in keywords.split(",")),
                        re.compile(b"(?<= )(?:" + pattern.encode() + b")(?= )"),
                        f" {pattern} ".encode() if re.fullmatch("[a-z0-9 ]+", pattern) else None))
    return out


class Scanner:
    def __init__(self, rules: str = RULES):
        self.rules = parse(rules)
        self.keywords = frozenset(_SPELLINGS).union(*(r.keywords for r in self.rules))
        self.by_word = defaultdict(list)  # each rule stands at one of its keywords
        for i, r in enumerate(self.rules):
            self.by_word[min(r.keywords)].append(i)

    def _places(self, rule: Rule, text: bytes) -> Iterator[tuple[int, int]]:
        if rule.literal is None:
            yield from (m.span() for m in rule.pattern.finditer(text))
            return
        at = text.find(rule.literal)
        while at >= 0:
            yield at + 1, at + len(rule.literal) - 1
            at = text.find(rule.literal, at + 1)

    def scan(self, text: str) -> tuple[int, list[Detection]]:
        """(number of words, detections that stand), by start, longer ones first."""
        words = text.encode("utf-8", "replace").translate(_WORDS).split()
        have = self.keywords.intersection(words)
        have |= {_SPELLINGS[w] for w in have.intersection(_SPELLINGS)}
        rules = [i for w in have for i in self.by_word.get(w, ()) if self.rules[i].keywords <= have]
        if not rules:
            return len(words), []
        joined = b" " + b" ".join(words) + b" "
        found = [(i, s, e) for i in rules for s, e in self._places(self.rules[i], joined)]
        if not found:
            return len(words), []
        spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.searchsorted(spaces, [s for _, s, _ in found]) - 1
        ends = np.searchsorted(spaces, [e for _, _, e in found])
        return len(words), self._standing([Detection(int(a), int(b), i) for (i, _, _), a, b in zip(found, starts, ends)])

    def _standing(self, found: list[Detection]) -> list[Detection]:
        """Drop what lies inside a detection of equal or stronger rank: one sweep, with the furthest end of each rank."""
        found.sort(key=lambda d: (d.start, -d.end, self.rules[d.rule].rank, d.rule))
        reach: dict[int, int] = {}
        out = []
        for d in found:
            rank = self.rules[d.rule].rank
            if rank and any(r <= rank and end >= d.end for r, end in reach.items()):
                continue
            out.append(d)
            if rank:
                reach[rank] = max(reach.get(rank, 0), d.end)
        return out


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, detections array<struct<label:string,start:long,end:long,certainty:double>>")


def scan(docs: DataFrame, rules: str = RULES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words, base places, labels, score and all standing detections.

    ``score``: 1 - product of (1 - certainty) over the best detection of each
    label; 0 without any. A null or empty text has no words and no detections;
    null ids and repeated rows pass through; other columns are not read; an
    empty table gives an empty table.
    """
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                            ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                            ("labels", pa.string()), ("score", pa.float64()),
                            ("detections", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()),
                                                               ("end", pa.int64()), ("certainty", pa.float64())])))])
        for batch in it:
            rows = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                n, found = scanner.scan(text.as_py() or "")
                base = [d for d in found if scanner.rules[d.rule].rank == 0]
                best: dict[str, float] = {}
                for d in found:
                    r = scanner.rules[d.rule]
                    best[r.label] = max(best.get(r.label, 0.0), r.certainty)
                rows.append({
                    "doc_id": doc_id.as_py(), "n_words": n, "n_base": len(base),
                    "first_word": base[0].start if base else None, "last_word": base[-1].start if base else None,
                    "base_labels": ",".join(sorted({scanner.rules[d.rule].label for d in base})),
                    "labels": ",".join(sorted(best)),
                    "score": 1.0 - float(np.prod([1.0 - best[k] for k in sorted(best)])) if best else 0.0,
                    "detections": [{"label": scanner.rules[d.rule].label, "start": d.start, "end": d.end,
                                    "certainty": scanner.rules[d.rule].certainty} for d in found]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("doc_id", "text").mapInArrow(batches, SCHEMA)
