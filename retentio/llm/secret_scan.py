"""Secret scan in DataFrame functions alone: key patterns, and windowed entropy of other strings.

Positions come from the pieces between matches: the n-th match starts after
n pieces and n - 1 matches. Each pattern is first tried as a plain test, so
only the few texts that hold something pay for positions. No shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]

#: A candidate is a maximal run of these characters with a digit in it.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z+/_=-]*+[0-9][A-Za-z0-9+/_=-]*+"
WINDOW = 20
#: Windows of a candidate that are looked at together.
PIECE = 128
#: Bits a character of the best window, by character class: (class, test, least entropy).
CLASSES = [("digits", r"^[0-9_=/+-]+$", 9.0), ("hex", r"^[0-9a-fA-F]+$", 2.9), ("other", r".", 3.75)]
_FILLER = (r"(?i:example|sample|dummy|placeholder|changeme|notasecret|redacted|test_?key|0123456789|abcdefgh"
           r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|([A-Za-z0-9+/_=-])\%d{7})")
#: A part between separators ('/' is one, or a character of base64) that could be a secret by itself: long enough,
#: with a digit, and no filler in it.
_OWN = "|".join(rf"(?<![A-Za-z0-9{c}])(?=[A-Za-z0-9{c}]{{{WINDOW}}})(?=[A-Za-z{c}]*+[0-9])(?![A-Za-z0-9{c}]*{_FILLER % g})"
                for g, c in ((1, "+"), (2, "+/")))
#: A segment of a path: words, abbreviations, numbers and single letters, not the mixed characters of a key.
_SEGMENT = r"(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[0-9]++|[A-Za-z](?![A-Za-z]))[-_+=]*+)*+"
#: Never secrets: checksums; examples and fillers, UUIDs, long runs of one character and counting, where no other
#: part is long enough; paths of three slashes or more whose every segment is words.
ALLOWED = (r"^(?i:sha(?:1|256|384|512)-)|^(?!.*(?:" + _OWN + r")).*" + _FILLER % 3
           + r"|^(?!.*(?<![^/])(?!" + _SEGMENT + r"(?:/|$)))[^/]*/[^/]*/[^/]*/")

_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, group: int, kind: int, least: int) -> Column:
    """Spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters, with that group's text."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    rows = F.zip_with(F.arrays_zip(whole.alias("m"), value.alias("v")),
                      F.slice(gaps, F.lit(1), F.greatest(F.size(gaps) - 1, F.lit(0))),
                      lambda z, gap: F.struct(F.char_length(z["m"]).alias("n"), z["v"].alias("v"), gap.alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, r: Column) -> Column:
        begin = acc["at"] + r["gap"]
        found = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), (begin + r["n"]).alias("end"),
                                 r["v"].alias("value")))
        return F.struct((begin + r["n"]).alias("at"),
                        F.when(F.char_length(r["v"]) >= least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def _found(text: Column, test: str, spans: Column) -> Column:
    return F.when(text.rlike(test), spans).otherwise(F.array().cast(_SPANS))


def _best(piece: Column, window: int) -> Column:
    """Highest entropy of the windows of a short string of ASCII: a character enters, the one ``window`` back leaves.

    sum(n log2 n) of the first window changes by the counts of these two
    alone, taken in the window with both of them; the least sum is the highest entropy.
    """
    f = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    whole = F.array(*map(F.lit, f[1:]))
    added = F.array(*[F.lit(f[n] - f[n - 1]) for n in range(1, window + 2)])

    def count(within: Column, n: int, c: Column) -> Column:
        return F.lit(n) - F.octet_length(F.replace(within, c, F.lit("")))

    head = F.substring(piece, 1, window)
    first = F.aggregate(F.array_distinct(F.split(head, "")), F.lit(0.0), lambda acc, c: acc + F.when(
        c == "", 0.0).otherwise(F.element_at(whole, F.greatest(count(head, window, c), F.lit(1)))))
    moves = F.transform(
        F.regexp_extract_all(piece, F.lit(f"(?s)(?=(.{{{window + 1}}}))"), F.lit(1)),
        lambda w: F.element_at(added, count(w, window + 1, F.substring(w, window + 1, 1)))
        - F.element_at(added, count(w, window + 1, F.substring(w, 1, 1))))
    least = F.aggregate(
        moves, F.struct(first.alias("sum"), F.lit(float(f[window])).alias("least")),
        lambda acc, d: F.struct((acc["sum"] + d).alias("sum"), F.least(acc["least"], acc["sum"]).alias("least")),
        lambda acc: F.least(acc["sum"], acc["least"]))
    return F.lit(math.log2(window)) - least / F.lit(float(window))


def _pieces(value: Column, window: int) -> Column:
    """Pieces of ``value`` that between them hold each of its windows once, so that no step looks far."""
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{window},{PIECE + window - 1}}})).{{1,{PIECE}}}"), F.lit(1))


def best_entropy(value: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy (bits) of any ``window`` consecutive characters of ``value``; 0 if it is shorter."""
    return F.coalesce(F.array_max(F.transform(_pieces(value, window), lambda p: _best(p, window))), F.lit(0.0))


def reaches(value: Column, bits: Column, window: int = WINDOW) -> Column:
    """Whether ``best_entropy`` is ``bits`` or more: ends at the first piece that reaches it.

    A piece of k different characters has no window of more than log2 k bits, so it needs no look.
    """
    def most(p: Column) -> Column:
        return F.log2(F.size(F.array_distinct(F.split(p, ""))).cast("double")) + 1e-9

    return F.exists(_pieces(value, window), lambda p: (most(p) >= bits) & (_best(p, window) >= bits))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, base, spans), arrays of (start, kind, end, value).

    ``base``: the key patterns, each kind's matches leftmost and non-overlapping.
    ``spans``: base and the entropy spans, by start, then kind: runs of 20 or
    more characters whose best window reaches its class's entropy, unless the
    allow-list (fillers, checksums, paths of words) suppresses them or a base span already overlaps them. Null or
    empty texts have none; null ids and repeated rows pass through; other
    columns are not read; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text",
        _found(F.col("text"), ASSIGN[:-2] + "{6,})", _matches(F.col("text"), ASSIGN, 1, 0, 6)).alias("a"),
        _found(F.col("text"), r"AKIA[A-Z0-9]{16}", _matches(F.col("text"), ACCESS, 0, 1, 20)).alias("k"),
        # runs of 24 and more are the matches of the open pattern that are long enough
        _found(F.col("text"), r"[0-9a-f]{24}", _matches(F.col("text"), r"[0-9a-f]{24,}", 0, 2, 24)).alias("h"),
        _found(F.col("text"), r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{20})[A-Za-z+/_=-]*+[0-9]",
               _matches(F.col("text"), CANDIDATE, 0, 3, WINDOW)).alias("e"))
    base = base.select("doc_id", F.array_sort(F.concat("a", "k", "h")).alias("base"), "e")

    def judged(s: Column) -> Column:
        """A candidate with the entropy that it needs, null if something else rules it out: found once, not at each piece."""
        v = s["value"]
        need = F.lit(9.0)
        for _, test, bits in reversed(CLASSES):
            need = F.when(v.rlike(test), F.lit(bits)).otherwise(need)
        overlaps = F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(s.alias("span"), F.when(~overlaps & ~v.rlike(ALLOWED), F.nullif(need, F.lit(9.0))).alias("need"))

    secret = F.filter(F.transform("e", judged), lambda c: c["need"].isNotNull() & reaches(c["span"]["value"], c["need"]))
    return base.select("doc_id", "base", F.array_sort(F.concat("base", F.transform(secret, lambda c: c["span"]))).alias("spans"))


def listed(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the listed spans of ``scan``'s rows."""
    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    n = [number(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])]
    return found.select("doc_id", *n, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
                        listed("spans").alias("spans"))
