"""Personal data by weak supervision: labelers vote on spans, EM weighs the votes, a classifier of spans decides.

One pass over the texts finds the base spans (email, ip, card, phone) and other
candidates: national phone numbers, spelled-out addresses, social security
numbers, bank accounts, names, and what base patterns matched but dropped. Five
labelers vote on each: pattern, check digits, gazetteer, context and
surroundings. What Spark counts is small whatever the corpus: spans by kind
and votes (EM turns these into each labeler's reliability and a probability
for each pattern of votes), then features by weight of that probability (a
naive Bayes classifier over hashed features of spans and votes). A base span
always stays; another stays where the classifier is sure.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.tables import saved

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "ssn", "iban", "name"]
EMAIL, IP, CARD, PHONE, SSN, IBAN, NAME = range(len(KINDS))
LABELERS = ["pattern", "checks", "gazetteer", "context", "surroundings"]
#: Hashed features of the span classifier.
FEATURES = 1 << 12
#: Probability from which a span that is not a base span stays.
SURE = 0.9
#: Rounds of EM; the share of all spans that counts beforehand as a labeler's right and wrong votes, so that it starts
#: out better than chance, and the share of a kind's spans that counts as half personal.
ROUNDS, TRUST, EVEN = 30, (0.03, 0.01), 0.1
#: Counted probabilities are whole numbers of so many.
WHOLE = 1 << 16
#: Characters before a span in which context words count.
BEFORE = 40

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match starts where digits do
_DIGITS = re.compile(r"[0-9]+(?:[\x20-][0-9]+)*")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}[ ]?[\[(]at[\])][ ]?[A-Za-z0-9-]{1,63}(?:[ ]?(?:\.|[\[(]dot[\])])[ ]?[A-Za-z0-9-]{1,63}){1,4}")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)[ ]?|0[0-9]{1,4}[ /-]|[0-9]{3}[-.])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z-])")
_SOCIAL = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_NAMES = re.compile(r"(?<![A-Za-zÀ-ÿ])[A-ZÀ-Þ][a-zß-ÿ]{1,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{1,20}){1,2}(?![A-Za-zÀ-ÿ])")
_WORD = re.compile(r"[^\W\d_]+")

#: Words before a span that speak for its kind.
CUES = {
    EMAIL: "email mail e contact write correo courriel adresse kontakt reach",
    IP: "ip host server address adresse dirección from client peer",
    CARD: "card visa mastercard amex credit debit karte tarjeta carte payment",
    PHONE: "phone tel telephone call mobile cell fax telefon teléfono téléphone whatsapp contact",
    SSN: "ssn social security insurance taxpayer",
    IBAN: "iban account konto cuenta compte bank",
    NAME: "name named mr mrs ms dr herr frau señor señora monsieur madame dear signed sincerely",
}
#: Words before a span that speak against personal data.
AGAINST = "version release chapter section page isbn issn order invoice serial build model part item figure table rfc example"
#: Given names frequent in English, German, French and Spanish.
GIVEN = ("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan "
         "jessica sarah karen peter hans klaus wolfgang jürgen stefan andreas ursula monika petra sabine claudia anna julia laura jean "
         "pierre michel andré philippe alain jacques marie nathalie isabelle sylvie catherine françois josé antonio juan manuel francisco "
         "luis javier carlos maría carmen josefa isabel dolores pilar ana lucía paula daniel martin alexander emma sophie maria")
#: issuers' first digits of payment cards.
ISSUERS = ("4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "34", "37", "6011", "65", "35", "36", "30", "62")
#: Address ranges of no single host in public (first parts).
NO_HOST = ("0.", "10.", "127.", "169.254.", "192.168.", "192.0.2.", "198.51.100.", "203.0.113.", "224.", "239.", "255.")
#: Domains set aside for examples.
NO_MAIL = ("example.com", "example.org", "example.net", ".test", ".invalid", ".localhost")
#: Country calling codes of one or two digits.
CALLING = ("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
           "90 91 92 93 94 95 98").split()

_CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
_AGAINST, _GIVEN = frozenset(AGAINST.split()), frozenset(GIVEN.split())


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    base: bool
    strict: int  # the pattern labeler's vote


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _numbers(s: str) -> str:
    return "".join(filter(str.isdigit, s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _ip_stands(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def spans_of(text: str) -> list[Span]:
    """Base spans and other candidates that overlap none of them nor one another, by start, then kind."""
    if not text:
        return []
    out = [Span(a, EMAIL, b, True, 1) for a, b in _emails(text)]
    digits = any(d in text for d in "0123456789")
    dropped = []
    if digits:
        for m in _IP.finditer(text):
            ok = _ip_stands(m[0])
            (out if ok else dropped).append(Span(m.start(), IP, m.end(), ok, 1 if ok else -1))
        for m in _DIGITS.finditer(text):
            n = m.end() - m.start()
            if n < 12:
                continue
            d = _numbers(m[0])
            ok = 14 <= len(d) <= 19 and luhn(d)
            if ok or 12 <= len(d) <= 19:
                (out if ok else dropped).append(Span(m.start(), CARD, m.end(), ok, 1 if 14 <= len(d) <= 19 else -1))
        if "+" in text:
            for m in _PLUS.finditer(text):
                ok = 10 <= len(_numbers(m[0])) <= 15
                (out if ok else dropped).append(Span(m.start(), PHONE, m.end(), ok, 1 if ok else -1))
    starts, ends = [], []  # of what is taken, without overlaps

    def take(a: int, b: int) -> bool:
        """Whether a .. b overlaps nothing that is taken; then it is taken too."""
        i = bisect_left(ends, a + 1)
        if i < len(starts) and starts[i] < b:
            return False
        starts.insert(i, a)
        ends.insert(i, b)
        return True

    for s in sorted(out):  # base spans of different kinds may overlap: taken as one
        if ends and s.start < ends[-1]:
            ends[-1] = max(ends[-1], s.end)
        else:
            starts.append(s.start)
            ends.append(s.end)
    more: list[Span] = []
    if digits:
        more += [Span(m.start(), IBAN, m.end(), False, 1) for m in _ACCOUNT.finditer(text)]
        more += [Span(m.start(), SSN, m.end(), False, 1) for m in _SOCIAL.finditer(text)]
        more += [Span(m.start(), PHONE, m.end(), False, 0) for m in _NATIONAL.finditer(text)]
    if "at]" in text or "at)" in text:
        more += [Span(m.start(), EMAIL, m.end(), False, 0) for m in _SPELLED.finditer(text)]
    for m in _NAMES.finditer(text):
        words, start = m[0].lower().split(), m.start()
        if len(words) == 3 and words[0] in _CUES[NAME]:  # a title is no part of the name
            start += len(words.pop(0)) + 1
        if words[0] in _GIVEN or _CUES[NAME].intersection(_WORD.findall(text[max(0, start - 16):start].lower())[-2:]):
            more.append(Span(start, NAME, m.end(), False, 0))
    out += [s for s in [*more, *dropped] if take(s.start, s.end)]
    return sorted(out)


def _checked(kind: int, s: str) -> int:
    d = _numbers(s)
    if kind == CARD:
        return 1 if luhn(d) else -1
    if kind == IBAN:
        plain = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else -1
    # rules that most strings pass speak only when they fail
    if kind == IP:
        ok = _ip_stands(s)
    elif kind == PHONE:
        ok = 7 <= len(d) <= 15
    elif kind == SSN:
        ok = d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    else:
        ok = kind != EMAIL or bool(re.search(r"(?:\.|dot[\])][ ]?)[A-Za-z]{2,24}$", s))
    return 0 if ok else -1


def _known(kind: int, s: str) -> int:
    d = _numbers(s)
    if kind == CARD:
        return 1 if d.startswith(ISSUERS) else -1
    if kind == IP:
        return -1 if s.startswith(NO_HOST) else 0
    if kind == PHONE:
        return (1 if d.startswith(tuple(CALLING)) else -1) if s[0] == "+" else 0
    if kind == EMAIL:
        return -1 if s.lower().endswith(NO_MAIL) else 0
    if kind == NAME:
        return 1 if s.lower().split()[0] in _GIVEN else 0
    return 0


def votes_of(text: str, s: Span) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 without an opinion."""
    value = text[s.start:s.end]
    words = _WORD.findall(text[max(0, s.start - BEFORE):s.start].lower())[-5:]
    context = 1 if _CUES[s.kind].intersection(words) else -1 if _AGAINST.intersection(words) else 0
    before, after = text[s.start - 1:s.start], text[s.end:s.end + 1]
    d = _numbers(value)
    glued = before.isalnum() or after.isalnum() or before in ("_", "/", "#") and before or after in ("_", "/") and after
    filler = len(d) > 6 and (len(set(d)) <= 2 or d in "01234567890123456789" or d in "98765432109876543210")
    return s.strict, _checked(s.kind, value), _known(s.kind, value), context, -1 if glued or filler else 1


def features_of(text: str, s: Span, votes: tuple[int, ...]) -> list[int]:
    """Hashed features of a span: shape, length, neighbours, and each vote."""
    value = text[s.start:s.end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[a-zß-ÿ]", "a", re.sub("[A-ZÀ-Þ]", "A", re.sub("[0-9]", "0", value))))[:24]
    words = _WORD.findall(text[max(0, s.start - BEFORE):s.start].lower())
    named = [f"shape {shape}", f"length {min(len(value), 40) // 3}", f"digits {len(_numbers(value))}",
             f"word {words[-1] if words else ''}", f"before {text[s.start - 1:s.start]}", f"after {text[s.end:s.end + 1]}",
             *(f"vote {k} {v}" for k, v in zip(LABELERS, votes) if v)]
    return [zlib.crc32(f"{KINDS[s.kind]} {f}".encode()) % FEATURES for f in named]


def _code(votes: tuple[int, ...]) -> int:
    """Votes as one number, three values each, the first labeler's the highest."""
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def _votes(code: int) -> tuple[int, ...]:
    return tuple(code // 3 ** i % 3 - 1 for i in reversed(range(len(LABELERS))))


CANDIDATES = "array<struct<start:int,kind:int,end:int,base:boolean,votes:int,features:array<int>>>"


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) per row of ``docs`` (doc_id, text): base spans and other candidates with their votes and features."""
    struct = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                        ("votes", pa.int32()), ("features", pa.list_(pa.int32()))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                row = []
                for s in spans_of(text):
                    v = votes_of(text, s)
                    row.append({"start": s.start, "kind": s.kind, "end": s.end, "base": s.base, "votes": _code(v),
                                "features": features_of(text, s, v)})
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(batches, f"doc_id long, spans {CANDIDATES}")


class Judged(NamedTuple):
    """What EM finds: P(vote | personal or not, an opinion) by labeler, the share of personal data by kind, and each pattern's probability."""
    reliability: np.ndarray  # labeler, class (0 not, 1 personal), vote + 1 (1 for no opinion)
    prior: np.ndarray  # by kind
    personal: dict[tuple[int, int], float]


def expect_maximise(counts: list[tuple[int, int, int]]) -> Judged:
    """From (kind, votes code, spans with them): labelers vote independently given whether a span is personal data.

    What fails its check digits or rules is known not to be. Starts from the majority; a labeler begins better than chance (TRUST), so the classes keep their meaning.
    """
    counts = sorted(counts)
    kind = np.array([k for k, _, _ in counts], np.int64)
    votes = np.array([_votes(c) for _, c, _ in counts], np.int64).reshape(-1, len(LABELERS))
    n = np.array([m for _, _, m in counts], np.float64)
    failed = votes[:, LABELERS.index("checks")] < 0  # known not to be what they look like
    p = np.where(failed, 0.0, 1 / (1 + np.exp(-1.0 * votes.sum(1))))
    which = np.arange(len(LABELERS))
    total, of_kind = n.sum(), np.bincount(kind, n, len(KINDS))
    right, wrong = (x * total + 1 for x in TRUST)
    start = np.array([[right, 0.0, wrong], [wrong, 0.0, right]])  # class 0 votes -1, class 1 votes 1
    for _ in range(ROUNDS):
        table = np.repeat(start[None], len(LABELERS), 0)
        for y, w in enumerate((n * (1 - p), n * p)):
            for k in which:
                table[k, y] += np.bincount(votes[:, k] + 1, w, 3)
        table[:, :, 1] = 0.0
        table /= table.sum(2, keepdims=True)
        table[:, :, 1] = 1.0  # no opinion tells nothing
        prior = (np.bincount(kind, n * p, len(KINDS)) + EVEN * of_kind / 2 + 1) / ((1 + EVEN) * of_kind + 2)
        odds = np.log(prior / (1 - prior))[kind] + (np.log(table[which, 1, votes + 1]) - np.log(table[which, 0, votes + 1])).sum(1)
        p = np.where(failed, 0.0, 1 / (1 + np.exp(-odds)))
    return Judged(table, prior, {(int(k), int(c)): float(x) for (k, c, _), x in zip(counts, p)})


def judge(found: DataFrame) -> Judged:
    """EM over the ``candidates`` of a corpus. Patterns of votes: at most kinds * 3 ** labelers rows, however many spans."""
    spans = found.select(F.explode("spans").alias("s"))
    return expect_maximise([tuple(r) for r in spans.groupBy("s.kind", "s.votes").count().collect()])


def train(found: DataFrame, judged: Judged) -> list[float]:
    """The span classifier: log-odds of each kind, then of each feature (at most so many rows reach the driver); nan if unseen."""
    spark = found.sparkSession
    table = spark.createDataFrame([(k, c, round(p * WHOLE)) for (k, c), p in sorted(judged.personal.items())],
                                  "kind int, votes int, weight long")
    spans = found.select(F.explode("spans").alias("s")).select("s.kind", "s.votes", "s.features").join(
        F.broadcast(table), ["kind", "votes"])
    # in whole numbers: the same however rows are dealt
    own = F.concat(F.array(F.col("kind") - len(KINDS)), "features")  # a kind's own count has a negative number
    sums = (spans.select("weight", F.explode(own).alias("f")).groupBy("f")
            .agg(F.sum("weight").alias("yes"), F.sum(F.lit(WHOLE) - F.col("weight")).alias("no")).collect())
    by = {r["f"]: float(np.log((r["yes"] / WHOLE + 1) / (r["no"] / WHOLE + 1))) for r in sums}
    return [by.get(k, float("nan")) for k in range(-len(KINDS), FEATURES)]


def learn(found: DataFrame) -> list[float]:
    """The span classifier's weights from the ``candidates`` of a corpus, without labels."""
    return train(found, judge(found))


def find(docs: DataFrame, sure: float = SURE, weights: list[float] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, spans), array of (start, kind, end, base, score), by start, then kind.

    ``base``: of one of the base patterns; these all stay. ``score``: the
    classifier's probability, ``sure`` or more for the other spans, which
    pass their checks and overlap no base span. ``weights``: as ``learn`` gives them, by default learned from all rows of ``docs``.
    Null or empty texts have no spans; null ids and repeated rows pass through;
    other columns are not read; an empty table gives an empty table.
    """
    found = saved(candidates(docs))
    weights = weights or learn(found)
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # KINDS and FEATURES numbers

    def scored(s: Column) -> Column:
        kind = F.nanvl(F.element_at(table, s["kind"] + 1), F.lit(0.0))
        # what each feature adds to the odds of its kind
        odds = F.aggregate(s["features"], kind, lambda acc, f: acc + F.nanvl(
            F.element_at(table, f + len(KINDS) + 1) - kind, F.lit(0.0)))
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"),
                        (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))).alias("score"))

    step = 3 ** (len(LABELERS) - 1 - LABELERS.index("checks"))
    kept = F.filter("spans", lambda s: s["base"] | (F.floor(s["votes"] / step) % 3 > 0))  # nothing else that fails its checks
    return found.select("doc_id", F.filter(F.transform(kept, scored), lambda s: s["base"] | (s["score"] >= sure)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind and the listed spans of ``find``'s rows."""
    def listed(spans: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    n = [number(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *n, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))
