"""Personal data in texts: emails, IP addresses, card and phone numbers, by boosted trees over candidates.

Generators of high recall propose spans, which may overlap: what the base rules match, spelt-out and bracketed addresses, addresses with letters
outside of ASCII, defanged and IPv6 addresses, and every run of numbers that could be a card or a phone, whole and in
groups of its parts. Boosted trees, fitted by Spark's library, score each candidate by its format (lengths, groups, separators, checksum, octets, top
domain, shapes of dates and times) and its context (the characters beside it, words near it). Scores become probabilities by
a logistic fit on findings that the trees have not seen, and each kind's threshold is the least probability at which those
findings are right to PRECISION. Above it the most probable candidates that overlap nothing chosen before are selected. What the base
rules match stays in any case; a selected span may only overlap it if it is of its kind and holds all of it.

The findings are FINDINGS sentences from templates with a fixed seed, for no table labels personal data; they do not depend on the
data, so the trees are fitted once in a Python process. Templates of the held-out share are the same, their numbers and words are not.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Texts are read whole, in time linear in
their length; a worker holds one batch of texts and its candidates. Repeated rows are judged alike, an empty table gives no rows. `find` reads
key and text alone, so nothing clashes but the key's own name; `redact` keeps all columns.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, no_clash, table, texts

KINDS = ("email", "ip", "card", "phone")
FINDINGS, HELD_OUT, TREES, DEPTH, PRECISION, SLICE = 6000, 3, 30, 5, 0.95, 4096
Span = tuple[str, int, int]

# base rules (fixed by the contract)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")  # a run of digits matches from its first digit or not at all
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or (len(short) == 3 and short <= "255")


def _emails(text: str):
    """Each @ that a domain follows, with the local part before it as far as the match before."""
    at, free = text.find("@"), 0
    while at >= 0:
        if (m := _DOMAIN.match(text, at + 1)) and at > free and text[at - 1] in _LOCAL:
            start = at - 1
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def raw_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """What the base patterns match, and whether the match passes the base tests."""
    out = [("email", a, b, True) for a, b in _emails(text)]
    out += [("ip", *m.span(), all(map(octet, m[0].split(".")))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        n = digits_of(m[0]) if m.end() - m.start() < 40 else ""  # 19 digits have at most 18 marks between them
        out.append(("card", *m.span(), 12 <= len(n) <= 19 and luhn(n)))
    if "+" in text:
        out += [("phone", *m.span(), 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15) for m in _PHONE.finditer(text)]
    return out


# generators
_AT = (" at ", " AT ", "[at]", "[AT]", "(at)", "(AT)", "{at}", "<at>", "(@)", "[@]", "＠")
_LEFT = re.compile(r"[\w.%+-]{1,64}\s?\Z")
_RIGHT = re.compile(r"\s?[\w-]{1,63}(?:(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?| dot | DOT |\.)[\w-]{1,63}){1,5}")
_WIDE_LEFT, _WIDE_RIGHT = re.compile(r"[\w.%+-]{1,64}\Z"), re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63}){0,5}")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?| dot | \. |\.)[0-9]{1,3}){3}(?![0-9])")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")
_HEX_LEFT, _HEX_RIGHT = re.compile(r"[0-9A-Fa-f:]{0,45}\Z"), re.compile(r"[0-9A-Fa-f:]{0,45}")
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[ ().\-/_– ]{0,3}[0-9])++")
_PARTS = re.compile(r"[^  ]+")
MOST_PARTS = 6


def proposals(text: str) -> list[Span]:
    """Candidates of all generators; those of the base patterns that failed their tests are among them."""
    found: set[Span] = {(k, a, b) for k, a, b, _ in raw_spans(text) if b - a <= 320}
    for mark in _AT:
        at = text.find(mark)
        while at >= 0:
            left, right = _LEFT.search(text[max(0, at - 65) : at]), _RIGHT.match(text, at + len(mark))
            if left and right:
                found.add(("email", at - len(left[0]), right.end()))
            at = text.find(mark, at + 1)
    at = text.find("@")
    while at >= 0:
        left, right = _WIDE_LEFT.search(text[max(0, at - 64) : at]), _WIDE_RIGHT.match(text, at + 1)
        if left and right:
            found.add(("email", at - len(left[0]), right.end()))
        at = text.find("@", at + 1)
    found.update(("ip", *m.span()) for m in _DEFANGED.finditer(text))
    end = 0
    for m in _COLONS.finditer(text):
        if m.start() >= end:
            low = m.start() - len(_HEX_LEFT.search(text[max(0, m.start() - 45) : m.start()])[0])
            end = _HEX_RIGHT.match(text, m.start()).end()
            found.add(("ip", low, end))
    for m in _NUMBER.finditer(text):
        pieces = [(m.start() + p.start(), m.start() + p.end()) for p in _PARTS.finditer(m[0])]
        for i in range(len(pieces)):
            for j in range(i, min(len(pieces), i + MOST_PARTS)):
                a, b = pieces[i][0], pieces[j][1]
                if b - a > 64:
                    break
                n = sum("0" <= c <= "9" for c in text[a:b])
                if 12 <= n <= 19:
                    found.add(("card", a, b))
                if 7 <= n <= 15:
                    found.add(("phone", a, b))
                    if text[a] == "(" and ")" not in text[a:b]:
                        found.add(("phone", a + 1, b))
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


#: Words near a value, by what they speak for (fixed lists in four languages).
CONTEXT = {
    "email": "email e-mail mail contact correo courriel mailto write adresse",
    "ip": "ip server host address from ping client login adresse serveur servidor node",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment pay paid",
    "phone": "phone tel call mobile fax cell telefon telefono telephone ring sms whatsapp anruf llame appelez",
    "other": "version v release order invoice isbn date number no id ref serial build page price total time code chapter row mac section figure hash commit",
}
_NEAR = {k: re.compile(rf"(?<![^\W_])(?:{'|'.join(map(re.escape, v.split()))})(?![^\W_])", re.I) for k, v in CONTEXT.items()}
_DATE = re.compile(r"(?:19|20)[0-9]{2}[-/.](?:0?[1-9]|1[0-2])[-/.][0-9]{1,2}(?![0-9])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:19|20)[0-9]{2}(?![0-9])")
_TIME = re.compile(r"(?<![0-9])(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9])?\Z")
_MAC = re.compile(r"(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}\Z")
_SEPARATORS = re.compile(r"[^0-9A-Za-z\u0080-￿]+")
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info biz co us ch at it nl be".split())
FEATURES = [
    *(f"is_{k}" for k in KINDS), "length", "digits", "letters", "separators", "kinds_of_separators", "plus", "bracket", "luhn", "first_digit", "zero", "groups", "longest", "shortest", "fours", "three_three_four",
    "octets", "date", "time", "mac", "at_sign", "spelt_at", "spelt_dot", "domain", "last_label", "colons", "double_colon", "hex_letters", "touches_before", "touches_after", "mark_before", "digit_near",
    *(f"before_{k}" for k in CONTEXT), *(f"after_{k}" for k in CONTEXT),
]


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 40) : a], text[b : b + 24]
    digits, low = digits_of(s), s.lower()
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    marks = _SEPARATORS.findall(s)
    labels = re.findall(r"[^\W_]+", low)
    spelt_at = bool(re.search(r"[\[({<]\s?(?:at|@)\s?[\])}>]| at |＠", low))
    spelt_dot = bool(re.search(r"[\[({]\s?(?:dot|\.)\s?[\])}]| dot ", low))
    left, right = text[a - 1 : a] if a else " ", text[b : b + 1] or " "
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), sum(c.isalpha() for c in s) / max(1, len(s)), len(marks), len(set(marks)), s.startswith("+"), "(" in s, len(digits) >= 12 and luhn(digits), int(digits[0]) if digits else -1, digits.startswith("0"), len(groups), max(sizes), min(sizes), sizes in ([4] * 4, [4, 6, 5], [4, 6, 4]), sizes[-3:] == [3, 3, 4],
        len(groups) == 4 and all(map(octet, groups)), bool(_DATE.search(s)), bool(_TIME.match(s)), bool(_MAC.match(s)), "@" in s, spelt_at, spelt_dot, bool(labels) and labels[-1] in TOP_DOMAINS, len(labels[-1]) if labels else 0, s.count(":"), "::" in s, bool(re.search("[a-fA-F]", s)), left.isalnum() or left in "_", right.isalnum() or right in "_", left in "#$€£%@/=.-:+", bool(re.match("[ .:,-]?[0-9]", after) or re.search("[0-9][ .:,-]?$", before)),
        *(bool(p.search(before)) for p in _NEAR.values()), *(bool(p.search(after)) for p in _NEAR.values()),
    ]


# labelled findings
def _number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, n: int = 16) -> str:
    start = rng.choice(["4", "51", "37", "6011"]) + _number(rng, n)
    start = start[: n - 1]
    return start + next(str(d) for d in range(10) if luhn(start + str(d)))


def sentence(rng: random.Random) -> tuple[str, Span | None]:
    """A text with one piece of personal data and its span, or with something like it."""
    pick = rng.choice
    # invented words, as in corpora of any language
    word = lambda: "".join(pick(["ta", "ren", "o", "mi", "sch", "ele", "ing", "är", "ció", "qu", "th", "er", "be"]) for _ in range(rng.randint(1, 3)))
    name, host, top = word().strip() + pick(["", ".", "_"]) + word(), word() + pick(["", "mail", "-net"]), pick(["com", "org", "net", "de", "fr", "es", "co.uk"])
    ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
    dot, sep = pick(["[.]", "(.)", " [dot] ", "[dot]", " dot "]), pick([".", " ", "-", "–", "  ", "_"])
    area, mid, line = str(rng.randint(200, 999)), str(rng.randint(200, 999)), _number(rng, 4)
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    v6 = ":".join(hexes(4) for _ in range(8)) if rng.random() < 0.5 else "2001:db8::" + hexes(4) + pick(["", ":" + hexes(3)])
    four = lambda n: sep.join(n[i : i + 4] for i in range(0, len(n), 4))
    near, away = lambda k: pick(CONTEXT[k].split()) + pick([": ", " ", " is ", "="]), pick(["", "the ", "and ", "of ", word() + " "])
    bad = _card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
    good: list[tuple[str, str, str]] = [
        ("email", f"{name}@{host}.{top}", pick([near("email"), away])), ("email", f"{name} [at] {host} [dot] {top}", away), ("email", f"{name}(at){host}.{top}", pick([near("email"), away])), ("email", f"{name} at {host} dot {top}", pick([near("email"), away])), ("email", f"{name}[at]{host}{dot}{top}", away), ("email", f"jürg.{word()}ß@{host}.{top}", away),
        ("ip", ip, pick([near("ip"), away])), ("ip", ip.replace(".", dot), pick([near("ip"), away])), ("ip", v6, pick([near("ip"), away])),
        ("card", _card(rng), pick([near("card"), away])), ("card", four(_card(rng)), pick([near("card"), away])),
        ("phone", f"+1 ({area}) {mid}-{line}", away), ("phone", f"({area}) {mid}-{line}", pick([near("phone"), away])), ("phone", f"{area}-{mid}-{line}", pick([near("phone"), near("phone"), away])), ("phone", f"00{rng.randint(30, 99)} {rng.randint(10, 999)} {_number(rng, 6)}", pick([near("phone"), away])),
        ("phone", f"0{rng.randint(10, 999)}/{_number(rng, 6)}", near("phone")), ("phone", f"{area}.{mid}.{line}", near("phone")), ("phone", area + mid + line, near("phone")),
    ]
    odd = [
        f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}:{rng.randint(0, 59):02}", f"20{rng.randint(10, 29)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.20{rng.randint(10, 29)}", f"20{rng.randint(10, 29)}/{rng.randint(1, 12):02}/{rng.randint(1, 28):02} {rng.randint(10, 23)}:00", bad, four(bad), hexes(40), hexes(32), hexes(8) + "-" + hexes(4) + "-" + hexes(4),
        near("other") + _number(rng, rng.randint(7, 15)), near("other") + f"978-{_number(rng, 1)}-{_number(rng, 4)}-{_number(rng, 4)}-{_number(rng, 1)}", near("other") + f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(256, 9999)}", f"{rng.randint(300, 999)}.{rng.randint(256, 999)}.{rng.randint(1, 999)}.{rng.randint(1, 999)}",
        f"{rng.randint(1, 999)}.{rng.randint(100, 999)}.{rng.randint(100, 999)}", f"{rng.randint(1, 99)} {_number(rng, 3)} {_number(rng, 3)}", f"{rng.randint(1, 9)}.{_number(rng, 9)}", ":".join(hexes(2) for _ in range(6)), f"look at {host}.{top}", f"meet at {host} and", f"@{name}", f"{word()} @{host}", f"see {host} at {_number(rng, 2)}.{_number(rng, 2)}", _number(rng, rng.randint(7, 24)), " ".join(_number(rng, rng.randint(1, 4)) for _ in range(6)),
        f"{_number(rng, 4)}-{_number(rng, 4)}", f"{rng.randint(1, 9)}:{rng.randint(1, 9)}:{rng.randint(1, 9)}", "::", f"std::{word()}", f"{word()} at {word()}, {word()}", _number(rng, 5) + " " + _number(rng, 5), f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)} {rng.randint(1900, 2030)}",
    ]
    lead, tail = " ".join(word() for _ in range(rng.randint(0, 6))), pick(["", " ", ". ", ", ", "\n", "### ", "!! "]) + " ".join(word() for _ in range(rng.randint(0, 4)))
    tail = tail if not tail or not tail[0].isalnum() else " " + tail
    lead = lead + pick([" ", "\n", ", ", "&&& "]) if lead else ""
    if rng.random() < 0.5:
        kind, value, introduced = pick(good)
        return lead + introduced + value + tail, (kind, len(lead + introduced), len(lead + introduced + value))
    return lead + pick([away, ""]) + pick(odd) + tail, None


def labelled_findings(n: int = FINDINGS, seed: int = 11) -> list[tuple[int, str, float, list[float]]]:
    """(sentence, kind, label, features) of every candidate in n sentences: label 1 for the span that was put there."""
    rng, out = random.Random(seed), []
    for i in range(n):
        text, want = sentence(rng)
        out += [(i, s[0], float(s == want), [float(x) for x in features(text, s)]) for s in proposals(text)]
    return out


@dataclass(frozen=True)
class Judge:
    """Boosted trees as arrays of complete trees, with the logistic fit and the thresholds of each kind."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    scale: dict[str, tuple[float, float]]
    least: dict[str, float]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while at.size and at[0] < len(f):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - len(f)]
        return out

    def probabilities(self, kinds: list[str], x: np.ndarray) -> np.ndarray:
        a, b = np.array([self.scale[k] for k in kinds]).reshape(-1, 2).T
        return 1 / (1 + np.exp(-np.clip(a * self.margins(x) + b, -40, 40)))


def _complete(root, depth: int) -> tuple[list[int], list[float], list[float]]:
    """A tree's splits in breadth-first order, as if all its leaves lay at `depth`, and the leaves' values."""
    level, feature, threshold = [root], [], []
    for _ in range(depth):
        below = []
        for node in level:
            leaf = node.numDescendants() == 0
            feature.append(0 if leaf else node.split().featureIndex())
            threshold.append(float("inf") if leaf else float(node.split().threshold()))
            below += [node, node] if leaf else [node.leftChild(), node.rightChild()]
        level = below
    return feature, threshold, [float(node.prediction()) for node in level]


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic fit by Newton's steps, with a small penalty."""
    w, z = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w = w - np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (p - y) + 0.1 * w)
    return float(w[0]), float(w[1])


def fit(spark: SparkSession, findings: list[tuple[int, str, float, list[float]]], trees: int = TREES, depth: int = DEPTH, precision: float = PRECISION) -> Judge:
    """Trees from two thirds of the sentences; scales and thresholds from the rest."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.linalg import Vectors

    rows = [(label, Vectors.dense(x)) for i, _, label, x in findings if i % HELD_OUT]
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=3, maxBins=64).fit(spark.createDataFrame(rows, ["label", "features"]).coalesce(1))
    parts = [_complete(t._java_obj.rootNode(), depth) for t in model.trees]
    weights = np.array(model.treeWeights)
    judge = Judge(np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), np.array([p[2] for p in parts]) * weights[:, None], {}, {})
    for kind in KINDS:
        own = [(label, x) for i, k, label, x in findings if k == kind and i % HELD_OUT == 0]
        y, m = np.array([r[0] for r in own]), judge.margins(np.array([r[1] for r in own]))
        judge.scale[kind] = _logistic(m, y)
        p = judge.probabilities([kind] * len(own), np.array([r[1] for r in own]))
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        able = np.flatnonzero(right >= precision)
        judge.least[kind] = max(0.5, float(p[order][able[-1]])) if len(able) else 1.1
    return judge


@lru_cache(maxsize=1)
def default_judge() -> Judge:
    return fit(SparkSession.active(), labelled_findings())


class _Intervals:
    """Intervals that don't overlap each other, by start."""

    def __init__(self, rows: list[tuple[int, int]] = ()) -> None:
        self.rows = sorted(rows)

    def overlapping(self, a: int, b: int) -> list[tuple[int, int]]:
        i = bisect_left(self.rows, (a,))
        low = i - 1 if i and self.rows[i - 1][1] > a else i
        return self.rows[low : bisect_left(self.rows, (b,))]

    def add(self, a: int, b: int) -> None:
        insort(self.rows, (a, b))


def select(base: list[Span], scored: list[tuple[Span, float]]) -> list[tuple[str, int, int, bool, float]]:
    """Base spans, and of the scored ones the most probable that overlap nothing but smaller base spans of their kind."""
    kept, known, chosen = [(*s, True, 1.0) for s in base], set(base), _Intervals()
    fixed = {k: _Intervals([(a, b) for x, a, b in base if x == k]) for k in KINDS}
    for (kind, a, b), p in sorted(scored, key=lambda x: (-x[1], x[0][1], -x[0][2], KINDS.index(x[0][0]))):
        if (kind, a, b) in known or chosen.overlapping(a, b) or any(k != kind or x < a or y > b for k in KINDS for x, y in fixed[k].overlapping(a, b)):
            continue
        chosen.add(a, b)
        kept.append((kind, a, b, False, p))
    return sorted(kept, key=lambda r: (r[1], KINDS.index(r[0]), r[2]))


def spans_of(bodies: list[str], judge: Judge) -> list[list[tuple[str, int, int, bool, float]]]:
    """The selected spans of each text; candidates of all texts are scored together, SLICE at a time."""
    base = [[(k, a, b) for k, a, b, passed in raw_spans(t) if passed] for t in bodies]
    scored: list[list[tuple[Span, float]]] = [[] for _ in bodies]
    each = ((i, s) for i, t in enumerate(bodies) for s in proposals(t))
    while part := list(islice(each, SLICE)):
        p = judge.probabilities([s[0] for _, s in part], np.array([features(bodies[i], s) for i, s in part], dtype=float))
        for (i, s), x in zip(part, p.tolist(), strict=True):
            if x >= judge.least[s[0]]:
                scored[i].append((s, x))
    return [select(b, c) for b, c in zip(base, scored, strict=True)]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", judge: Judge | None = None) -> DataFrame:
    """(key, spans): each row's spans (kind, from, to, base, score), by start and then by kind."""
    no_clash(key, "spans")
    own = docs.sparkSession.sparkContext.broadcast(judge or default_judge())  # a few hundred splits
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            found = spans_of(batch.column(1).to_pylist(), own.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "from", "to", "base", "score"), s, strict=True)) for s in row] for row in found], _SPANS)], names=[key, "spans"])

    return arrow_map(texts(docs, key, text=text), run, f"`{key}` {kind}, spans array<struct<kind:string,`from`:bigint,`to`:bigint,base:boolean,score:double>>")


def masked(text: str, spans: list[tuple]) -> str:
    """The text with a mark like [EMAIL] for each span; spans that overlap get one mark, the first's."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, b = spans[i][:3]
        while i + 1 < len(spans) and spans[i + 1][1] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", judge: Judge | None = None) -> DataFrame:
    """docs with its spans masked in the text column; null stays null, all other columns are as they were."""
    own = docs.sparkSession.sparkContext.broadcast(judge or default_judge())
    place = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            bodies = batch.column(place).to_pylist()
            found = spans_of([t or "" for t in bodies], own.value)
            yield batch.set_column(place, batch.schema.field(place), pa.array([t if t is None else masked(t, s) for t, s in zip(bodies, found, strict=True)], batch.schema.field(place).type))

    return arrow_map(docs, run, docs.schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
