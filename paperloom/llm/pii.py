"""Personal data by candidate spans and boosted trees.

Base spans follow four fixed patterns (email, ip, card, phone). High-recall generators then propose candidates of all
four kinds that the patterns miss and that may overlap one another: addresses with at and dot written out or set off, IP
addresses with dots spaced or bracketed, and stretches of loose groups of digits. Gradient-boosted trees judge each
candidate by its format and its context, their margins are calibrated by Platt's method, and a kind's threshold is the
lowest that keeps the wanted precision. What passes, likeliest first, and overlaps nothing accepted before joins the
base spans, which always stay.

The trees learn from pieces of the documents themselves, cut by the hash of their ids into a fold that fits, one that
calibrates and one on which precision and recall are measured: base matches rewritten into forms that the patterns miss
are personal; near misses and the tables' other candidates are not. The sample is bounded by ``FIT_DOCS`` documents.

Offsets count code points; ends are exclusive. Defined cases: a null or empty text has no spans and empty strings (the
digest is that of the empty string); rows repeat as they come; without a document that has an id the trees learn from
made-up sentences; other columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_strings, release, ship, text_rows

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
#: The pattern from the beginning of a run of digits on, which is where its leftmost matches begin; no run is read twice.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")


def octet(part: str) -> bool:
    """At most 255, however many zeros lead."""
    own = part.lstrip("0")
    return len(own) < 3 or (len(own) == 3 and own <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from their @ outwards: the local part is the whole run before it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then by start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(map(octet, m.group().split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


# Candidates -----------------------------------------------------------------------------------------------------

AT = re.compile(r"\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?", re.IGNORECASE)
WORDED_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\x20?[A-Za-z]{2,}+)+", re.IGNORECASE)
#: Four groups of digits with dots that may be spaced, bracketed or written out; and eight of hexadecimal digits.
ADDRESS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\)|\(dot\)|\[dot\])\x20?[0-9]{1,3}){3}(?![0-9])")
HEXADECIMAL = re.compile(r"(?<![0-9a-fA-F:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}(?![0-9a-fA-F:])")
DIGITS = re.compile(r"\(?[0-9]++\)?")
JOINT = re.compile(r"[\x20./-]{1,2}")
CONTEXT = 32

# Words before a candidate that speak for a kind.
CUES = {
    "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "téléphone", "telefon", "teléfono", "rufen", "appelez"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta", "payment"),
    "email": ("mail", "email", "e-mail", "contact", "write", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "dirección"),
}
AGAINST = ("version", "isbn", "order", "invoice", "page", "date", "year", "total", "price", "id", "no.", "section", "figure", "table")

NAMES = ("kind", "digits", "groups", "longest", "hyphens", "dots", "spaces", "slashes", "bracket", "luhn", "zero", "plus", "octets", "worded", "cue", "against", "glued", "top")


def written_addresses(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses with at and dot written out or set off, found from their at outwards."""
    for m in AT.finditer(text):
        start = m.start()
        while start and text[start - 1] in LOCAL:
            start -= 1
        end = WORDED_DOMAIN.match(text, m.end()) if start < m.start() else None
        if end:
            yield start, end.end()


def number_groups(text: str) -> Iterator[tuple[int, int]]:
    """Of every chain of groups of digits: from each group the longest stretches of at most 15 and of at most 19 digits."""
    at = 0
    while True:
        m = DIGITS.search(text, at)
        if not m:
            return
        chain = [m.span()]
        while (joint := JOINT.match(text, chain[-1][1])) and (m := DIGITS.match(text, joint.end())):
            chain.append(m.span())
        at = chain[-1][1]
        if text[chain[0][0] - 1 : chain[0][0]].isalpha() or text[at : at + 1].isalpha():
            continue  # a part of a longer token
        sizes = [sum(c.isdigit() for c in text[a:b]) for a, b in chain]
        for limit in (15, 19):
            end, total, before = 0, 0, -1
            for k in range(len(chain)):
                if end < k:
                    end, total = k, 0
                while end < len(chain) and total + sizes[end] <= limit:
                    total += sizes[end]
                    end += 1
                if total >= 7 and end > before and (limit == 15 or total > 15):
                    yield chain[k][0], chain[end - 1][1]
                    before = end
                total -= sizes[k] if end > k else 0


def candidates(text: str) -> Iterator[tuple[str, int, int, list[float]]]:
    """Kind, bounds and features; spans may overlap one another, and one span may be of two kinds."""
    if AT.search(text):
        for a, b in written_addresses(text):
            yield "email", a, b, features(text, a, b, "email")
    if DIGIT.search(text):
        for pattern in (ADDRESS, HEXADECIMAL) if text.count(":") >= 7 else (ADDRESS,):
            for m in pattern.finditer(text):
                yield "ip", *m.span(), features(text, *m.span(), "ip")
        for a, b in number_groups(text):
            n = sum(map(str.isdigit, text[a:b]))
            if n <= 15:
                yield "phone", a, b, features(text, a, b, "phone")
            if n >= 13:
                yield "card", a, b, features(text, a, b, "card")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    own, before, after = text[start:end], text[max(0, start - CONTEXT) : start].lower(), text[end : end + 2]
    parts = re.findall(r"[0-9]+", own)
    digits = "".join(parts)
    words = re.findall(r"[^\W\d_]+[.]?", before)[-4:]
    low = own.lower()
    return [
        float(KINDS.index(kind)),
        float(len(digits)),
        float(len(parts)),
        float(max(map(len, parts), default=0)),
        float(own.count("-")),
        float(own.count(".")),
        float(own.count(" ")),
        float(own.count("/")),
        float("(" in own or "[" in own or "{" in own),
        float(bool(digits) and luhn(digits)),
        float(digits.startswith("0")),
        float(before.endswith("+")),
        float(sum(map(octet, parts))),
        float((" at " in low) + 2 * ("dot" in low)),
        float(any(w.startswith(c) for w in words for c in CUES[kind])),
        float(any(w.rstrip(".") in AGAINST or w in AGAINST for w in words)),
        float((before[-1:].isalnum()) + 2 * after[:1].isalnum()),
        float(len(re.split(r"[^a-z]+", low)[-1])) if kind == "email" else 0.0,
    ]


class Boosted:
    """Gradient boosting of regression trees of depth three under logistic loss, with second-order leaf values."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.3, depth: int = 3):
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 17), method="lower"))[:-1] for k in range(x.shape[1])]
        self.trees: list = []
        f = np.zeros(len(y))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, p - y, p * (1 - p), np.arange(len(y)), depth, rate)
            self.trees.append(tree)
            f += self._apply(tree, x)
        self.slope, self.offset = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        #: Precision and recall on the fold that neither fits nor calibrates, by kind.
        self.measured: dict[str, tuple[float, float]] = {}

    def _grow(self, x, g, h, rows, depth, rate):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) > 8:
            own_g, own_h = g[rows], h[rows]
            for k, cuts in enumerate(self.cuts):
                own = x[rows, k]
                for cut in cuts:
                    low = own <= cut
                    gl, hl, n = own_g[low].sum(), own_h[low].sum(), int(low.sum())
                    gain = gl * gl / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                    if gain > best[0] and 4 <= n <= len(rows) - 4:
                        best = (gain, (k, cut, low))
        if best[1] is None:
            return float(-rate * total_g / (total_h + 1))
        k, cut, low = best[1]
        return k, float(cut), self._grow(x, g, h, rows[low], depth - 1, rate), self._grow(x, g, h, rows[~low], depth - 1, rate)

    def _apply(self, tree, x):
        return np.array([self._walk(tree, r) for r in x.tolist()])

    @staticmethod
    def _walk(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def margin(self, row) -> float:
        return sum(self._walk(t, row) for t in self.trees)

    def probability(self, row) -> float:
        z = self.slope * self.margin(row) + self.offset
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))

    def calibrate(self, x, y, kinds, precision: float) -> None:
        """Platt's method on the margin; then the threshold of each kind, halfway between the last positive up to which
        the precision holds and what comes after it."""
        z = np.array([self.margin(r) for r in x.tolist()])
        a, b = 1.0, 0.0
        low, high = (y.sum() and 1 / (len(y) - y.sum() + 2)), (y.sum() + 1) / (y.sum() + 2)
        aim = np.where(y > 0, high, low)  # Platt's targets, which keep separable classes from running off
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
            v = p * (1 - p) + 1e-9
            g = np.array([((p - aim) * z).sum() + 1e-3 * (a - 1), (p - aim).sum()])
            h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum()]])
            a, b = np.array([a, b]) - np.clip(np.linalg.solve(h, g), -2, 2)
        self.slope, self.offset = float(a), float(b)
        p = np.array([self.probability(r) for r in x.tolist()])
        for kind in set(kinds):
            own = np.array([k == kind for k in kinds])
            order = np.argsort(-p[own], kind="stable")
            sorted_y, sorted_p = y[own][order], np.append(p[own][order], 0.0)
            right = np.cumsum(sorted_y) / np.arange(1, len(order) + 1)
            # Ties stay together: a cut may only come where the probability falls.
            good = np.flatnonzero((right >= precision) & (sorted_y > 0) & (sorted_p[:-1] > sorted_p[1:]))
            self.thresholds[kind] = float(sorted_p[good[-1]] + sorted_p[good[-1] + 1]) / 2 if len(good) else 1.1

    def measure(self, x, y, kinds) -> None:
        found = np.array([self.probability(r) >= self.thresholds.get(k, 1.1) for r, k in zip(x.tolist(), kinds, strict=True)], bool)
        for kind in set(kinds):
            own = np.array([k == kind for k in kinds])
            hits = float((found & (y > 0) & own).sum())
            self.measured[kind] = (hits / max(1.0, float((found & own).sum())), hits / max(1.0, float(((y > 0) & own).sum())))


# Training rows --------------------------------------------------------------------------------------------------

#: Bounds of the fit: documents that are sampled by the hash of their ids, pieces taken from each, characters of a piece.
FIT_DOCS = 3_000
PIECES_PER_DOC = 6
PIECE_CHARS = 64
FIT, CALIBRATE, MEASURE = 0, 1, 2
FILLER = "alor bente cunda dore elvi fanto gira hols inde jorva".split()

Piece = tuple[int, str, str, str, str]  # fold, kind (none: a candidate that no base pattern takes), before, own, after


def pieces_of(text: str, fold: int) -> Iterator[Piece]:
    """Base spans and other candidates of a text with what stands around them."""
    base = base_spans(text)
    spans = [("", *s) for s in base]
    taken = merged_bounds(base)
    spans += [("none-", k, a, b) for k, a, b, _ in candidates(text) if not overlaps(taken, a, b)]
    counts: dict[str, int] = {}
    for mark, kind, a, b in spans:
        name = mark + kind
        counts[name] = counts.get(name, 0) + 1
        if b - a <= PIECE_CHARS and counts[name] <= PIECES_PER_DOC:
            yield fold, name, text[max(0, a - PIECE_CHARS) : a], text[a:b], text[b : b + PIECE_CHARS // 4]


def value(kind: str, r: random.Random) -> str:
    """A personal value as the base patterns know it."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    if kind == "email":
        return f"{r.choice(FILLER)}{digits(r.randint(0, 2))}@{r.choice(FILLER)}.{r.choice(('com', 'org', 'net', 'example'))}"
    if kind == "ip":
        return ".".join(str(r.randint(1, 254)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + digits(14)
        return next(body + d for d in "0123456789" if luhn(body + d))
    return f"+{r.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"


def perturbed(kind: str, own: str, r: random.Random) -> str:
    """The value in a form that the base patterns don't take."""
    digits = "".join(DIGIT.findall(own))
    if kind == "email":
        local, _, host = own.partition("@")
        at, dot = r.choice(((" at ", " dot "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" (at) ", "."), (" @ ", " dot ")))
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return own.replace(".", r.choice((" . ", "[.]", "(.)", "[dot]", "(dot)", ". ")))
    if kind == "card":
        return r.choice(".////")[:1].join(digits[k : k + 4] for k in range(0, len(digits), 4)) if r.random() < 0.8 else "  ".join(digits[k : k + 4] for k in range(0, len(digits), 4))
    d = digits[-10:].rjust(10, "5")
    return r.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"0{d[:3]} {d[3:6]} {d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"0{d[:2]}/{d[2:9]}", f"0{d[0]} {d[1:3]} {d[3:5]} {d[5:7]} {d[7:9]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"))


def near_miss(kind: str, r: random.Random) -> str:
    """What looks like the kind and isn't."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    if kind == "email":
        return f"{r.choice(FILLER)} at {r.choice(FILLER)}{r.choice(('. ', ' . ', '.'))}{r.choice(FILLER).capitalize()}"
    if kind == "ip":
        parts = [str(r.randint(0, 999)) for _ in range(4)]
        parts[r.randrange(4)] = str(r.randint(256, 999))
        return r.choice((". ", " . ", "[.]")).join(parts)
    if kind == "card":
        body = digits(16)
        body = body if not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)
        return r.choice((body, ".".join(body[k : k + 4] for k in range(0, 16, 4)), "/".join(body[k : k + 4] for k in range(0, 16, 4)), digits(13)))
    return r.choice((f"{r.randint(1900, 2030)}-{digits(2)}-{digits(2)}", digits(r.randint(7, 15)), f"{digits(2)}.{digits(2)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(3)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(3)}-{digits(4)}", f"{digits(4)}.{digits(4)}"))


def training_rows(pieces: list[Piece], fold: int, n: int):
    """Features, labels and kinds: personal values from the pieces (or made up) in forms that the base patterns miss, set
    into the pieces' own surroundings, against near misses and the pieces that no base pattern takes."""
    r = random.Random(97 + fold)
    own = [p for p in pieces if p[0] == fold]
    around = [(p[2], p[4]) for p in own] or [(" ".join(r.choices(FILLER, k=4)) + " ", " " + " ".join(r.choices(FILLER, k=3))) for _ in range(40)]
    x, y, kinds = [], [], []

    def add(kind: str, before: str, middle: str, after: str, personal: bool) -> None:
        text = before + middle + after
        for k, a, b, row in candidates(text):
            if k == kind and a < len(before) + len(middle) and b > len(before):
                x.append(row)
                y.append(float(personal and (a, b) == (len(before), len(before) + len(middle))))
                kinds.append(kind)

    for kind in KINDS:
        values = [p[3] for p in own if p[1] == kind]
        for _ in range(n):
            before, after = r.choice(around)
            before = (before.rstrip("+") if before.endswith((" ", "\n")) else before + " ")
            after = after if not after[:1].isalnum() else " " + after
            cue = r.choice(CUES[kind]) + r.choice((" ", ": ", " number "))
            if r.random() < 0.4:
                good = perturbed(kind, r.choice(values) if values and r.random() < 0.5 else value(kind, r), r)
                lead = cue if r.random() < 0.75 or (kind == "email" and " at " in good) else ""
                add(kind, before + lead, good, after, True)
            elif r.random() < 0.3 and kind != "email":
                add(kind, before + r.choice(AGAINST) + " ", perturbed(kind, value(kind, r), r), after, False)
            else:
                add(kind, before + (r.choice(AGAINST) + " " if r.random() < 0.4 else ""), near_miss(kind, r), after, False)
    for _, name, before, middle, after in own:
        if name.startswith("none-"):
            add(name[5:], before, middle, after, False)
    return np.array(x), np.array(y), kinds


def fitted(pieces: list[Piece], n: int = 500, precision: float = 0.985) -> Boosted:
    """Trees from the pieces of the first fold, calibrated on the second's, measured on the third's."""
    x, y, _ = training_rows(pieces, FIT, n)
    m = Boosted(x, y)
    m.calibrate(*training_rows(pieces, CALIBRATE, n), precision)
    m.measure(*training_rows(pieces, MEASURE, n))
    return m


@lru_cache(maxsize=1)
def model() -> Boosted:
    """The judge where there are no documents to learn from: all values and surroundings are made up."""
    return fitted([])


def learn(docs: DataFrame, max_docs: int = FIT_DOCS) -> Boosted:
    """The judge fitted on pieces of at most about ``max_docs`` documents, which are taken by the hash of their ids."""
    rows = text_rows(docs).filter("doc_id IS NOT NULL")
    n = rows.count()
    if not n:
        return model()
    ship(docs.sparkSession)
    share = int(2**31 * min(1.0, max_docs / n))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share).withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % 3)

    def harvest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [p for text, fold in zip(arrow_strings(batch, "text"), batch.column("fold").to_pylist(), strict=True) for p in pieces_of(text, fold)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64())] + [pa.array([p[k] for p in found], pa.string()) for k in range(1, 5)], names=["fold", "kind", "before", "own", "after"])

    # PIECES_PER_DOC short pieces of each kind and sampled document at most.
    found = sample.select("text", "fold").mapInArrow(harvest, "fold long, kind string, before string, own string, after string").toArrow().to_pylist()
    return fitted(sorted((p["fold"], p["kind"], p["before"], p["own"], p["after"]) for p in found))


# Selection ------------------------------------------------------------------------------------------------------


def merged_bounds(spans) -> list[tuple[int, int]]:
    """Disjoint stretches in order that the spans (kind, start, end) cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(s[-2:] for s in spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def overlaps(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    k = bisect_left(taken, (b,))  # the first that starts at b or after it
    return k > 0 and taken[k - 1][1] > a


def added_spans(text: str, base: list[Span], judge: Boosted) -> list[Span]:
    """Candidates that the trees accept, likeliest first, where they overlap neither base spans nor one another."""
    taken = merged_bounds(base)
    passed = []
    for kind, a, b, row in candidates(text):
        if not overlaps(taken, a, b):
            p = judge.probability(row)
            if p >= judge.thresholds.get(kind, 1.1):
                passed.append((-p, a, b, kind))
    out = []
    for _, a, b, kind in sorted(passed):
        if not overlaps(taken, a, b):
            out.append((kind, a, b))
            insort(taken, (a, b))
    return out


def find(text: str, judge: Boosted) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by kind as listed and then by start."""
    base = base_spans(text)
    added = added_spans(text, base, judge)
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if added else base


def written(spans: list[Span]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


def scan(docs: DataFrame, judge: Boosted | None = None) -> DataFrame:
    """doc_id, counts by kind, the base spans' digest and all spans of every document; one pass, no shuffle. Without a
    judge one is learned from the documents."""
    ship(docs.sparkSession)
    judge = judge or learn(docs)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in arrow_strings(batch, "text"):
                base, every = find(text, judge)
                counts.append([sum(s[0] == k for s in base) for k in KINDS])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(every))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return text_rows(docs).mapInArrow(found, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(text: str, judge: Boosted) -> str:
    """The text with every span, overlapping ones together, replaced by the name of its first kind."""
    out, at = [], 0
    spans = sorted(find(text, judge)[1], key=lambda s: (s[1], -s[2]))
    k = 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, text: str = "text", judge: Boosted | None = None) -> DataFrame:
    """Every row and column, with the personal data in the text replaced; a null text stays null. Without a judge one is
    learned from the documents."""
    ship(docs.sparkSession)
    judge = judge or learn(docs)

    @F.pandas_udf("string")
    def clean(s):
        release()
        return s.map(lambda t: None if t is None else redacted(t, judge))

    return docs.withColumn(text, clean(F.col(text)))
