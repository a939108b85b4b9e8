"""Toxicity by a linear classifier that is regularised with counterfactuals.

Features are the distinct words (runs of letters, lower case) of a text and their beginnings of four and five letters,
which catch inflected forms. Logistic loss on labelled documents, an L1
penalty, and a counterfactual penalty: in every labelled sentence that has an identity term the term is swapped for the
others of its group, and the squared change of the sentence's score is penalised, so that a neutral mention of a group
moves no score. A linear score changes by the difference of the two terms' weights, whatever else the sentence holds.

The classifier is fitted on at most ``MAX_FIT_ROWS`` labelled rows, those whose ids hash lowest, with at most
``MAX_FEATURES`` words; scoring reads every text whole, in one pass without a shuffle.

Defined cases: a null or empty text has the score of the intercept alone; without labelled rows every score is 0.5
below the threshold's side (0.0); null labels are left out; of several labels of a document the highest counts;
rows repeat as they come; columns other than the id, the text and the label are never read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_strings, held_out, no_cycles, release, ship, text_rows

#: Bounds of the fit.
MAX_FIT_ROWS = 6_000
MAX_FEATURES = 2_000
MIN_DOCS = 4
L1 = 0.001
RIDGE = 0.5
#: Weight of a toxic example against one that isn't, for the classes are far from even.
POSITIVE_WEIGHT = 2.0
COUNTERFACTUAL = 4.0
ROUNDS = 160
THRESHOLD = 0.5
PREFIXES = (4, 5)

# Groups of identity terms that may stand for one another.
IDENTITY_GROUPS = (
    ("woman", "man", "girl", "boy", "transgender"),
    ("women", "men", "girls", "boys"),
    ("female", "male", "nonbinary"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    ("black", "white", "asian", "hispanic", "latino", "african", "european", "arab", "indian"),
    ("deaf", "blind", "disabled", "autistic", "paralysed"),
    ("old", "young", "elderly", "teenage"),
    ("immigrant", "refugee", "foreigner", "citizen", "native"),
    ("femme", "homme", "fille", "garçon"),
    ("musulman", "chrétien", "juif", "athée"),
    ("frau", "mann", "mädchen", "junge"),
    ("muslimisch", "christlich", "jüdisch", "atheistisch"),
    ("mujer", "hombre", "niña", "niño"),
    ("musulmán", "cristiano", "judío", "ateo"),
)
GROUP_OF = {t: g for g in IDENTITY_GROUPS for t in g}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[^.!?\n]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(distinct: set[str]) -> set[str]:
    """Words, and the beginnings of longer ones, which ``^`` marks."""
    return distinct.union([f"^{w[:n]}" for n in PREFIXES for w in distinct if len(w) > n])


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -50.0

    def score(self, text: str) -> float:
        z = self.bias + sum(map(self.weights.__getitem__, sorted(self.weights.keys() & features(set(words(text))))))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def fit(rows: list[tuple[int, list[str], list[str]]], counterfactual: float = COUNTERFACTUAL) -> Model:
    """``rows``: label, distinct words, and one identity term for each sentence and term that has it."""
    if not rows:
        return Model()
    y = np.array([r[0] for r in rows], np.float32)
    docs, toxic = Counter(), Counter()
    rows = [(label, sorted(features(set(own))), terms) for label, own, terms in rows]
    for label, own, _ in rows:
        docs.update(own)
        if label:
            toxic.update(own)
    share = float(y.mean())
    gap = {w: abs(toxic[w] - n * share) / math.sqrt(n) for w, n in docs.items() if n >= MIN_DOCS}
    chosen = sorted(gap, key=lambda w: (-gap[w], w))[:MAX_FEATURES]
    swaps = Counter((a, b) for _, _, terms in rows for a in terms for b in GROUP_OF[a] if b != a)
    at = {w: k for k, w in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, (_, own, _) in enumerate(rows):
        x[i, [at[w] for w in own if w in at]] = 1
    # What a swap changes: the features of the one term against those of the other, weighted by how often it can occur.
    change, times = [], []
    for (a, b), n in sorted(swaps.items()):
        row = np.zeros(len(chosen), np.float32)
        for term, sign in ((a, 1), (b, -1)):
            for w in features({term}) & at.keys():
                row[at[w]] += sign
        if row.any():
            change.append(row)
            times.append(n * counterfactual / len(rows))
    d = np.array(change, np.float32).reshape(len(change), len(chosen))
    times = np.array(times, np.float32)

    def slope(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-(x @ w + b)))
        return x.T @ (p - y) / len(y) + 2 * d.T @ (times * (d @ w)), float((p - y).mean())

    # Accelerated proximal steps; the step follows from the largest curvature that the data allow.
    v = np.ones(x.shape[1], np.float32)
    for _ in range(8):
        v = x.T @ (x @ v)
        v /= max(1e-9, float(np.linalg.norm(v)))
    curvature = 0.25 * (float(np.linalg.norm(x @ v)) ** 2 / len(y) + 1) + 2 * float((times * (d * d).sum(axis=1)).sum())
    step = 1 / max(curvature, 1e-6)
    w, b = np.zeros(x.shape[1], np.float32), math.log((share + 1e-4) / (1 - share + 1e-4))
    ahead, ahead_b, t = w, b, 1.0
    for _ in range(ROUNDS):
        g, gb = slope(ahead, ahead_b)
        new = ahead - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = ahead_b - step * gb
        grown = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_b = new + (t - 1) / grown * (new - w), new_b + (t - 1) / grown * (new_b - b)
        w, b, t = new, new_b, grown
    # What remains is fitted once more by Newton's method without the L1 penalty's shrinking, under a light ridge.
    kept = np.flatnonzero(w)
    if len(kept):
        x1 = np.concatenate([x[:, kept], np.ones((len(y), 1), np.float32)], 1).astype(np.float64)
        weight = np.where(y > 0, POSITIVE_WEIGHT, 1.0)
        ridge = np.append(np.full(len(kept), RIDGE), 0.0)
        wide = np.concatenate([d[:, kept], np.zeros((len(d), 1), np.float32)], 1).astype(np.float64)
        swap = 2 * len(y) * (wide * times[:, None]).T @ wide
        theta = np.append(w[kept].astype(np.float64), b)
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x1 @ theta, -30, 30)))
            g = x1.T @ (weight * (p - y)) + ridge * theta + swap @ theta
            h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + np.diag(ridge + 1e-6) + swap
            move = np.linalg.solve(h, g)
            theta -= move * min(1.0, 4 / max(1e-9, float(np.abs(move).max())))
        w, b = theta[:-1], float(theta[-1])
    else:
        w = w[kept]
    return Model({chosen[int(k)]: float(x) for k, x in zip(kept, w, strict=True) if x}, float(b))


def learn(docs: DataFrame, labels: DataFrame, exclude: tuple[int, int] | None = (5, 0), max_rows: int = MAX_FIT_ROWS) -> Model:
    """Fit on the labelled documents outside the held-out fold (buckets, remainder)."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if exclude:
        known = known.filter(~held_out("doc_id", *exclude))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    ship(docs.sparkSession)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            own, terms = [], []
            for text in arrow_strings(batch, "text"):
                distinct = set(words(text))
                own.append(" ".join(sorted(distinct)))
                terms.append(" ".join(w for s in SENTENCE.findall(text) for w in sorted(set(words(s)) & GROUP_OF.keys())) if distinct & GROUP_OF.keys() else "")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(own, pa.string()), pa.array(terms, pa.string())], names=["doc_id", "toxic", "words", "terms"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic {labels.schema['toxic'].dataType.simpleString()}, words string, terms string"
    # The broadcast side has max_rows rows at most.
    found = text_rows(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(gather, kinds).toArrow().to_pylist()
    found.sort(key=lambda r: (r["doc_id"], r["words"]))
    return fit([(int(r["toxic"] > 0), r["words"].split(), r["terms"].split()) for r in found])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every document."""
    ship(docs.sparkSession)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            release()
            for batch in batches:
                found = [model.score(t) for t in arrow_strings(batch, "text")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64()), pa.array([int(s >= THRESHOLD) for s in found], pa.int32())], names=["doc_id", "score", "predicted"])

    return text_rows(docs).mapInArrow(scores, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores below the threshold."""
    ship(docs.sparkSession)

    @F.pandas_udf("boolean")
    def clean(s):
        release()
        return s.map(lambda t: model.score(t or "") < THRESHOLD)

    return docs.filter(clean(F.col(text)))
