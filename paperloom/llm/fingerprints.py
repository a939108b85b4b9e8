"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, the runs between ASCII white space, as 64-bit hashes; their weights are their
counts. For every term and each of ``SAMPLES`` coordinates, r and c are drawn from Gamma(2, 1), in 65,536 equally likely steps,
and beta uniformly, all by hash; with t = floor(ln w / r + beta) the sampled key is the term with the least ln c - r (t - beta) - r, and the
coordinate keeps 16 bits of a hash of (term, t). Two coordinates agree with a
probability equal to the generalised Jaccard similarity of the weighted terms (plus 2^-16).

Defined cases: a null or empty text, or one of white space only, has the fingerprint of zeros; two of those are alike
by 1.0, and one of them and any other by 0.0. Equal texts have equal fingerprints on any executor. Rows with equal
doc_ids follow one another by text; a null doc_id comes last. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import held, no_cycles, ship, text_rows

SAMPLES = 128
#: Ranges are dealt out by hash; with several for each task the load evens out.
RANGES_PER_TASK = 8
#: Rows (term and weight) whose draws a worker remembers; all are given up when the table is full.
CACHE_ROWS = 240_000
#: Words that a worker numbers; all are given up when there are more.
MAX_WORDS = 400_000
#: A text of more words is signed without the tables.
MANY_WORDS = MAX_WORDS // 8
#: Rows drawn in one go, so few that the processor's cache holds what comes between.
DRAWN_AT_ONCE = 128
#: Documents whose new words are drawn together.
GROUP = 16
EMPTY = "0" * (4 * SAMPLES)

U32, U64 = np.uint32, np.uint64
#: Places in the tables of the gamma distribution: as many equally likely values, each the middle of its share.
LEVELS = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A finaliser of 32 bits; works in place."""
    x ^= x >> U32(16)
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def _gamma_levels() -> np.ndarray:
    """Quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) e^-x, by Newton's method on its logarithm."""
    tail = 1 - (np.arange(LEVELS) + 0.5) / LEVELS
    x = -np.log(tail) + np.log1p(-np.log(tail))
    for _ in range(60):
        x = np.maximum(x - (np.log1p(x) - x - np.log(tail)) / (1 / (1 + x) - 1), x / 4)
    return x


STEPS = (np.arange(1, SAMPLES + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) >> U64(32)).astype(U32)
_GAMMA = _gamma_levels()
R, LN_C = _GAMMA.astype(np.float32), np.log(_GAMMA).astype(np.float32)
#: Numbers to be minimised are kept as 16 bits, in steps of 1/2048 from -24 on, above the 16 bits of their code.
LOWEST, PER_STEP = np.float32(-24), np.float32(2048)


def draws(terms: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """For every (term, weight) and coordinate ln c - r (t - beta) - r, which is to be minimised, in its 16 bits, and below
    them the code of (term, t), so that the least number brings its code along and equal ones go by it, in whatever text
    they meet. None: all weights are 1."""
    low, high = terms.astype(U32), (terms >> U64(32)).astype(U32)
    one = _mix(low[:, None] ^ STEPS)
    two = _mix(one + high[:, None])
    least, r = LN_C.take(two & U32(0xFFFF)), R.take(one >> U32(16))
    two >>= U32(16)
    beta = two.astype(np.float32)
    beta += np.float32(0.5)
    beta *= np.float32(2.0**-16)
    code = _mix(low ^ high * U32(0x85EBCA6B))[:, None]
    if weights is not None:
        t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + beta)
        code = code + t.astype(U32) * U32(40503)
        beta -= t
    beta -= np.float32(1)  # with weight 1, t is 0
    beta *= r
    least += beta
    least -= LOWEST
    least *= PER_STEP
    out = np.clip(least, np.float32(0), np.float32(65535), out=least).astype(U32)
    out <<= U32(16)
    out |= code & U32(0xFFFF)
    return out


class Reading:
    """A text's words as numbers, which hold for one epoch of the sampler's word list, and its signature."""

    def __init__(self, text: str):
        self.text, self.words = text, text.encode().split()
        self.many = len(self.words) > MANY_WORDS
        self.ids, self.epoch, self.pairs = None, -1, None
        self.signed, self.signature = False, None


class Sampler:
    """Signatures. Words are numbered, and the draws of recent (word, count) pairs remembered, in bounded tables."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.epoch = 0
        self.terms = np.empty(MAX_WORDS, U64)
        self.once = np.full(MAX_WORDS, -1, np.int32)  # the row of each word that occurs once
        self.often: dict[tuple[int, int], int] = {}  # the row of each (word, count) beyond that
        self.table = np.empty((CACHE_ROWS, SAMPLES), U32)
        self.used = 0
        self.piece = np.empty((256, SAMPLES), U32)

    def _ids(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.numbers.get, words))
        if None in found:
            new = {w for w, f in zip(words, found, strict=True) if f is None}
            if len(self.numbers) + len(new) > MAX_WORDS:
                self.numbers.clear()
                self.epoch += 1
                self._forget()
                return self._ids(words)
            at = len(self.numbers)
            self.terms[at : at + len(new)] = list(map(xxhash.xxh64_intdigest, new))
            self.numbers.update(zip(new, range(at, at + len(new)), strict=True))
            found = list(map(self.numbers.get, words))
        return np.array(found, np.int64)

    def _forget(self) -> None:
        self.once.fill(-1)
        self.often.clear()
        self.used = 0

    def read(self, readings: list[Reading]) -> None:
        """Number the words of texts and draw for all their new pairs at once; together they have few words against
        ``MAX_WORDS``, so that the second round at most finds a list that holds them all."""
        small = [r for r in readings if not r.many]
        while any(r.epoch != self.epoch for r in small):
            for r in small:
                if r.epoch != self.epoch:
                    r.ids = self._ids(r.words)
                    r.pairs = np.unique(r.ids, return_counts=True)
                    r.epoch = self.epoch
        if small:
            words, counts = (np.concatenate(x) for x in zip(*(r.pairs for r in small), strict=True))
            self._rows(words, counts)

    def _rows(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The rows of (word, count) pairs in the table, in any order; new ones are drawn."""
        if self.used + len(words) > CACHE_ROWS:
            self._forget()
        single = words[counts == 1]
        new = np.unique(single[self.once[single] < 0])
        if len(new):
            self.once[new] = self._drawn(new, None)
        rows = self.once[single]
        if len(single) < len(words):
            pairs = list(zip(words[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True))
            found = list(map(self.often.get, pairs))
            if None in found:
                fresh = list({p for p, f in zip(pairs, found, strict=True) if f is None})
                self.often.update(zip(fresh, self._drawn(*(np.array(x, np.int64) for x in zip(*fresh, strict=True))).tolist(), strict=True))
                found = list(map(self.often.get, pairs))
            rows = np.concatenate([rows, np.array(found, np.int32)])
        return rows

    def _drawn(self, ids: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
        """The rows of new pairs."""
        at = self.used
        self.used += len(ids)
        for k in range(0, len(ids), DRAWN_AT_ONCE):
            part = slice(k, k + DRAWN_AT_ONCE)
            found = draws(self.terms[ids[part]], None if counts is None else counts[part])
            self.table[at + k : at + k + len(found)] = found
        return np.arange(at, self.used, dtype=np.int32)

    def of_pairs(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
        rows = self._rows(words, counts)
        best = None
        for at in range(0, len(rows), len(self.piece)):
            part = rows[at : at + len(self.piece)]
            least = self.table.take(part, axis=0, out=self.piece[: len(part)], mode="clip").min(axis=0)
            best = least if best is None else np.minimum(best, least)
        return None if best is None else _codes(best)

    def of(self, r: Reading) -> np.ndarray | None:
        if not r.signed:
            r.signature, r.signed = self.of_many(r.words) if r.many else self.of_pairs(*r.pairs), True
        return r.signature

    def signature(self, text: str) -> np.ndarray | None:
        r = Reading(text)
        self.read([r])
        return self.of(r)

    @staticmethod
    def of_many(words: list[bytes]) -> np.ndarray:
        """Of so many words that the tables wouldn't hold them: nothing is remembered."""
        counts = Counter(words)
        terms = np.fromiter(map(xxhash.xxh64_intdigest, counts), U64, len(counts))
        weights = np.fromiter(counts.values(), np.int64, len(counts))
        best = np.full(SAMPLES, 0xFFFFFFFF, U32)
        for k in range(0, len(terms), DRAWN_AT_ONCE):
            best = np.minimum(best, draws(terms[k : k + DRAWN_AT_ONCE], weights[k : k + DRAWN_AT_ONCE]).min(axis=0))
        return _codes(best)

    def edited(self, own: Reading, following: Reading) -> tuple[str, np.ndarray | None]:
        """The edited text and its signature. All its words but those at the seam and at the end are the two texts' own."""
        changed = edited(own.text, following.text)
        n = len(own.text) // 2
        head, tail = own.text[: len(own.text) - n].encode(), following.text[:n].encode()
        a, b = head.split(), tail.split()
        if own.many or following.many:
            return changed, self.signature(changed)
        joined = a and b and not head[-1:].isspace() and not tail[:1].isspace()
        seam = [a[-1] + b[0]] if joined else a[-1:] + b[:1]
        loose = seam + b[1:][-1:]
        while True:
            parts = [own.ids[: max(0, len(a) - 1)], following.ids[1 : max(1, len(b) - 1)], self._ids(loose)]
            if own.epoch == following.epoch == self.epoch:
                return changed, self.of_pairs(*np.unique(np.concatenate(parts), return_counts=True))
            self.read([own, following])


def _codes(best: np.ndarray) -> np.ndarray:
    return best.astype(np.uint16)  # the lower half


def hexed(signature: np.ndarray | None) -> str:
    return EMPTY if signature is None else signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last half of the code points, rounded down, replaced by the first as many of the following text."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


class Pairing:
    """Result rows of documents and their next, what was read of a next one being kept for its own row."""

    def __init__(self):
        self.sampler = Sampler()
        self.kept: Reading | None = None

    def rows(self, items: Iterable[tuple]) -> Iterator[tuple]:
        """Of (key, text, following text), in groups that are read together."""
        group, size = [], 0
        for item in items:
            n = len(item[1]) + len(item[2])  # a word has a character and a space
            if group and (len(group) >= GROUP or size + n > MAX_WORDS // 2):
                yield from self._rows(group)
                group, size = [], 0
            group.append(item)
            size += n
        if group:
            yield from self._rows(group)

    def _rows(self, group: list[tuple]) -> list[tuple]:
        pairs = []
        for key, text, following in group:
            own = self.kept if self.kept is not None and self.kept.text is text else Reading(text)
            self.kept = Reading(following)
            pairs.append((key, own, self.kept))
        self.sampler.read([r for _, own, after in pairs for r in (own, after)])
        return [self._row(*p) for p in pairs]

    def _row(self, key, own: Reading, following: Reading) -> tuple:
        changed, near = self.sampler.edited(own, following)
        self.sampler.read([own, following])  # if the word list was given up meanwhile
        sig, after = self.sampler.of(own), self.sampler.of(following)
        return key, len(own.text), hashlib.sha256(changed.encode()).hexdigest(), hexed(sig), hexed(near), likeness(sig, near), likeness(sig, after)


def pairing() -> Pairing:
    pair = held("fingerprints", Pairing)
    pair.kept = None
    return pair


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _schema(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], key_type) -> pa.RecordBatch:
    kinds = (key_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=list(FIELDS))


def with_next(docs: DataFrame) -> DataFrame:
    """The fingerprint of every document and of its text edited with the next one's.

    The order by descending doc_id is cut into ranges at quantiles of the ids, a few for each shuffle partition;
    texts are shuffled once, and rows are paired within a range as they stream by. Only the first and the last text of
    each range are paired across ranges, which is a number of rows that depends on the partitions alone.
    """
    spark = docs.sparkSession
    ship(spark)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = tasks * RANGES_PER_TASK
    rows = text_rows(docs)
    bounds = sorted(set(rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # Ids descend from one range to the next; nulls come last.
        return pd.Series(len(bounds) - np.searchsorted(np.array(bounds, np.float64), ids.fillna(-np.inf).to_numpy(np.float64), side="right"))

    dealt = rows.withColumn("part", range_of(F.col("doc_id").cast("double")))
    dealt = dealt.repartition(tasks, "part").sortWithinPartitions("part", F.col("doc_id").desc_nulls_last(), "text")
    key = docs.schema["doc_id"].dataType.simpleString()

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            pair, kind, out = pairing(), None, []

            def pairs():
                nonlocal kind
                before = None
                for batch in batches:
                    kind = batch.schema.field("doc_id").type
                    for part, doc, text in zip(batch.column("part"), batch.column("doc_id"), batch.column("text"), strict=True):
                        now = (part.as_py(), doc.as_py(), text.as_py())
                        if before and before[0] == now[0]:
                            yield before[1], before[2], now[2]
                        before = now

            for row in pair.rows(pairs()):
                out.append(row)
                if len(out) >= 2048:
                    yield _batch(out, kind)
                    out = []
            if out:
                yield _batch(out, kind)

    # The ranges that have rows, a few for each shuffle partition, in order; after the last comes the first again.
    own_parts = sorted(r.part for r in rows.select(range_of(F.col("doc_id").cast("double")).alias("part")).distinct().collect())
    before_part = dict(zip(own_parts, own_parts[-1:] + own_parts[:-1], strict=True))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each range its last row, and its first text for the last row of the range before it."""
        last = None

        def made(pair: int, side: int, row) -> pa.RecordBatch:
            _, batch, k = row
            return pa.RecordBatch.from_arrays([pa.array([pair], pa.int32()), pa.array([side], pa.int32()), batch.column("doc_id").slice(k, 1), batch.column("text").slice(k, 1)], names=["pair", "side", "doc_id", "text"])

        for batch in batches:
            for k, part in enumerate(batch.column("part").to_pylist()):
                row = (part, batch, k)
                if last is None or last[0] != part:
                    if last is not None:
                        yield made(last[0], 1, last)
                    yield made(before_part[part], 0, row)
                last = row
        if last is not None:
            yield made(last[0], 1, last)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, first = pairing(), None
        for batch in batches:
            for side, doc, text in zip(batch.column("side").to_pylist(), batch.column("doc_id"), batch.column("text"), strict=True):
                if side == 0:
                    first = text.as_py()
                else:
                    yield _batch(list(pair.rows([(doc.as_py(), text.as_py(), first)])), batch.schema.field("doc_id").type)

    edges = dealt.mapInArrow(ends, f"pair int, side int, doc_id {key}, text string").repartition(tasks, "pair").sortWithinPartitions("pair", "side")
    return dealt.mapInArrow(inner, _schema(docs)).unionByName(edges.mapInArrow(across, _schema(docs)))
