"""Removal of long repeated byte strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too, in the same document or another.

Sparse suffixes: of the 169 places in a window of 200 bytes at which 32 bytes can start, the one whose hash is least
(leftmost on ties) is the window's anchor. Equal windows have equal anchors at equal places, so consecutive windows
with one anchor, a *stretch*, are all that has to meet: stretches meet by their anchors' hash.

1. Stretches (one for about 85 bytes) are listed with their anchor's and their own hash. Anchors that occur once are
   dropped. A stretch whose bytes occur twice is a repeat as a whole and needs no more work.
2. Anchors with different stretches are settled on bytes, one copy of each different stretch. Within a partition by
   anchor, every batch gets a suffix array of its window starts; it is scanned against the arrays of the levels there
   are, then becomes a level, and levels of like size merge, as in the logarithmic method. Arrays are sorted by
   Karp-Miller-Rosenberg names of the windows' 200 bytes, which are formed by doubling and have one meaning in every
   batch; that order, unlike the alphabet's, can be compared across batches without the texts, and equal windows are
   neighbours in it all the same. Neighbours are compared byte by byte before they count. Windows of different anchors
   never meet, so from ``INDEX_WINDOWS`` on the arrays begin anew with the next anchor.
3. An anchor with more than ``HOT_STRETCHES`` different stretches doesn't go to one task: its windows' names are counted
   with partial sums instead.
4. The repeats come back to their documents, where overlapping ones are joined and cut out.

Lists of stretches are kept in the shared folder; a text is shuffled once. Defined cases: null or empty texts and those
under 200 bytes stay as they are; repeated rows are each other's copies; a null doc_id is a key like any other; other
columns are ignored. Texts of any length are taken in pieces that overlap by 199 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, ship, text_rows

LENGTH = 200
SEED = 32
PLACES = LENGTH - SEED + 1
HOT_STRETCHES = 50_000
#: Bytes that are handled together, of one document or several.
CHUNK = 1 << 19
#: Bytes of texts in a batch that a Python worker returns.
OUT_BYTES = 8 * CHUNK
#: Window starts in a new level.
BATCH_WINDOWS = 1 << 19
#: Window starts in a task's arrays from which on they begin anew with the next anchor.
INDEX_WINDOWS = 1 << 21

U64 = np.uint64
_RANDOM = np.random.RandomState(20240229).randint(0, 2**63 - 1, 300, dtype=np.int64).astype(U64)
_BYTE = _RANDOM[:256] * U64(2) + U64(1)
_STEP = _RANDOM[256:272] * U64(2) + U64(1)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 32 bytes and of the 200 bytes that start at each place that has them."""
    h, size = _BYTE[data], 1
    seed = np.empty(0, U64)
    for k in range(7):
        if len(h) <= size:
            return seed, np.empty(0, U64)
        h = h[:-size] * _STEP[k] + h[size:]
        size *= 2
        if size == SEED:
            h = _scramble(h)
            seed = h
    rest = LENGTH - size
    return seed, _scramble(h[:-rest] * _STEP[8] + h[rest:]) if len(h) > rest else np.empty(0, U64)


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    size, out = 1, keys
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: anchor, own hash, first window and number of windows of each stretch."""
    seed, whole = names(data)
    if not len(whole):
        return (np.empty(0, U64),) * 2 + (np.empty(0, np.int64),) * 2
    place = np.arange(len(seed), dtype=U64)
    least = window_minima((seed & ~U64(0xFFFFFF)) | place, PLACES)[: len(whole)]
    first = np.arange(len(whole))
    inside = ends[np.searchsorted(ends, first, side="right")] - first >= LENGTH
    starts = np.flatnonzero(inside & np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1]]))
    stops = np.flatnonzero(inside & np.concatenate([(least[1:] != least[:-1]) | ~inside[1:], [True]])) + 1
    anchor = seed[(least[starts] & U64(0xFFFFFF)).astype(np.int64)]
    own = _scramble(whole[starts] * _STEP[9] + whole[stops - 1] * _STEP[10] + (stops - starts).astype(U64))
    return anchor, own, starts, stops - starts


def pieces(texts) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Chunks of texts laid end to end, and where each piece lies: text number, place in the text, place in the chunk."""
    where, parts, size = [], [], 0
    for k, data in texts:
        if len(data) < LENGTH:
            continue
        at = 0
        while True:
            part = data[at : at + CHUNK]
            where.append((k, at, size))
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield where, np.frombuffer(b"".join(parts), np.uint8)
                where, parts, size = [], [], 0
            if at + len(part) >= len(data):
                break
            at += len(part) - LENGTH + 1
    if parts:
        yield where, np.frombuffer(b"".join(parts), np.uint8)


def listed(rows: DataFrame) -> DataFrame:
    """All stretches of (row, text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column("row").to_numpy(zero_copy_only=False))
            texts = ((k, t.as_py().encode()) for k, t in enumerate(batch.column("text")))
            for where, data in pieces(texts):
                number, base, offset = (np.array(x, np.int64) for x in zip(*where, strict=True))
                ends = np.append(offset[1:], len(data))
                anchor, own, start, n = stretches(data, ends)
                piece = np.searchsorted(ends, start, side="right")
                arrays = [anchor.view(np.int64), own.view(np.int64), keys[number[piece]], base[piece] + start - offset[piece], n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["anchor", "own", "row", "start", "n"])

    return rows.mapInArrow(scan, "anchor long, own long, row long, start long, n int")


class SuffixLevels:
    """Suffix arrays of geometrically growing size over the windows of stretches, and which windows occur twice.

    Numbers have 32 bits: there are INDEX_WINDOWS, a batch and the windows of HOT_STRETCHES at most."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # names in order, and the windows' numbers
        self.data = bytearray()
        self.place = np.empty(0, np.int32)  # of each window in data
        self.twice = np.empty(0, bool)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether windows are the same bytes."""
        flat = np.frombuffer(self.data, np.uint8)
        out = np.empty(len(a), bool)
        span = np.arange(LENGTH)
        for at in range(0, len(a), 1 << 14):
            x, y = self.place[a[at : at + (1 << 14)]], self.place[b[at : at + (1 << 14)]]
            out[at : at + len(x)] = (flat[x[:, None] + span] == flat[y[:, None] + span]).all(axis=1)
        del flat
        return out

    def _neighbours(self, order: tuple[np.ndarray, np.ndarray]) -> None:
        name, number = order
        same = np.flatnonzero(name[1:] == name[:-1])
        a, b = number[same], number[same + 1]
        good = self._equal(a, b)
        self.twice[a[good]] = self.twice[b[good]] = True

    def add(self, batch: list[bytes]) -> None:
        """The windows of a batch of stretches, numbered in order."""
        flat = np.frombuffer(b"".join(batch), np.uint8)
        sizes = np.array([len(x) for x in batch])
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        counts = sizes - LENGTH + 1
        local = np.repeat(begin - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        name = names(flat)[1][local]
        base = len(self.place)
        self.place = np.append(self.place, (local + len(self.data)).astype(np.int32))
        self.twice = np.append(self.twice, np.zeros(len(local), bool))
        self.data += flat.tobytes()
        order = np.argsort(name, kind="stable")
        new = (name[order], (order + base).astype(np.int32))
        self._neighbours(new)
        for level in self.levels:
            at = np.searchsorted(level[0], new[0])
            hit = np.flatnonzero((at < len(level[0])) & (level[0][np.minimum(at, len(level[0]) - 1)] == new[0]))
            a, b = new[1][hit], level[1][at[hit]]
            good = self._equal(a, b)
            self.twice[a[good]] = self.twice[b[good]] = True
        self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (x, i), (y, j) = new, self.levels[-2]
            del self.levels[-2:]
            both, numbers = np.concatenate([y, x]), np.concatenate([j, i])
            del x, y, i, j, new
            merged = np.argsort(both, kind="stable")
            both = both[merged]
            new = both, numbers[merged]
            del both, numbers, merged
            self.levels.append(new)


def twice_in(contexts: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Of different stretches (anchor, own, data) with those of an anchor together: ranges of window numbers that occur twice.

    Windows meet only those of their own anchor, so the arrays begin anew between two anchors once they are large."""

    def ranges() -> pa.RecordBatch:
        if waiting:
            index.add(waiting)
        first = np.concatenate([[0], np.cumsum(counts)])
        edge = np.zeros(len(index.twice) + 1, bool)
        edge[first] = True
        twice = index.twice
        before = np.concatenate([[False], twice[:-1]])
        after = np.concatenate([twice[1:], [False]])
        low = np.flatnonzero(twice & (~before | edge[:-1]))
        high = np.flatnonzero(twice & (~after | edge[1:])) + 1
        owner = np.searchsorted(first, low, side="right") - 1
        found = [np.array([keys[k][0] for k in owner], np.int64), np.array([keys[k][1] for k in owner], np.int64), (low - first[owner]).astype(np.int32), (high - first[owner]).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=["anchor", "own", "low", "high"])

    index, keys, counts, waiting, windows = SuffixLevels(), [], [], [], 0
    for anchor, own, data in contexts:
        if keys and anchor != keys[-1][0] and len(index.twice) + windows >= INDEX_WINDOWS:
            yield ranges()
            index, keys, counts, waiting, windows = SuffixLevels(), [], [], [], 0
        waiting.append(data)
        keys.append((anchor, own))
        counts.append(len(data) - LENGTH + 1)
        windows += counts[-1]
        if windows >= BATCH_WINDOWS:
            index.add(waiting)
            waiting, windows = [], 0
    if keys:
        yield ranges()


def settled(contexts: DataFrame) -> DataFrame:
    """Of different stretches (anchor, own, data), dealt out by anchor: ranges of window numbers that occur twice."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ((b.column("anchor").to_numpy(), b.column("own").to_numpy(), b.column("data")) for b in batches)
        yield from twice_in((anchor, own, data.as_py()) for c in columns for anchor, own, data in zip(*c, strict=True))

    together = contexts.select("anchor", "own", "data").sortWithinPartitions("anchor")
    return together.mapInArrow(settle, "anchor long, own long, low int, high int")


def counted(contexts: DataFrame) -> DataFrame:
    """The same for hot anchors, window by window: names are summed up before the shuffle, so no task gets a group."""

    def window_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, own, data in zip(batch.column("anchor").to_numpy(), batch.column("own").to_numpy(), batch.column("data"), strict=True):
                name = names(np.frombuffer(data.as_py(), np.uint8))[1]
                n = len(name)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, anchor)), pa.array(np.full(n, own)), pa.array(np.arange(n, dtype=np.int32)), pa.array(name.view(np.int64))], names=["anchor", "own", "low", "name"])

    windows = contexts.select("anchor", "own", "data").mapInArrow(window_names, "anchor long, own long, low int, name long")
    twice = windows.groupBy("anchor", "name").agg(F.count("*").alias("times")).filter("times > 1").select("anchor", "name")
    return windows.join(twice, ["anchor", "name"], "left_semi").select("anchor", "own", "low", (F.col("low") + 1).alias("high"))


def stretch_bytes(rows) -> Iterator[pa.RecordBatch]:
    """anchor, own and data of the stretches that are wanted of each (text, wanted). Stretches overlap, so that their
    bytes are several times the texts'; batches have OUT_BYTES and a stretch at most."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(owns, pa.int64()), pa.array(parts, pa.binary())], names=["anchor", "own", "data"])

    anchors, owns, parts, size = [], [], [], 0
    for text, wanted in rows:
        data = text.as_py().encode()
        for anchor, own, start, n in zip(*(wanted.values.field(x).to_numpy() for x in ("anchor", "own", "start", "n")), strict=True):
            anchors.append(anchor)
            owns.append(own)
            parts.append(data[start : start + n + LENGTH - 1])
            size += len(parts[-1])
            if size >= OUT_BYTES:
                yield batch()
                anchors, owns, parts, size = [], [], [], 0
    yield batch()


def repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """row and the array of its repeats' (from, to) in bytes, of (row, text); they may overlap."""
    every = scratch.keep(listed(rows), "stretches")
    anchors = every.groupBy("anchor").agg(F.count("*").alias("times"), F.min("own").alias("least"), F.max("own").alias("most"))
    anchors = anchors.filter("times > 1").select("anchor", (F.col("least") != F.col("most")).alias("mixed"))
    again = scratch.keep(every.join(anchors, "anchor"), "repeated")
    scratch.drop("stretches")
    copies = again.filter("mixed").groupBy("anchor", "own").agg(F.count("*").alias("times"), F.first("row").alias("row"), F.first("start").alias("start"), F.first("n").alias("n"))
    copies = scratch.keep(copies, "copies")
    widths = copies.groupBy("anchor").agg(F.count("*").alias("different"))
    hot = scratch.keep(widths.filter(F.col("different") > HOT_STRETCHES).select("anchor"), "hot")  # few: each has that many stretches

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from stretch_bytes(zip(batch.column("text"), batch.column("wanted"), strict=True))

    wanted = copies.groupBy("row").agg(F.collect_list(F.struct("anchor", "own", "start", "n")).alias("wanted"))
    contexts = rows.join(wanted, "row").select("text", "wanted").mapInArrow(cut, "anchor long, own long, data binary")
    if hot.limit(1).count():
        contexts = scratch.keep(contexts, "contexts")
        partly = settled(contexts.join(hot, "anchor", "left_anti").repartition("anchor")).unionByName(counted(contexts.join(hot, "anchor", "left_semi")))
    else:
        partly = settled(contexts.repartition("anchor"))
    # A stretch that occurs twice is a repeat as a whole; so is every one of an anchor that has but one.
    once = again.join(copies.filter("times = 1").select("anchor", "own"), ["anchor", "own"], "left_semi")
    whole = again.join(copies.filter("times = 1").select("anchor", "own"), ["anchor", "own"], "left_anti")
    spans = whole.select("row", F.col("start").alias("from"), (F.col("start") + F.col("n") + (LENGTH - 1)).alias("to"))
    spans = spans.unionByName(once.join(partly, ["anchor", "own"]).select("row", (F.col("start") + F.col("low")).alias("from"), (F.col("start") + F.col("high") + (LENGTH - 1)).alias("to")))
    return spans.groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one run."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, spans): digests and the bytes that are kept; batches have OUT_BYTES and a text at most."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    out, size, done = [], 0, 0
    for k, (text, spans) in enumerate(zip(batch.column("text"), batch.column("spans"), strict=True), 1):
        data, at, kept = text.as_py().encode(), 0, []
        runs = merged([(s["from"], s["to"]) for s in spans.as_py() or ()])
        for a, b in runs:
            kept.append(data[at:a])
            at = b
        rest = b"".join([*kept, data[at:]])
        out.append((len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
        size += len(rest)
        if size >= OUT_BYTES or k == len(batch):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(out)), *(pa.array([o[i] for o in out], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            out, size, done = [], 0, k


def without_repeats(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes that are kept, of every document."""
    ship(docs.sparkSession)
    scratch = scratch or Scratch(docs.sparkSession, "suffix")
    rows = text_rows(docs).withColumn("row", F.xxhash64("doc_id", "text", F.sha2("text", 256)))
    found = repeats(rows.filter(F.octet_length("text") >= LENGTH).select("row", "text"), scratch)
    joined = rows.join(found, "row", "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from without(batch)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
