"""Language by cross-parsing entropy.

For each language a suffix automaton is built over labelled running text. A text is parsed into the longest phrases that
the automaton holds, across words and spaces; the language that needs the fewest phrases for its automaton's size, in
estimated bits a byte, wins. Equal languages go by name. Texts, labelled or not, are read as their runs of letters in
lower case with one space around each, in UTF-8, so that an alphabet of any size has few symbols.

The automata are fitted on a bounded sample: of about ``DOCS_PER_LANG`` labelled documents of each language, taken by the
hash of their ids, one piece of at most ``PIECE_CHARS`` characters each. Prediction parses every text whole, in one pass
without a shuffle; its time grows with the text and with the number of languages.

Defined cases: a null text or one without a letter is ``und`` with score 0.0, as is every text if no language was
learned; rows without a language teach nothing; rows repeat as they come; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import held, held_out, no_cycles, ship

#: Bounds of the fit.
DOCS_PER_LANG = 40
PIECE_CHARS = 1_500
#: No phrase crosses the end of a block of so many bytes, which lets the blocks of a long text be parsed in step.
BLOCK = 4_096
#: Bytes of the texts that are parsed together.
AT_ONCE = 2_000_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def running(text: str | None) -> bytes:
    """The runs of letters in lower case, a space around each, in UTF-8; empty without a letter."""
    words = WORD.findall((text or "").lower())
    return f" {' '.join(words)} ".encode() if any(w.isalpha() or any(map(str.isalpha, w)) for w in words) else b""


class SuffixAutomaton:
    """All substrings of a byte string, with one transition a byte; states are numbers, the first is 0."""

    def __init__(self, data: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in data:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.size = max(2, len(data))

    def phrases(self, data: bytes) -> int:
        """How many longest matches, or single unknown bytes, the data fall into."""
        state, n = -1, 0
        for c in data:
            state = self.next[state].get(c, -1) if state >= 0 else -1
            if state < 0:
                n += 1
                state = self.next[0].get(c, -1)
        return n


#: Set in the table of transitions where a new phrase begins.
FRESH = 1 << 30


class Parser:
    """The automata of all languages as one table of transitions, through which many texts go in step.

    The table has a row for each state and a column for each byte value that occurs; a cell holds the place of the next
    state's row, and where the automaton has no transition that of the state in which a new phrase begins, marked so.
    """

    def __init__(self, pieces: dict[str, list[str]]):
        self.langs = sorted(pieces)
        joined = [b"\n".join(map(running, pieces[x])) for x in self.langs]  # no phrase crosses a piece's end
        used = sorted(set(b"".join(joined)))
        width = len(used) + 1
        self.code = np.full(256, width - 1, np.uint8)  # the last column is that of unknown bytes
        self.code[used] = np.arange(len(used))
        self.bits = np.array([math.log2(max(2, len(x))) for x in joined])
        tables, nowhere, at = [], [], 0
        for data in joined:
            states = SuffixAutomaton(data).next
            end = len(states)  # a state without transitions, in which every text begins
            default = np.full(width, at + end, np.int64)
            for c, to in states[0].items():
                default[self.code[c]] = at + to
            table = np.broadcast_to(default * width | FRESH, (end + 1, width)).astype(np.int32)
            row = np.repeat(np.arange(end), [len(x) for x in states])
            table[row, self.code[[c for x in states for c in x]]] = (np.array([to for x in states for to in x.values()]) + at) * width
            if (at + end + 1) * width >= FRESH:
                raise ValueError("the sample is too large for one table of transitions")
            tables.append(table.ravel())
            nowhere.append((at + end) * width)
            at += end + 1
        self.table = np.concatenate([*tables, np.empty(0, np.int32)])
        self.nowhere = np.array(nowhere, np.int32)

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Of blocks of codes: how many phrases each falls into, by language. Blocks advance together, a place at a time."""
        sizes = np.array([len(b) for b in blocks], np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        flat, sizes = np.concatenate(blocks), sizes[order]
        state = np.repeat(self.nowhere[:, None], len(blocks), axis=1)
        n = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        for place, rows in enumerate(active.tolist()):
            to = self.table.take(state[:, :rows] + flat.take(begin[:rows] + place))
            n[:, :rows] += to >> 30
            np.bitwise_and(to, FRESH - 1, out=state[:, :rows])
        out = np.empty_like(n)
        out[:, order] = n
        return out.T

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and score of each text in turn."""
        waiting: list[int] = []  # bytes of the texts that wait
        blocks: list[np.ndarray] = []
        owner: list[int] = []
        total = 0
        for text in texts:
            codes = self.code[np.frombuffer(running(text) if self.langs else b"", np.uint8)]
            for at in range(0, len(codes), BLOCK):
                blocks.append(codes[at : at + BLOCK])
                owner.append(len(waiting))
            waiting.append(len(codes))
            total += len(codes)
            if total >= AT_ONCE:
                yield from self._judged(waiting, blocks, owner)
                waiting, blocks, owner, total = [], [], [], 0
        yield from self._judged(waiting, blocks, owner)

    def _judged(self, sizes: list[int], blocks: list[np.ndarray], owner: list[int]) -> Iterator[tuple[str, float]]:
        counts = np.zeros((len(sizes), len(self.langs)), np.int64)
        if blocks:
            np.add.at(counts, np.array(owner), self.phrases(blocks))
        for size, own in zip(sizes, counts, strict=True):
            if not size:
                yield UNKNOWN, 0.0
                continue
            bits = own * self.bits / size
            order = np.argsort(bits, kind="stable")
            first = float(bits[order[0]])
            second = float(bits[order[1]]) if len(order) > 1 else 2 * first + 1
            yield self.langs[order[0]], min(1.0, max(0.0, 1 - first / (first + second)))


def piece(text: str, mark: int) -> str:
    """A part of at most ``PIECE_CHARS`` characters, from a place that the mark decides, cut at spaces."""
    if len(text) <= PIECE_CHARS:
        return text
    start = mark % (len(text) - PIECE_CHARS + 1)
    part = text[start : start + PIECE_CHARS]
    inner = part.split(" ")[1:-1]
    return " ".join(inner) or part


def learn(docs: DataFrame, exclude: tuple[int, int] | None = (4, 2), docs_per_lang: int = DOCS_PER_LANG) -> dict[str, list[str]]:
    """The pieces of each language's automaton. The sample is taken by hash, so that it doesn't depend on partitions."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    if exclude:
        rows = rows.filter(~held_out("doc_id", *exclude))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    ship(docs.sparkSession)
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(2**31))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, int(2**31 * min(1.0, docs_per_lang / n)))])
    sample = rows.filter(mark < share[F.col("lang")]).select("lang", "text", mark.alias("mark"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [piece(t.as_py(), m) for t, m in zip(batch.column("text"), batch.column("mark").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(cut, pa.string())], names=["lang", "piece"])

    # About docs_per_lang rows a language, PIECE_CHARS characters each.
    found = sample.mapInArrow(pieces, "lang string, piece string").toArrow().to_pylist()
    out: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["piece"])):
        if running(r["piece"]):
            out.setdefault(r["lang"], []).append(r["piece"])
    return out


def predict(docs: DataFrame, pieces: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of every document."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # about DOCS_PER_LANG * PIECE_CHARS characters a language

    def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            parser = _parser(shared)
            for batch in batches:
                found = list(parser.predict(t.as_py() for t in batch.column("text")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predictions, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def _parser(shared) -> Parser:
    """One parser a worker process and broadcast."""
    pieces = shared.value
    mark = hash(tuple((k, tuple(v)) for k, v in sorted(pieces.items())))
    return held(f"langid {mark}", lambda: Parser(pieces))
