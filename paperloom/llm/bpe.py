"""Byte-level BPE through a sentencepiece model that is written straight from a rank vocabulary.

Every token's bytes are mapped to private characters, one per byte value, and become a piece with score -rank;
sentencepiece's BPE, which joins the neighbouring pair whose joined piece scores highest (leftmost on ties), then
joins in rank order. Normalisation is the identity, no dummy prefix is added and spaces are not escaped.

Pre-tokens are the matches of the public pattern. A text is first cut at white space into chunks (an optional space
and a run without white space, or white space), which no pre-token crosses, and the ids of recent chunks are
remembered in a bounded table; the result of a chunk never depends on its surroundings.

Defined cases: a null or empty text has no ids, and its two digests are those of the empty string. Any text round
trips exactly. Rows repeat as they come; other columns are ignored by ``encode_documents`` and kept by ``encode``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import arrow_strings, held, no_cycles, ship, text_rows

#: Characters that the pattern's ``\s`` takes, as the inside of a character class: Unicode White_Space.
WHITE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: A chunk whose pre-tokens are plain: a word, and marks after it.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: First of the 256 private characters that stand for byte values.
BYTE_BASE = 0xE000
#: Chunks in each of the two generations of the table of recent chunks.
CACHE_CHUNKS = 300_000
#: Longer chunks are coded each time, so that the table stays small.
CACHE_CHUNK_CHARS = 64
#: Chunks, of one text or several, that are looked up together.
PIECE = 65_536
TO_CHARS = [chr(BYTE_BASE + b) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def mapped(data: bytes) -> str:
    """Bytes as private characters; the inverse is ``unmapped``."""
    return "".join([TO_CHARS[b] for b in data])


def unmapped(text: str) -> bytes:
    return bytes(ord(c) - BYTE_BASE for c in text)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model of a rank vocabulary: piece id = rank + 1 (0 is the unknown piece that a model must have)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    unk = m.pieces.add()
    unk.piece, unk.score, unk.type = "<unk>", 0.0, pb.ModelProto.SentencePiece.UNKNOWN
    for rank, token in enumerate(sorted(ranks, key=ranks.__getitem__)):
        p = m.pieces.add()
        p.piece, p.score = mapped(token), -float(rank)
    t = m.trainer_spec
    t.model_type = pb.TrainerSpec.BPE
    t.vocab_size = len(m.pieces)
    t.unk_id, t.bos_id, t.eos_id, t.pad_id = 0, -1, -1, -1
    t.unk_piece = "<unk>"
    t.hard_vocab_limit = False
    n = m.normalizer_spec
    n.name = "identity"
    n.add_dummy_prefix = n.remove_extra_whitespaces = n.escape_whitespaces = False
    return m.SerializeToString()


class ByteBpe:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        from sentencepiece import SentencePieceProcessor

        tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in tokens]
        self.model = SentencePieceProcessor(model_proto=serialise(ranks))
        self.piece_bytes = {ranks[t]: unmapped(mapped(t)) for t in tokens}
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.chunks = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
        self.memory: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def encode_chunk(self, chunk: str) -> list[int]:
        out: list[int] = []
        for m in self.pattern.finditer(chunk):
            data = m.group().encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out.append(whole)
            else:
                out += [self.ids[i - 1] for i in self.model.encode(mapped(data))]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks.findall(text) for i in self.encode_chunk(c)]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.piece_bytes.__getitem__, ids))

    def split(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk. Latin letters with ASCII marks after them, no apostrophe, need no full pattern."""
        m = PLAIN.fullmatch(chunk)
        if m is None:
            return self.pattern.findall(chunk)
        return [m[1], m[2]] if m[2] else [chunk]

    def coded(self, chunks: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """Count, decimal ids and decoded bytes of each chunk; pre-tokens that aren't known go to the model together."""
        parts = [self.split(c) for c in chunks]
        own = {x: self.memory.get(x) or self.older.get(x) for part in parts for x in part}
        new = [x for x, f in own.items() if f is None]
        data = [x.encode() for x in new]
        pieces = iter(self.model.encode([mapped(d) for d in data if d not in self.ranks], num_threads=1) if new else ())
        for x, d in zip(new, data, strict=True):
            rank = self.ranks.get(d)
            ids = [self.ids[k - 1] for k in next(pieces)] if rank is None else [rank]
            own[x] = (len(ids), " ".join(map(str, ids)), self.decode(ids))
        for part in parts:
            if len(part) == 1:
                yield own[part[0]]
            else:
                found = [own[x] for x in part]
                yield sum(f[0] for f in found), " ".join([f[1] for f in found]), b"".join([f[2] for f in found])

    def known(self, chunks: list[str]) -> list[tuple[int, str, bytes]]:
        """What ``coded`` gives, by way of the table of recent chunks."""
        found = list(map(self.memory.get, chunks))
        if None not in found:
            return found
        again: dict[str, tuple[int, str, bytes] | None] = {c: self.older.get(c) for c, f in zip(chunks, found, strict=True) if f is None}
        new = [c for c, f in again.items() if f is None]
        again.update(zip(new, self.coded(new), strict=True))
        if len(self.memory) + len(again) > CACHE_CHUNKS:
            self.older, self.memory = self.memory, {}
        self.memory.update((c, f) for c, f in again.items() if len(c) <= CACHE_CHUNK_CHARS)
        return [f or again[c] for c, f in zip(chunks, found, strict=True)]

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str, str]]:
        """Count of ids, the digests of the ids' decimal text and of the decoded bytes, and that decimal text, of each text
        in turn."""
        waiting: list[list[str]] = []
        size = 0
        for text in texts:
            waiting.append(self.chunks.findall(text))
            size += len(waiting[-1])
            if size >= PIECE:
                yield from self._digests(waiting)
                waiting, size = [], 0
        yield from self._digests(waiting)

    def _digests(self, lists: list[list[str]]) -> Iterator[tuple[int, str, str, str]]:
        found = iter(self.known([c for x in lists for c in x]))
        for x in lists:
            own = list(islice(found, len(x)))
            ids = " ".join([f[1] for f in own])
            yield sum([f[0] for f in own]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in own])).hexdigest(), ids

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests([text]))[:3]


def load(path: str, pattern: str) -> ByteBpe:
    return held(f"bpe {path} {pattern}", lambda: ByteBpe(read_ranks(path), pattern))


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text, and token_ids if wanted; one pass, no shuffle.

    ``vocabulary`` is the path of a rank file on every executor (None: the public one, found on each executor).
    """
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids"] * with_ids

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with no_cycles():
            bpe = load(vocabulary or public_path(), pattern or public_pattern())
            for batch in batches:
                n, ids, data, tokens = [], [], [], []
                for found in bpe.digests(arrow_strings(batch, "text")):
                    n.append(found[0])
                    ids.append(found[1])
                    data.append(found[2])
                    if with_ids:
                        tokens.append(np.array(found[3].split(), np.int32))
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(data, pa.string())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate([*tokens, np.empty(0, np.int32)])))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return text_rows(docs).mapInArrow(digest, schema)


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every row with its ids as array<int> in column ``out``."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(s):
        bpe = load(vocabulary or public_path(), pattern or public_pattern())
        return s.map(lambda t: bpe.encode(t or ""))

    return docs.withColumn(out, ids(F.col(text)))


def decode(rows: DataFrame, ids: str = "token_ids", out: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """Every row with the bytes of its ids in column ``out``; an id outside the vocabulary is an error."""
    ship(rows.sparkSession)

    @F.pandas_udf("binary")
    def data(s):
        bpe = load(vocabulary or public_path(), public_pattern())
        return s.map(lambda x: bpe.decode(x if x is not None else ()))

    return rows.withColumn(out, data(F.col(ids)))
