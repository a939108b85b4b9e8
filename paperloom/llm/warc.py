"""WARC archives: a writer that makes revisit records, and a splittable reader.

Writing: a page's payload is its html in UTF-8 (null: empty). Of pages with equal payloads of at least ``min_bytes``
the one with the smallest page_id is written as a response, the others as revisits that refer to it. Every record is a
gzip member of its own, and each task writes one archive to the shared folder under a name of its own attempt, so that
a task that runs again harms nothing; the list of archives is kept as a table.

Reading: archives are cut into byte ranges. A task scans its range for the gzip magic, takes a place for a member only
if it inflates to a WARC version line and a complete header, and owns the records that start inside its range; it reads
past the range's end to finish the last one.

Defined cases: repeated rows of the page that is the response are responses too; a null page_id is written as such and
never chosen before another; payloads of length zero are payloads like any other; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.common import Scratch, ship

MAGIC = b"\x1f\x8b\x08"
BLOCK = 1 << 18
#: Bytes of a range; the reader's parallelism is the archives' size over it.
SPLIT = 8 << 20
#: Bytes that are looked at or inflated at a time until a record's header ends.
HEADER_LIMIT = 1 << 16
SHORT_HEADER = 1 << 11
PAGE, REFERS, LENGTH = "WARC-Paperloom-Page", "WARC-Paperloom-Refers-To-Page", "WARC-Paperloom-Payload-Length"
SOME_TIME = "2020-01-01T00:00:00Z"  # fixed, so that equal pages give equal archives


def file_system(uri: str):
    return pyarrow.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One gzip member. A revisit has no payload, but the digest and the length of the one that it stands for."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{url}'.encode()).digest())}>",
        f"WARC-Date: {SOME_TIME}",
        f"WARC-Target-URI: {clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"{PAGE}: {page_id}",
        f"{LENGTH}: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"{REFERS}: {refers_to}"]
    block = http if is_revisit else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def clean(url: str) -> str:
    """White space and control characters can't stand in a header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def write(pages: DataFrame, scratch: Scratch, min_bytes: int = 0, name: str = "archives") -> DataFrame:
    """Write the archives; returns their paths, sizes and numbers of records, from a table that is kept."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", F.coalesce(pages["url"] if "url" in pages.columns else F.lit(None), F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    # The first of each payload needs ids and digests alone: what is summed up before the shuffle is one row a payload.
    firsts = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("sha", "first_id")
    joined = rows.join(firsts, "sha", "left")
    folder = f"{scratch.root}/{name}"

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        path, size, out, n = None, 0, None, 0
        for batch in batches:
            for page, url, html, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "first_id")), strict=True):
                if out is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(file_system(folder)[1], recursive=True)
                    out = fs.open_output_stream(file_system(path)[1], compression=None)
                page, first = page.as_py(), first.as_py()
                data = record(page, url.as_py(), html.as_py().encode(), first, first is not None and page != first)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "n_records"])

    return scratch.keep(joined.select("page_id", "url", "html", "first_id").mapInArrow(archive, "path string, size long, n_records long"), f"{name}-list")


def header_at(data: bytes) -> dict[str, str] | None:
    """The header of a record that starts the data, if it does."""
    if not data.startswith(b"WARC/1."):
        return None
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    out = {}
    for line in data[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out if "content-length" in out and "warc-type" in out else None


class Stretch:
    """Bytes of a file from a moving place on, read in blocks; memory is one member's at most."""

    def __init__(self, stream, at: int, size: int):
        self.stream, self.size, self.start, self.data = stream, size, at, bytearray()
        stream.seek(at)

    def more(self) -> bool:
        got = self.stream.read(BLOCK) if self.start + len(self.data) < self.size else b""
        self.data += got
        return bool(got)

    def drop(self, to: int) -> None:
        del self.data[: to - self.start]  # in place, as more() adds in place: a long member isn't copied for every block
        self.start = to


VERSION = b"WARC/1."


def validated(w: Stretch) -> dict[str, str] | None:
    """The record header that the member at the stretch's start inflates to, however long; None if no record starts there."""
    z, start, fed, limit = zlib.decompressobj(31), bytearray(), 0, SHORT_HEADER
    try:
        while not z.eof:
            piece = z.unconsumed_tail
            if not piece:
                if fed == len(w.data) and not w.more():
                    break
                piece = w.data[fed : fed + HEADER_LIMIT]
                fed += len(piece)
            seen = max(0, len(start) - 3)
            start += z.decompress(piece, limit)
            limit = HEADER_LIMIT
            if not start.startswith(VERSION[: len(start)]):
                return None
            if start.find(b"\r\n\r\n", seen) >= 0:
                return header_at(bytes(start))
    except zlib.error:
        return None
    if start.startswith(VERSION):
        raise ValueError(f"the record at {w.start} ends within its header")
    return None


def read_range(stream, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of the records whose members start in [start, end)."""
    w = Stretch(stream, start, size)
    at = start
    while at < end:
        place = w.data.find(MAGIC, at - w.start)
        if place < 0:
            at = max(at, w.start + len(w.data) - len(MAGIC) + 1)
            w.drop(min(at, w.start + len(w.data)))
            if not w.more():
                return
            continue
        at = w.start + place
        if at >= end:
            return
        w.drop(at)
        while len(w.data) < HEADER_LIMIT and w.more():
            pass
        head = validated(w)
        if head is None:
            at += 1
            continue
        z, parts, fed = zlib.decompressobj(31), [], 0
        while not z.eof:
            piece = w.data[fed : fed + BLOCK]
            if not piece and not w.more():
                raise ValueError(f"the archive ends within the record at {at}")
            piece = w.data[fed : fed + BLOCK]
            parts.append(z.decompress(piece))
            fed += len(piece)
        whole = b"".join(parts)
        body = whole.find(b"\r\n\r\n") + 4
        yield head, whole[body : body + int(head["content-length"])]
        at += fed - len(z.unused_data)
        w.drop(at)


def read(archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """One row for each record of the archives (path, size): what its header says, its payload, and the payload's own
    digest (a revisit has that of its header)."""
    ship(archives.sparkSession)

    parts = archives.filter("size > 0").select("path", F.col("size").cast("long").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") - 1, F.lit(split).cast("long"))).alias("start"))
    parts = parts.repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path", "start")
    schema = "page_id string, record_type string, target_uri string, payload_length long, payload_digest string, refers_to string, payload binary, archive string"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = file_system(row["path"])
                with fs.open_input_file(path) as stream:
                    out, size = [], 0
                    for head, block in read_range(stream, row["size"], row["start"], min(row["size"], row["start"] + split)):
                        payload = block[block.find(b"\r\n\r\n") + 4 :] if head["warc-type"] == "response" else None
                        size += len(block)
                        out.append((head.get(PAGE.lower()), head["warc-type"], head.get("warc-target-uri"), int(head.get(LENGTH.lower(), -1)), head.get("warc-payload-digest", "").removeprefix("sha1:") if payload is None else digest(payload), head.get(REFERS.lower()), payload, row["path"]))
                        if size > 8 << 20:
                            yield batch_of(out)
                            out, size = [], 0
                    if out:
                        yield batch_of(out)

    def batch_of(rows):
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())
        names = ["page_id", "record_type", "target_uri", "payload_length", "payload_digest", "refers_to", "payload", "archive"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return parts.mapInArrow(records, schema)
