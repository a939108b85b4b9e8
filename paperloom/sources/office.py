"""Office files and PDF headers as DataFrames: bytes are decoded in mapInPandas, everything after that is relational.

A file that can't be decoded becomes an error row and never fails the job.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 50 * 1024 * 1024
FORMATS = ("pdf", "docx", "pptx", "xlsx")
#: Total inflated size and number of parts that a file may have.
MAX_INFLATED, MAX_PARTS = 512 * 1024 * 1024, 10_000

# XML namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
EMU = 12700

BLOCKS = "document_id string, order_no int, page int, type string, level int, ordered boolean, text string, row int, col int, value_type string, bbox array<double>, error_code string"


def files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def format_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def admitted(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Format and, for files that go no further, an error code: unsupported, too large, or a PDF without its header."""
    kind = format_of(F.col("path"))
    head = F.substring("content", 1, 1024)
    is_pdf = F.contains(F.hex(head), F.lit("%PDF-".encode().hex().upper()))
    code = (
        F.when(~kind.isin(*FORMATS), "UNSUPPORTED_FORMAT")
        .when(F.col("length") > max_bytes, "FILE_TOO_LARGE")
        .when((kind == "pdf") & ~F.coalesce(is_pdf, F.lit(False)), "CORRUPT_PDF")
    )
    return rows.withColumn("format", kind).withColumn("error_code", code)


def blocks(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Blocks and cells of every DOCX, PPTX and XLSX, in reading order, and an error row for what isn't read."""
    rows = admitted(rows, max_bytes)
    key = F.col("path").alias("document_id")
    bad = rows.filter("error_code IS NOT NULL").select(key, "error_code")
    good = rows.filter("error_code IS NULL AND format != 'pdf'").select(key, "format", "content")
    return good.mapInPandas(_decoded, BLOCKS).unionByName(bad, allowMissingColumns=True)


def _decoded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    readers = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
    for frame in frames:
        out = []
        for document, kind, content in frame.itertuples(index=False):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    infos = z.infolist()
                    if len(infos) > MAX_PARTS or sum(i.file_size for i in infos) > MAX_INFLATED:
                        raise ValueError("inflates too far")
                    found = [dict(b, document_id=document, order_no=k) for k, b in enumerate(readers[kind](z), 1)]
            except Exception:  # any damage to a file is a row of the result
                found = [{"document_id": document, "error_code": "CORRUPT_DOCX" if kind == "docx" else "PARSING_FAILED"}]
            out += found
        frame = pd.DataFrame(out, columns=names).astype(object)
        yield frame.where(frame.notna(), None)


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element:
    data = z.read(name)
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        raise ValueError("declarations aren't allowed")
    return ET.fromstring(data)


def _texts(node: ET.Element, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag)).strip()


def docx(z: zipfile.ZipFile) -> Iterator[dict]:
    """Body children in XML order; headings and lists by style, captions by style or by their first words."""
    body, table = _xml(z, "word/document.xml").find(f"{W}body"), 0
    for node in body:
        if node.tag == f"{W}tbl":
            yield {"page": 1, "type": "table", "text": None, "level": table}
            for r, row in enumerate(node.findall(f"{W}tr")):
                at = 0
                for cell in row.findall(f"{W}tc"):
                    text = "\n".join(t for t in (_texts(p, f"{W}t") for p in cell.findall(f"{W}p")) if t)
                    yield {"page": 1, "type": "cell", "row": r, "col": at, "text": text, "value_type": "str", "level": table}
                    span = cell.find(f"{W}tcPr/{W}gridSpan")
                    at += int(span.get(f"{W}val")) if span is not None else 1
            table += 1
        elif node.tag == f"{W}p":
            text = _texts(node, f"{W}t")
            style = node.find(f"{W}pPr/{W}pStyle")
            name = (style.get(f"{W}val") if style is not None else "").replace(" ", "").lower()
            heading = re.fullmatch(r"heading([1-9])", name)
            if not text:
                continue
            if heading:
                yield {"page": 1, "type": "heading", "level": int(heading[1]), "text": text}
            elif name.startswith(("listbullet", "listnumber")) or node.find(f"{W}pPr/{W}numPr") is not None:
                yield {"page": 1, "type": "list", "ordered": not name.startswith("listbullet"), "text": text}
            elif name == "caption" or re.match(r"(?i)(?:table|figure)\s+\d+\s*:", text):
                yield {"page": 1, "type": "caption", "text": text}
            else:
                yield {"page": 1, "type": "paragraph", "text": text}


def pptx(z: zipfile.ZipFile) -> Iterator[dict]:
    """Slides are pages; shapes in their order, boxes in points."""
    names = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    for page, (_, name) in enumerate(names, 1):
        for shape in _xml(z, name).iter():
            if shape.tag == f"{P}sp":
                place = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                title = place is not None and place.get("type") in ("title", "ctrTitle")
                for p in shape.iter(f"{A}p"):
                    text = _texts(p, f"{A}t")
                    props = p.find(f"{A}pPr")
                    numbered = props is not None and props.find(f"{A}buAutoNum") is not None
                    bullet = numbered or props is not None and (props.find(f"{A}buChar") is not None or int(props.get("lvl", "0")) > 0)
                    if text:
                        yield {"page": page, "type": "heading" if title else "list" if bullet else "paragraph", "level": 1 if title else None, "ordered": numbered if bullet and not title else None, "text": text, "bbox": _box(shape)}
            elif shape.tag == f"{A}tbl":
                for r, row in enumerate(shape.findall(f"{A}tr")):
                    for c, cell in enumerate(row.findall(f"{A}tc")):
                        yield {"page": page, "type": "cell", "row": r, "col": c, "text": _texts(cell, f"{A}t"), "value_type": "str"}


def _box(shape: ET.Element) -> list[float] | None:
    off, ext = shape.find(f"{P}spPr/{A}xfrm/{A}off"), shape.find(f"{P}spPr/{A}xfrm/{A}ext")
    if off is None or ext is None:
        return None
    x, y, w, h = (int(v) for v in (off.get("x"), off.get("y"), ext.get("cx"), ext.get("cy")))
    return [round(v / EMU, 2) for v in (x, y, x + w, y + h)]


def xlsx(z: zipfile.ZipFile) -> Iterator[dict]:
    """Sheets are pages: the sheet's name as a heading, then its cells; formulas stay as text."""
    shared = [_texts(s, f"{S}t") for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
    targets = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
    for page, sheet in enumerate(_xml(z, "xl/workbook.xml").iter(f"{S}sheet"), 1):
        yield {"page": page, "type": "heading", "level": 1, "text": sheet.get("name")}
        target = targets[sheet.get(f"{R}id")].lstrip("/").removeprefix("xl/")
        for cell in _xml(z, f"xl/{target}").iter(f"{S}c"):
            m = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", ""))
            kind, value, formula = cell.get("t", "n"), cell.findtext(f"{S}v"), cell.findtext(f"{S}f")
            if not m or (value is None and formula is None and kind != "inlineStr"):
                continue
            col = 0
            for letter in m[1]:
                col = col * 26 + ord(letter) - 64
            text, value_type = value, {"s": "str", "str": "str", "inlineStr": "str", "b": "bool", "e": "error"}.get(kind, "num")
            if formula is not None:
                text, value_type = f"={formula}", "formula"
            elif kind == "s":
                text = shared[int(value)]
            elif kind == "inlineStr":
                text = _texts(cell, f"{S}t")
            elif kind == "b":
                text = "true" if value == "1" else "false"
            yield {"page": page, "type": "cell", "row": int(m[2]) - 1, "col": col - 1, "text": text, "value_type": value_type}
