"""PDF files written here, read back."""

import zlib

import pytest
from pyspark.sql import functions as F

from paperloom.sources import pdf, providers
from paperloom.streaming import jobs


def written(pages, compressed=True, extra=b""):
    """A file with a page for each content stream."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count %d /MediaBox [0 0 600 800] /Kids [%s] >>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    for i, content in enumerate(pages):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * i))
        data = zlib.compress(content) if compressed else content
        objects.append(b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode" if compressed else b"", data))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R %s >>\n%%%%EOF" % extra


def line(text, x, y, size=10):
    return b"BT /F1 %d Tf 1 0 0 1 %d %d Tm (%s) Tj ET\n" % (size, x, y, text)


PAGE = line(b"Running head", 50, 780) + line(b"A title", 50, 700, 20) + line(b"Right column text that says a lot.", 320, 650) + line(b"Left column text (with \\(brackets\\)).", 50, 650) + line(b"%d", 300, 10)


def test_values():
    assert pdf.parse(b"<< /A [1 -2.5 (a\\)b) <4142>] /B 3 0 R /C true >>", 0)[0] == {"A": [1, -2.5, b"a)b", b"AB"], "B": pdf.Ref(3), "C": True}
    assert pdf.parse(b"  ", 0)[0] is None and pdf.parse(b"(a\\101\\n(b))", 0)[0] == b"aA\n(b)"


@pytest.mark.parametrize("compressed", [True, False])
def test_text_and_shapes(compressed):
    rows = list(pdf.decode(written([b"q 2 0 0 2 10 10 cm 0 0 20 30 re f Q 5 5 m 50 60 l S BT /F1 12 Tf 100 500 Td [(Hel) -20 (lo) -600 (you)] TJ 0 -14 Td (next) Tj ET"], compressed)))
    assert [(r["kind"], r.get("text")) for r in rows] == [("page", None), ("line", "Hello you"), ("line", "next"), ("rect", None), ("segment", None)]
    assert (rows[3]["x0"], rows[3]["y0"], rows[3]["x1"], rows[3]["y1"]) == (10, 730, 50, 790)


def test_unicode_map():
    class File:
        def get(self, v):
            return v

        def table(self, v):
            return v or {}

        def decoded(self, s):
            return s.raw

    cmap = pdf.Stream({}, b"1 beginbfchar <0001> <0416> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange")
    font = pdf.Font(File(), {"Subtype": "Type0", "ToUnicode": cmap, "DescendantFonts": [{"DW": 600, "W": [1, [250], 2, 3, 700]}]})
    assert font.shown(b"\0\1\0\2\0\4") == [("Ж", 0.25, False), ("a", 0.7, False), ("c", 0.6, False)]


def test_blocks_and_errors(spark):
    good = written([PAGE.replace(b"%d", b"1"), PAGE.replace(b"%d", b"2")])
    files = [("/a.pdf", good), ("/b.pdf", b"%PDF-1.4 nothing"), ("/c.pdf", b"no header"), ("/d.pdf", written([PAGE], extra=b"/Encrypt 9 0 R")), ("/e.pdf", None), ("/f.txt", b"x")]
    rows = pdf.rows(spark.createDataFrame([(p, len(c or b""), c) for p, c in files], "path string, length long, content binary")).cache()
    assert {r.document_id: r.error_code for r in rows.filter("kind = 'error'").collect()} == {"/b.pdf": "CORRUPT_PDF", "/c.pdf": "CORRUPT_PDF", "/d.pdf": "ENCRYPTED_PDF", "/e.pdf": "CORRUPT_PDF"}
    got = pdf.blocks(rows).filter("page = 1").orderBy("order_no").collect()
    assert [(r.type, r.text) for r in got] == [("header", "Running head"), ("heading", "A title"), ("paragraph", "Left column text (with (brackets))."), ("paragraph", "Right column text that says a lot."), ("footer", "1")]
    assert [(r.page, r.is_scanned) for r in pdf.pages(rows).orderBy("page").collect()] == [(1, False), (2, False)]


def test_providers(spark):
    def reader(data):
        return [{"text": data.decode(), "x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 5.0, "confidence": 0.9}]

    images = spark.createDataFrame([("a", 1, b"word"), ("a", 2, b"\xff"), ("a", 3, None)], "document_id string, page int, content binary")
    assert [(r.page, r.text, r.error_code) for r in providers.words(images, reader).orderBy("page").collect()] == [(1, "word", None), (2, None, "OCR_FAILURE"), (3, None, "OCR_FAILURE")]
    assert {r.error_code for r in providers.words(images, None).collect()} == {"OCR_FAILURE"}
    row = spark.createDataFrame([("l", n, x, x + 20.0, 0.0, 10.0) for n, x in enumerate((0.0, 25.0, 100.0))], "l string, n int, x0 double, x1 double, y0 double, y1 double")
    assert [r.part for r in providers.split_at_gaps(row, ["l"]).orderBy("n").collect()] == [1, 1, 2]
    scores = spark.createDataFrame([(5, 0.15, 0.55, 0.5), (5, 0.9, 0.9, 0.85), (9, 9.0, 9.0, None), (2, 9.0, 9.0, None)], "n int, j double, s double, c double")
    assert [r.s for r in scores.select(providers.handwriting_score(*[F.col(c) for c in "njsc"]).alias("s")).collect()] == [0.863, 0.0, 1.0, 0.0]


def test_exclusive_times(spark):
    spans = spark.createDataFrame([("d", 1, None, "all", 10.0), ("d", 2, 1, "text", 3.0), ("d", 3, 1, "tables", 4.0), ("d", 4, 3, "text", 1.0)], "d string, id int, parent_id int, stage string, seconds double")
    assert {r.stage: r.seconds for r in jobs.exclusive_times(spans, "d").collect()} == {"all": 3.0, "text": 4.0, "tables": 3.0}
