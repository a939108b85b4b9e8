"""The restated fixtures: search, numbers, confidence, page ranges, totals, office files, streams."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators import blocks as B
from paperloom.sources import office
from paperloom.streaming import jobs


@pytest.mark.parametrize(
    "raw, value, decimals, percent",
    [
        ("40", 40, 0, False), ("1,234.5", 1234.5, 1, False), ("12,34,567", 1234567, 0, False), ("1.234,56", 1234.56, 2, False), ("(95)", -95, 0, False),
        ("-5", -5, 0, False), ("−5", -5, 0, False), ("95-", -95, 0, False), ("95*", 95, 0, False), ("$1,200.50", 1200.5, 2, False), ("12,5", 12.5, 1, False),
        ("₹ 1,000", 1000, 0, False), ("Rs. 2,500", 2500, 0, False), ("1 234", 1234, 0, False), ("12.5%", 12.5, 1, True),
        *[(bad, None, None, None) for bad in ("1.2M", "12 kg", "abc", "", "-", "—", "n/a", None, "true", "1.2.3", "12,5,5", "1,2345")],
    ],
)
def test_numbers(spark, raw, value, decimals, percent):
    n = spark.createDataFrame([(raw,)], "raw string").select(N.table_number(F.col("raw")).alias("n")).first().n
    assert (n is None) == (value is None)
    if n is not None:
        assert (float(n.value), n.decimals, n.percent) == (value, decimals, percent)


UNITS = [(1, 0, "Annual Revenue Review"), (2, 0, "Total revenue grew.\nRevenue   rose again."), (3, 0, "Cost cutting"), (3, 1, "New REVENUE streams"), (4, 0, "Region"), (4, 1, "Revenue"), (5, 0, "Table 1: Regional performance"), (6, 0, "line about margins")]


@pytest.mark.parametrize("query, orders", [("revenue", [1, 2, 3, 4]), ("REVEN", [1, 2, 3, 4]), ("total revenue", [2]), ('"revenue rose"', [2]), ("revenue north", []), ("a.c*", []), ("zebra", [])])
def test_search(spark, query, orders):
    units = spark.createDataFrame([("d", *u) for u in UNITS], "document_id string, order_no int, unit_no int, text string")
    hits = B.search(units, "document_id", query).orderBy("order_no").collect()
    assert [h.order_no for h in hits] == orders
    if query == "revenue":
        assert hits[1].match_count == 2 and hits[2].matched == "REVENUE"
        two = B.search(units, "document_id", query, limit=2).collect()
        assert len(two) == 2 and all(h.total == 4 and h.truncated for h in two)


def test_blank_phrase():
    with pytest.raises(ValueError):
        T.phrase('" "')


def test_confidence(spark):
    rows = [({},), ({"ocr": 0.95, "layout": 0.9},), ({"ocr": 0.95, "layout": 0.2},), (None,)]
    got = [r.c for r in spark.createDataFrame(rows, "s map<string,double>").select(N.confidence(F.col("s")).alias("c")).collect()]
    assert got[0] == 0.3 and got[3] == 0.3 and got[1] > 0.85 and got[2] < 0.7


def test_pages(spark):
    assert [r.page for r in spark.range(1, 8).withColumnRenamed("id", "page").filter(B.pages_in("3-1,5")).collect()] == [1, 2, 3, 5]
    with pytest.raises(ValueError):
        B.pages_in("1-x")


def test_letters(spark):
    df = spark.range(1, 800).select("id", T.column_name(F.col("id")).alias("a")).withColumn("back", T.column_number(F.col("a")))
    assert df.filter("id != back").count() == 0
    assert {r.id: r.a for r in df.collect()}[703] == "AAA"


def test_long_letters(spark):
    """Names of any length, and back: the last of three and of four letters, the largest number."""
    names = {18278: "ZZZ", 18279: "AAAA", 475254: "ZZZZ", 475255: "AAAAA", 2**63 - 1: "CRPXNLSKVLJFHG"}
    df = spark.createDataFrame([(k,) for k in names], "id long").select("id", T.column_name(F.col("id")).alias("a")).withColumn("back", T.column_number(F.col("a")))
    assert {r.id: (r.a, r.back) for r in df.collect()} == {k: (v, k) for k, v in names.items()}


def docx(body):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def para(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def xlsx():
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Revenue" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Region</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C2"><v>980</v></c><c r="B3"><f>SUM(C2)</f></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_office_files(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + para("Region") + "</w:tc><w:tc>" + para("Total") + "</w:tc></w:tr></w:tbl>"
    (tmp_path / "a.docx").write_bytes(docx(para("Intro", "Heading1") + para("Some prose.") + para("one", "ListBullet") + table))
    (tmp_path / "b.xlsx").write_bytes(xlsx())
    (tmp_path / "c.docx").write_bytes(b"PK\x03\x04 damaged")
    (tmp_path / "d.txt").write_text("plain")
    (tmp_path / "e.pdf").write_bytes(b"no header")
    rows = office.blocks(office.files(spark, str(tmp_path))).collect()
    by = lambda n: sorted((r for r in rows if r.document_id.endswith(n)), key=lambda r: r.order_no or 0)
    assert [(r.type, r.text) for r in by("a.docx")] == [("heading", "Intro"), ("paragraph", "Some prose."), ("list", "one"), ("table", None), ("cell", "Region"), ("cell", "Total")]
    assert [(r.type, r.text, r.row, r.col, r.value_type) for r in by("b.xlsx")] == [("heading", "Revenue", None, None, None), ("cell", "Region", 0, 0, "str"), ("cell", "980", 1, 2, "num"), ("cell", "=SUM(C2)", 2, 1, "formula")]
    assert [by(n)[0].error_code for n in ("c.docx", "d.txt", "e.pdf")] == ["CORRUPT_DOCX", "UNSUPPORTED_FORMAT", "CORRUPT_PDF"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx(para("Some prose.")))
    (tmp_path / "in/b.txt").write_text("x")
    q = jobs.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {r.document_id[-6:]: r.status for r in jobs.status(spark.read.parquet(str(tmp_path / "out/job_events"))).collect()}
    assert got == {"a.docx": "SUCCESS", "/b.txt": "FAILED"}
