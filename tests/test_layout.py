"""Tables, boxes, summaries, charts, equations, output and the library on small fixtures."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.library import CommandError, Library
from paperloom.operators import charts as C
from paperloom.operators import equations as E
from paperloom.operators import relations as R
from paperloom.operators import layout as L
from paperloom.operators import output as O
from paperloom.operators import summaries as S
from paperloom.operators import tables as X


def cells(spark, **tables):
    rows = [(k, i, j, t) for k, rows in tables.items() for i, r in enumerate(rows) for j, t in enumerate(r)]
    return spark.createDataFrame(rows, "t string, row int, col int, text string")


def test_totals(spark):
    a = [["Year", "Revenue", "Cost", "Total"], ["2023", "40", "1,000", "1,040"], ["2024", "50", "2,000", "2,050"], ["Total", "95", "3,000", "3,090"]]
    b = [["Item", "Q1", "Sum"], ["x", "1.50", None], ["y", "1.00", ""], ["Subtotal", "2.50", ""], ["z", "5.00", ""], ["Grand total", "7.50", ""]]
    rows = X.check_totals(X.header_rows(cells(spark, a=a, b=b), "t"), "t").collect()
    bad = [(r.t, r.column, r.expected, r.extracted, r.difference) for r in rows if not r.ok]
    assert bad == [("a", "Revenue", "90", "95", "+5")]
    assert sum(r.t == "b" for r in rows) == 2
    report = {r.t: r for r in X.consistency(X.check_totals(X.header_rows(cells(spark, a=a, b=b), "t"), "t"), "t").collect()}
    assert report["a"].status == "WARNING" and "expected total 90, extracted total 95" in report["a"].review_reason and report["b"].status == "PASS"


def test_shares_years_and_serials_are_not_added(spark):
    body = [["No", "Share", "Year", "N"], ["1", "10%", "2001", "5"], ["2", "20%", "2002", "6"], ["Total", "31%", "9", "11"]]
    assert [(r.column, r.ok) for r in X.check_totals(X.header_rows(cells(spark, a=body), "t"), "t").collect()] == [("N", True)]


def test_totals_against_brute_force(spark):
    rnd, tables, want = random.Random(5), {}, {}
    for k in range(25):
        n = rnd.randint(2, 6)
        values = [Decimal(rnd.randint(100, 9999)) / 100 for _ in range(n)]
        off = rnd.choice([Decimal(0), Decimal("0.01"), Decimal("5.55")])
        tables[f"t{k}"] = [["Name", "Amount"], *[[f"r{i}", str(v)] for i, v in enumerate(values)], ["Total", str(sum(values) + off)]]
        total = sum(values) + off
        room = min(Decimal("0.005") * (n + 1), max(Decimal("0.005"), Decimal("0.005") * total))
        want[f"t{k}"] = off <= room
    got = {r.t: r.ok for r in X.check_totals(X.header_rows(cells(spark, **tables), "t"), "t").collect()}
    assert got == want


def test_headers_and_labels(spark):
    rows = [("t", 0, 0, "", 1), ("t", 0, 1, "2023", 1), ("t", 1, 0, "Item", 1), ("t", 1, 1, "Q1", 1), ("u", 0, 0, "Group", 2), ("u", 0, 1, "Group", 1), ("u", 1, 0, "A", 1), ("u", 1, 1, "B", 1), ("u", 2, 0, "1", 1), ("u", 2, 1, "2", 1)]
    h = X.header_rows(spark.createDataFrame(rows, "t string, row int, col int, text string, colspan int"), "t")
    labels = {(r.t, r.col): r.label for r in X.column_labels(h, "t").collect()}
    assert labels == {("t", 0): "", ("t", 1): "", ("u", 0): "Group / A", ("u", 1): "Group / B"}
    assert X.check_totals(h.filter("false"), "t").count() == 0


def test_words_in_cells(spark):
    grid = spark.createDataFrame([("t", 0, 0, 0.0, 0.0, 50.0, 20.0), ("t", 0, 1, 50.0, 0.0, 100.0, 20.0)], "t string, row int, col int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("t", "b", 20.0, 2.0, 30.0, 8.0), ("t", "a", 2.0, 2.0, 10.0, 8.0)], "t string, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.col: r.text for r in X.words_in_cells(words, grid, "t").collect()} == {0: "a b", 1: ""}


PART = "struct<n_cols: int, x0: double, y0: double, x1: double, y1: double, page_height: double, edges: array<double>, headers: array<string>, first: array<string>>"


def test_tables_go_on(spark):
    def part(y0, y1, headers):
        return (2, 50.0, y0, 550.0, y1, 800.0, [50.0, 300.0, 550.0], headers, ["a", "b"])

    rows = [("d", 1, 1, part(100.0, 780.0, ["a", "b"])), ("d", 2, 2, part(40.0, 300.0, ["a", "b"])), ("d", 3, 3, (3, *part(40.0, 300.0, None)[1:]))]
    got = X.continued(spark.createDataFrame(rows, f"d string, order_no int, page int, part {PART}"), "d").orderBy("order_no").collect()
    assert [(r.table_no, r.merge_score) for r in got] == [(1, 0.0), (1, 1.0), (2, 0.0)]


BOX = "d string, page int, id int, type string, x0 double, y0 double, x1 double, y1 double"


def test_two_columns_under_a_title(spark):
    rows = [
        ("d", 1, 1, "paragraph", 320.0, 100.0, 540.0, 300.0), ("d", 1, 2, "paragraph", 50.0, 100.0, 270.0, 200.0), ("d", 1, 3, "heading", 50.0, 50.0, 540.0, 70.0),
        ("d", 1, 4, "paragraph", 50.0, 210.0, 270.0, 300.0), ("d", 1, 5, "footer", 50.0, 780.0, 540.0, 790.0), ("d", 1, 6, "header", 50.0, 10.0, 540.0, 20.0), ("d", 1, 7, "paragraph", None, None, None, None),
    ]
    got = L.reading_order(spark.createDataFrame(rows, BOX), "d").orderBy("place").collect()
    assert [r.id for r in got] == [6, 3, 2, 4, 1, 5, 7] and not any(r.ambiguous for r in got)
    twice = rows + [("d", 1, 8, "paragraph", 60.0, 150.0, 260.0, 190.0)]
    assert all(r.ambiguous for r in L.reading_order(spark.createDataFrame(twice, BOX), "d").collect())
    assert L.reading_order(spark.createDataFrame([], BOX), "d").count() == 0


def test_paragraphs(spark):
    rows = [("d", 1, "Some hyphen-", 10.0, 0.0), ("d", 2, "ated text", 10.0, 11.0), ("d", 3, "after a gap", 10.0, 40.0), ("d", 4, "• item", 10.0, 51.0), ("d", 5, "big", 20.0, 62.0)]
    lines = spark.createDataFrame([(d, i, t, s, 0.0, y, 100.0, y + 10) for d, i, t, s, y in rows], "d string, i int, text string, size double, x0 double, y0 double, x1 double, y1 double")
    got = L.grouped(L.paragraphs(lines, ["d"], "i"), ["d"], "i").orderBy("paragraph_no").collect()
    assert [r.text for r in got] == ["Some hyphenated text", "after a gap", "• item", "big"]


def test_continued_text(spark):
    rows = [("d", 1, 1, "paragraph", "This goes"), ("d", 2, 1, "footer", "1"), ("d", 3, 2, "paragraph", "on here."), ("d", 4, 3, "paragraph", "not this"), ("d", 5, 4, "paragraph", None)]
    blocks = spark.createDataFrame(rows, "d string, order_no int, page int, type string, text string").withColumns({c: F.lit(0.0) for c in ("x0", "y0", "x1", "y1")})
    got = L.continued_text(blocks, "d", "order_no").orderBy("order_no").collect()
    assert [(r.text, r.n_parts) for r in got] == [("This goes on here.", 2), ("1", 1), ("not this", 1), (None, 1)]


def test_references_levels_captions_boxes(spark):
    rows = [("d", 1, "heading", "References"), ("d", 2, "paragraph", "A. Author, A long title, 2001"), ("d", 3, "heading", "Appendix"), ("d", 4, "paragraph", "A long paragraph that stays as it is")]
    blocks = spark.createDataFrame(rows, "d string, i int, type string, text string")
    assert [r.type for r in L.marked_references(blocks, "d", "i").orderBy("i").collect()] == ["heading", "reference", "heading", "paragraph"]
    heads = spark.createDataFrame([("d", "1.2 Method", 9.0), ("d", "Title", 20.0), ("d", "Part", 14.0)], "d string, text string, size double")
    assert {r.text: r.level for r in L.heading_levels(heads, "d").collect()} == {"1.2 Method": 2, "Title": 1, "Part": 2}
    boxes = spark.createDataFrame([("d", 1, 1, "table", 0.0, 0.0, 100.0, 50.0, None), ("d", 1, 2, "caption", 0.0, 60.0, 90.0, 70.0, "Table 1: x"), ("d", 1, 3, "figure", 0.0, 75.0, 90.0, 95.0, None)], BOX + ", text string")
    assert [(r.id, r.target_id, r.distance) for r in L.caption_targets(boxes, "d").collect()] == [(2, 1, 10.0)]
    parts = spark.createDataFrame([("d", 0.0, 0.0, 10.0, 10.0), ("d", 30.0, 0.0, 40.0, 10.0), ("d", 9.0, 5.0, 31.0, 6.0), ("d", 80.0, 80.0, 90.0, 90.0)], "d string, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.members for r in L.merged_boxes(parts, ["d"]).collect()) == [1, 3]


def test_scans(spark):
    rows = [("a", "x" * 30, 0.0), ("b", "x" * 10, 0.0), ("c", "�" * 30, 0.0), ("d", "x" * 100, 0.9), ("e", None, None)]
    got = {r.k: r.is_scanned for r in L.scan_decision(spark.createDataFrame(rows, "k string, text string, image_coverage double")).collect()}
    assert got == {"a": False, "b": True, "c": True, "d": True, "e": True}


BLOCKS = "document_id string, order_no int, id string, page int, type string, text string, level int, confidence double, confidence_level string, status string, review_reason string, ordered boolean, items array<string>, latex string, caption string, chart struct<chart_type: string, title: string, x_label: string, y_label: string, categories: array<string>, series: array<string>>"
ONE, TWO = "0123456789ab", "ba9876543210"


@pytest.fixture(scope="module")
def library(spark):
    good = (0.9, "HIGH", "OK", None)
    rows = [
        (ONE, 1, "B1", 1, "heading", "Annual report", 1, *good, None, None, None, None, None),
        (ONE, 2, "B2", 1, "paragraph", "The annual report shows a rise of sales in every region. The sales of the region were good this year.", None, *good, None, None, None, None, None),
        (ONE, 3, "B3", 1, "paragraph", "Doubtful words about sales that nobody could read well here.", None, 0.3, "LOW", "REVIEW_REQUIRED", "faint", None, None, None, None, None),
        (ONE, 4, "B4", 2, "list", "first\nsecond", None, *good, False, ["first", "second"], None, None, None),
        (ONE, 5, "B5", 2, "table", "Table: 2 rows x 2 columns", None, *good, None, None, None, None, None),
        (ONE, 6, "B6", 2, "equation", "a b", None, *good, None, None, "a+b", None, None),
        (ONE, 7, "B7", 3, "chart", "Bar chart: Sales", None, *good, None, None, None, None, ("bar", "Sales", None, "EUR", ["Q1"], None)),
    ]
    docs = spark.createDataFrame([(ONE, "Report.pdf", "pdf", 3, "SUCCESS", 1), (TWO, "other report.pdf", "pdf", 1, "SUCCESS", 2)], "document_id string, filename string, format string, page_count int, status string, ts int")
    table = spark.createDataFrame([(ONE, "B5", 0, 0, "Name", True), (ONE, "B5", 0, 1, "N,x", True), (ONE, "B5", 1, 0, "a", False), (ONE, "B5", 1, 1, None, False)], "document_id string, id string, row int, col int, text string, is_header boolean")
    return Library(docs, spark.createDataFrame(rows, BLOCKS), table)


def test_library(spark, library):
    assert library.resolve("report.pdf") == ONE and library.resolve(TWO) == TWO and library.resolve("other") == TWO
    for wrong in ("rep", "missing.pdf"):
        with pytest.raises(CommandError):
            library.resolve(wrong)
    with pytest.raises(CommandError, match="did you mean 'tables'"):
        library.run("tabels report.pdf")
    with pytest.raises(CommandError):
        library.run("export xls")
    hits = library.run('search report.pdf "sales" --page 1').collect()
    assert [(h.order_no, h.match_count) for h in hits] == [(2, 2), (3, 1)]
    assert library.run("search sales --all-docs").count() == 3
    assert [r.id for r in library.run("text . --min-conf 0.5").collect()] == ["B1", "B2", "B4"]
    assert library.run("tables report.pdf").first().grid == "Name │ N,x\n─────┼────\na    │"
    assert [r.line for r in library.run("export csv report.pdf --type list").collect()] == ["﻿id,type,page,confidence,content", "B4,list,2,0.9,• first ⏎ • second"]
    assert library.run("export txt report.pdf --type equation").first().text == "$$ a+b $$"
    assert json.loads(library.run("json report.pdf").first().json)["blocks"][3]["items"] == ["first", "second"]
    assert library.run("json report.pdf --path blocks.3.items.1").first().value == "second"
    assert library.run("pdf .").first().n_heading == 1 and library.run("docs").count() == 2


def test_summary(library):
    got = library.run("summary report.pdf").first()
    assert got.status == "ok" and got.title.text == "Annual report"
    assert got.executive_summary.startswith("Annual report: 3-page document with 1 table(s), 1 figure(s)/chart(s), 1 equation(s). Main sections: Annual report. The annual report shows")
    assert [p.text for p in got.key_points] == ["Table: 2 rows x 2 columns", "Bar chart: Sales"] and got.warnings[0].startswith("1 low-confidence")
    other = library.run("summary other").first()
    assert other.status == "empty" and other.statistics.total_blocks == 0
    low = S.summaries(library.documents.select("document_id", "page_count", F.lit("digital").alias("source_kind")), library.blocks.filter("id = 'B3'"), "document_id").filter("status = 'uncertain'")
    assert low.count() == 1


def test_json_has_no_nan(spark):
    docs = spark.createDataFrame([("a", "NaN", 1.0), ("b", "x", 2.0)], "d string, text string, v double")
    kids = spark.createDataFrame([("a", 1, [1.0, float("nan")])], "d string, n int, v array<double>")
    assert O.json_documents(docs, {"kids": (kids.filter("n = 0"), ["n"])}, "d").count() == 2
    with pytest.raises(Exception, match="no JSON form"):
        O.json_documents(docs, {"kids": (kids, ["n"])}, "d").collect()


LABEL = "c string, text string, x0 double, y0 double, x1 double, y1 double"


def test_bars_and_pie(spark):
    labels = [("c", t, 0.0, y - 5, 20.0, y + 5) for t, y in (("0", 200.0), ("50", 150.0), ("100", 100.0))] + [("c", t, x - 8, 205.0, x + 8, 215.0) for t, x in (("Q1", 60.0), ("Q2", 120.0), ("Q3", 180.0))]
    labels = spark.createDataFrame(labels, LABEL)
    plots = spark.createDataFrame([("c", 30.0, 80.0, 220.0, 200.0)], "c string, x0 double, y0 double, x1 double, y1 double")
    shapes = spark.createDataFrame([("c", i, "blue", x - 10, y, x + 10, 200.0) for i, (x, y) in enumerate(((60.0, 160.0), (120.0, 110.0), (180.0, 180.0)))], "c string, id int, fill string, x0 double, y0 double, x1 double, y1 double")
    got = {r.category: r.value for r in C.bars(shapes, labels, plots, "c").collect()}
    assert got == {"Q1": 40.0, "Q2": 90.0, "Q3": 20.0}
    points = C.line_points(spark.createDataFrame([("c", "red", 60.0, 160.0, 120.0, 110.0), ("c", "red", 120.0, 110.0, 180.0, 180.0)], "c string, color string, x0 double, y0 double, x1 double, y1 double"), labels, plots, "c")
    assert [(r.category, r.value) for r in points.orderBy("x").collect()] == [("Q1", 40.0), ("Q2", 90.0), ("Q3", 20.0)]
    arcs = spark.createDataFrame([("c", 1, "a", 10.0, 0.0, 0.0, 10.0), ("c", 2, "b", 0.0, 10.0, -10.0, 0.0), ("c", 2, "b", -10.0, 0.0, 0.0, -10.0), ("c", 2, "b", 0.0, -10.0, 10.0, 0.0)], "c string, id int, fill string, x0 double, y0 double, x1 double, y1 double")
    names = spark.createDataFrame([("c", "East", 18.0, 18.0, 22.0, 22.0), ("c", "25%", 14.0, 14.0, 16.0, 16.0)], LABEL)
    pie = {r.id: (r.category, r.value, r.label_value) for r in C.pie_shares(arcs, spark.createDataFrame([("c", 0.0, 0.0)], "c string, cx double, cy double"), names, "c").collect()}
    assert pie[1] == ("East", 25.0, 25.0) and pie[2][1] == 75.0


def test_chart_tables(spark):
    rows = [("a", "bar", "EUR", 0, "North", 0, "Q1", None, None, None, 1.5), ("a", "bar", "EUR", 1, "South", 0, "Q1", None, None, None, 2.5), ("b", "pie", None, 0, None, 0, "x|y", None, None, None, 60.0), ("s", "scatter", None, 0, None, 0, None, 1.0, None, None, 2.0)]
    points = spark.createDataFrame(rows, "c string, chart_type string, unit string, series_no int, series string, point_no int, category string, x double, bin_start double, bin_end double, value double")
    got = {r.c: r.markdown for r in C.chart_tables(points, "c").collect()}
    assert got == {"a": "| Category | North | South |\n|---|---|---|\n| Q1 | 1.5 | 2.5 |", "b": "| Category | Share (%) |\n|---|---|\n| x\\|y | 60.0 |", "s": "| x | y |\n|---|---|\n| 1.0 | 2.0 |"}


def glyphs(*items):
    return [E.Glyph(t, x, b - s, x + 0.5 * s, b, b, s) for t, x, b, s in items]


def test_equations(spark):
    assert E.read(glyphs(("x", 0, 100, 10), ("2", 5, 95, 6), ("+", 12, 100, 10), ("α", 20, 100, 10)), [])[0] == r"x^{2}+\alpha"
    half = glyphs(("a", 0, 90, 10), ("b", 0, 112, 10), ("=", 20, 105, 10), ("1", 30, 105, 10))
    assert E.read(half, [(0.0, 6.0, 96.0)])[0] == r"\frac{a}{b} =1"
    assert E.read(glyphs(("x", 0, 100, 10), ("₁", 5, 100, 10), ("ж", 12, 100, 10)), []) == ("x_{1}ж", ["ж"], ["scripts"])
    assert E.read(glyphs(("√", 0, 100, 10), ("x", 5, 100, 10)), [(5.0, 10.0, 90.0)])[:1] == (r"\sqrt{x}",)
    assert E.read([], []) == (None, [], [])
    rows = [("f", g.text, g.x0, g.y0, g.x1, g.y1, g.base, g.size) for g in half] + [("f", None, 0.0, 96.0, 6.0, 96.0, 96.0, 0.0)]
    frame = spark.createDataFrame([tuple(float(v) if isinstance(v, int) else v for v in r) for r in rows], "f string, text string, x0 double, y0 double, x1 double, y1 double, base double, size double")
    assert E.latex(frame, "f").first().latex == r"\frac{a}{b} =1"


def written(x, base, text, size):
    return [E.Glyph(c, x + k * 0.5 * size, base - size, x + (k + 1) * 0.5 * size, base, base, size) for k, c in enumerate(text)]


@pytest.mark.parametrize(
    "chars, rules, want",
    [
        (written(0, 100, "FV = PV × (1+r)", 12) + written(90, 95, "n", 8), [], r"FV = PV \times (1+r)^{n}"),
        (written(0, 100, "x", 12) + written(6, 103, "i", 8) + written(10, 100, " = y", 12) + written(34, 103, "j", 8), [], "x_{i} = y_{j}"),
        (written(0, 100, "A = P(1+r)ⁿ, α ≤ β ≠ γ ± δ", 12), [], r"A = P(1+r)^{n}, \alpha \leq \beta \neq \gamma \pm \delta"),
        (written(0, 105, "∑", 20) + written(3, 86, "n", 8) + written(-1, 119, "i=1", 8) + written(14, 105, "x", 12) + written(20, 108, "i", 8) + written(24, 105, " = S", 12), [], r"\sum_{i=1}^{n} x_{i} = S"),
        (written(0, 105, "x =", 12) + written(36, 98, "a+b", 12) + written(42, 118, "c", 12), [(34, 56, 103)], r"x = \frac{a+b}{c}"),
        (written(0, 100, "y = √", 12) + written(30, 100, "x+1", 12), [(29.5, 48, 88)], r"y = \sqrt{x+1}"),
        (written(0, 100, "z = √(a+b)", 12), [], r"z = \sqrt{a+b}"),
        (written(0, 100, "a = b  (12)", 12), [], r"a = b \tag{12}"),
        (written(0, 100, "x", 12) + written(6, 95, "n+1", 8), [], "x^{n+1}"),
        (written(0, 100, "Y=X", 12) + written(60, 95, "2", 7), [], "Y=X2"),
        (written(6, 80, "a", 12) + written(6, 104, "b", 12) + written(6, 128, "c", 12), [(4, 14, 108), (4, 13, 84)], r"\frac{\frac{a}{b}}{c}"),
    ],
)
def test_equation_forms(chars, rules, want):
    assert E.read(chars, rules)[0] == want


def test_markers_join_their_lines(spark):
    """A bullet goes in front of the line beside it; one too far away, or without a line, stays; a line takes the nearest."""
    rows = [("p", 1, "•", 10, 100, 15, 110), ("p", 2, "first", 25, 101, 90, 111), ("p", 3, "far", 70, 200, 90, 210), ("p", 4, "2.", 10, 200, 18, 210), ("p", 5, "–", 2, 100, 5, 110), ("q", 1, "•", 10, 100, 15, 110)]
    lines = spark.createDataFrame([(*r[:3], *map(float, r[3:])) for r in rows], "p string, id int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {(r.p, r.id): (r.text, r.x0) for r in R.glued_markers(lines, ["p"], "id", r"^(?:[•–]|\d+\.)$").collect()}
    assert got == {("p", 2): ("• first", 10.0), ("p", 3): ("far", 70.0), ("p", 4): ("2.", 10.0), ("p", 5): ("–", 2.0), ("q", 1): ("•", 10.0)}
