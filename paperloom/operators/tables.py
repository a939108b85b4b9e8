"""Operators over table cells: header rows, labels, quality, totals that should add up, parts of one table on several pages.

Cells are rows (key, row, col, text), optionally with ``colspan`` and ``is_header``; ``key`` names a table. Rows and columns count from 0.
Everything is windows and groups within a table, so tables spread over the cluster and only a single table has to fit in a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import numbers as N

# Labels of totals (also in Hindi and Tamil) and of columns whose values aren't added up.
TOTAL = r"(?iU)^[\W_]*(?:(?:grand|overall|net|sub|final)[\s\-]*)?(?:totals?|कुल|மொத்தம்)(?!\w)"
SUM = r"(?iU)^[\W_]*sum[\W_]*$"
SUBTOTAL = r"(?i)sub[\s\-]*total"
GRAND = r"(?i)grand|overall|net|final"
NOT_ADDITIVE = (
    r"(?i)\b(?:avg|average|mean|median|rate|ratio|percent(?:age)?|share|margin|price|score|rank|index|year|fy|age|"
    r"growth|change|yoy|cagr|id|no|sl|sr|sno)\b|%|#|\bper\s"
)

MAX_HEADER_ROWS = 3
NUMERIC_ROW = 0.5
DECIMAL = "decimal(38,6)"


def is_total_label(label: Column) -> Column:
    return F.coalesce(label.rlike(TOTAL) | label.rlike(SUM), F.lit(False))


def header_rows(cells: DataFrame, key: str) -> DataFrame:
    """Cells with ``is_header``: the leading rows without numbers, at most three.

    The first is one if under half of its filled cells are numbers; a further one also needs a spanning cell in the row before it
    or numbers in the row behind it. The last row of a table is never one.
    """
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    numeric = N.table_number(F.col("text")).isNotNull()
    span = F.max("colspan") if "colspan" in cells.columns else F.lit(1)
    rows = cells.groupBy(key, "row").agg(F.count_if(filled).alias("filled"), F.count_if(filled & numeric).alias("numeric"), span.alias("span"))
    share = F.coalesce(F.try_divide("numeric", "filled"), F.lit(0.0))
    by = Window.partitionBy(key).orderBy("row")
    marked = rows.withColumn("share", share).withColumn("plain", (F.col("share") < NUMERIC_ROW) & (F.col("filled") > 0))
    opens = (F.col("row") == 0) | (F.lag("span").over(by) > 1) | (F.lead("share").over(by) >= NUMERIC_ROW)
    marked = marked.withColumn("may", F.col("plain") & opens & (F.col("row") < MAX_HEADER_ROWS) & F.lead("row").over(by).isNotNull())
    ends = marked.groupBy(key).agg(F.min(F.when(~F.col("may"), F.col("row"))).alias("first_body"))
    return cells.join(ends, key).withColumn("is_header", F.col("row") < F.col("first_body")).drop("first_body")


def with_labels(cells: DataFrame, key: str) -> DataFrame:
    """Cells with their column's label: its header cells from top to bottom, equal neighbours once, joined by " / "."""
    text = F.trim(F.coalesce("text", F.lit("")))
    heads = F.array_sort(F.collect_list(F.when(F.col("is_header") & (text != ""), F.struct("row", text.alias("t")))).over(Window.partitionBy(key, "col")))

    def fresh(x: Column, i: Column) -> Column:
        return (i == 0) | (x["t"] != F.get("_heads", i - 1)["t"])

    label = F.array_join(F.transform(F.filter("_heads", fresh), lambda x: x["t"]), " / ")
    return cells.withColumn("_heads", heads).withColumn("label", label).drop("_heads")


def column_labels(cells: DataFrame, key: str) -> DataFrame:
    """(key, col, label) of every column, empty where it has no header."""
    return with_labels(cells, key).groupBy(key, "col").agg(F.first("label").alias("label"))


def quality(cells: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, n_cols, table_fill, structure, degenerate): signals of how well the body was read."""
    filled = F.trim(F.coalesce("text", F.lit(""))) != ""
    shape = cells.groupBy(key).agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    rows = cells.filter("NOT is_header").groupBy(key, "row").agg(F.count_if(filled).alias("n")).join(shape, key)
    body = rows.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.avg((F.col("n") >= 0.6 * F.col("n_cols")).cast("int")).alias("even"))
    fill = F.coalesce(F.col("n") / (F.col("rows") * F.col("n_cols")), F.lit(0.0))
    return shape.join(body, key, "left").select(
        key, "n_rows", "n_cols", F.round(F.least(F.lit(1.0), fill + 0.2), 2).alias("table_fill"), F.round(0.5 + 0.5 * F.coalesce("even", F.lit(0.0)), 2).alias("structure"),
        ((F.col("n_rows") < 2) | (F.col("n_cols") < 2)).alias("degenerate"),
    )


def with_additive(body: DataFrame, key: str) -> DataFrame:
    """Body cells (row, col, num, label, is_total) with ``additive``: their column holds no shares, rates, years or running numbers."""
    column = Window.partitionBy(key, "col")
    detail = ~F.col("is_total") & F.col("num").isNotNull()
    up_to = column.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = body.withColumn("_k", F.count_if(detail).over(up_to) - 1).withColumn("_first", F.min(F.when(detail & (F.col("_k") == 0), F.col("num.value"))).over(column))

    def all_of(condition: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(detail, condition)).over(column), F.lit(False))

    whole = (F.col("num.decimals") == 0) & ~F.col("num.commas")
    years = F.col("num.value").between(1900, 2100)
    serial = F.col("_first").isin(0, 1) & (F.col("num.value") == F.col("_first") + F.col("_k"))
    odd = ~all_of(~F.col("num.percent")) & (F.count_if(detail).over(column) > 0)
    odd = odd | ((F.count_if(detail).over(column) >= 2) & all_of(whole) & (all_of(years) | all_of(serial)))
    return ranked.withColumn("additive", ~F.col("label").rlike(NOT_ADDITIVE) & ~odd).drop("_k", "_first")


def _candidates(rows: DataFrame, line: list[str], along: str, drop_first: bool) -> DataFrame:
    """Adds ``sums``: what a total in a row may add up, from the rows before it on its line.

    ``rows``: line, along, item_total, value and decimals of a usable number. Sums of fewer than two terms don't count.
    """
    by = Window.partitionBy(*line).orderBy(along)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("seg", F.coalesce(F.sum(F.col("item_total").cast("int")).over(before), F.lit(0)))
    part = Window.partitionBy(*line, "seg").orderBy(along)
    detail = ~F.col("item_total") & F.col("value").isNotNull()
    rows = rows.withColumn("k", F.count_if(detail).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    # The segment of a total ends with it, so its section is what stands before it in its own segment.
    since = part.rowsBetween(Window.unboundedPreceding, -1)

    def tally(condition: Column, over) -> list[Column]:
        value = F.when(condition, F.col("value"))
        return [F.coalesce(F.sum(value).over(over), F.lit(0)).cast(DECIMAL), F.count(value).over(over), F.coalesce(F.max(F.when(condition, F.col("decimals"))).over(over), F.lit(0))]

    def term(name: str, sums: list[Column], valid: Column) -> Column:
        fields = F.struct(F.lit(name).alias("name"), sums[0].alias("sum"), sums[1].cast("long").alias("n"), sums[2].cast("int").alias("decimals"))
        return F.when(valid & (sums[1] >= 2), fields)

    section, whole, earlier = tally(detail, since), tally(detail, before), tally(F.col("item_total") & F.col("value").isNotNull(), before)
    both = [(section[0] + earlier[0]).cast(DECIMAL), section[1] + earlier[1], F.greatest(section[2], earlier[2])]
    found = [term("section", section, F.lit(True)), term("all_items", whole, F.col("seg") > 0), term("subtotals", both, F.col("seg") > 0)]
    if drop_first:
        found.append(term("drop_first", tally(detail & (F.col("k") > 1), since), F.lit(True)))
    return rows.withColumn("sums", F.filter(F.array(*found), lambda x: x.isNotNull()))


def _unit(decimals: Column) -> Column:
    return F.element_at(F.array(*[F.lit("1" if d == 0 else "0." + "0" * (d - 1) + "1").cast("decimal(10,6)") for d in range(7)]), F.least(decimals, F.lit(6)) + 1)


def _printed(value: Column, decimals: Column, commas: Column) -> Column:
    shown = F.format_string("%s", F.call_function("format_number", value, decimals))
    return F.when(commas, shown).otherwise(F.replace(shown, F.lit(","), F.lit("")))


def _verified(rows: DataFrame, label: Column, strict: bool) -> DataFrame:
    """Rows with candidates get ok, expected, extracted and difference as they would be printed."""
    rows = rows.filter(F.size("sums") > 0)

    def explains(c: Column) -> Column:
        d = F.greatest(c["decimals"], F.col("decimals"))
        room = F.lit(0) if strict else N.tolerance(_unit(d), c["n"], F.col("value"))
        return F.abs(F.col("value") - c["sum"]) <= room

    def named(name: str) -> Column:
        return F.try_element_at(F.filter("sums", lambda c: c["name"] == name), F.lit(1))

    def first_of(*names: str) -> Column:
        return F.coalesce(*[named(n) for n in names])

    grand = label.rlike(GRAND) & ~label.rlike(SUBTOTAL)
    best = F.when(grand, first_of("subtotals", "section", "all_items", "drop_first")).otherwise(first_of("section", "all_items", "subtotals", "drop_first"))
    rows = rows.withColumn("ok", F.exists("sums", explains)).withColumn("best", best)
    d, commas = F.greatest(F.col("best.decimals"), F.col("decimals")), F.col("commas")
    gap = F.col("value") - F.col("best.sum")
    sign = F.when(gap >= 0, "+").otherwise("-")
    return rows.withColumns({"expected": _printed(F.col("best.sum"), d, commas), "extracted": _printed(F.col("value"), d, commas), "difference": F.concat(sign, _printed(F.abs(gap), d, commas))})


def check_totals(cells: DataFrame, key: str, strict: bool = False) -> DataFrame:
    """One row for each printed total that can be checked: kind, label, column, row, ok, expected, extracted, difference, message.

    ``cells`` need ``is_header``; a table without header rows takes its first row where that holds text and no number. A total may be
    the sum of its section, of all items, or of earlier totals and what follows them; rounding may move it unless ``strict``.
    Nulls and cells that aren't plain numbers count as blank; numbers have six decimals at most. ``row`` counts from 1.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    parsed = cells.select(key, "row", "col", "is_header", text.alias("text"), N.table_number(text).alias("num"))
    # One shuffle by table serves every window below.
    parsed = parsed.repartition(key)
    whole = Window.partitionBy(key)
    in_first = F.col("row") == 0
    takes = ~F.bool_or("is_header").over(whole) & (F.max("row").over(whole) > 0) & F.bool_or(in_first & (F.col("text") != "")).over(whole) & ~F.bool_or(in_first & F.col("num").isNotNull()).over(whole)
    parsed = parsed.withColumn("is_header", F.col("is_header") | (in_first & takes))
    total_column = is_total_label(F.substring_index("label", " / ", -1)) | is_total_label(F.col("label"))
    name = F.when(F.col("num").isNull() & (F.col("text") != "") & (F.col("col") < 2), F.struct("col", "text"))
    body = with_labels(parsed, key).withColumn("total_column", total_column).filter("NOT is_header")
    body = body.withColumn("row_label", F.coalesce(F.min(name).over(Window.partitionBy(key, "row"))["text"], F.lit("")))
    body = with_additive(body.withColumn("is_total", is_total_label(F.col("row_label"))), key)
    body = body.withColumns({"value": F.col("num.value").cast(DECIMAL), "decimals": F.col("num.decimals"), "commas": F.col("num.commas")})
    column = F.when(F.col("label") != "", F.col("label")).otherwise(F.concat(F.lit("Column "), (F.col("col") + 1).cast("string")))
    plain = F.col("num").isNotNull() & ~F.col("num.percent")

    down = _candidates(body.withColumn("item_total", F.col("is_total")), [key, "col"], "row", False)
    down = _verified(down.filter(F.col("is_total") & plain & F.col("additive")), F.col("row_label"), strict)
    down = down.withColumns({"kind": F.lit("column_total"), "who": F.col("row_label"), "column": column})
    message = F.concat(F.lit("Table total mismatch in column '"), "column", F.lit("' (row '"), "who", F.lit("'): "))

    usable = plain & (F.col("additive") | F.col("total_column"))
    items = body.filter("NOT is_total").withColumns({"item_total": F.col("total_column"), "value": F.when(usable, F.col("value"))})
    across = _candidates(items, [key, "row"], "col", True)
    across = _verified(across.filter(F.col("total_column") & plain), F.col("label"), strict)
    who = F.when(F.col("row_label") != "", F.col("row_label")).otherwise(F.concat(F.lit("row "), (F.col("row") + 1).cast("string")))
    across = across.withColumns({"kind": F.lit("row_total"), "who": who, "column": column})
    message_across = F.concat(F.lit("Table total mismatch in row '"), "who", F.lit("', column '"), "column", F.lit("': "))

    def shaped(rows: DataFrame, start: Column) -> DataFrame:
        end = F.concat(F.lit("expected total "), "expected", F.lit(", extracted total "), "extracted")
        return rows.select(key, "kind", F.col("who").alias("label"), "column", (F.col("row") + 1).alias("row"), "ok", "expected", "extracted", "difference", F.when(~F.col("ok"), F.concat(start, end)).alias("message"))

    return shaped(down, message).unionByName(shaped(across, message_across))


def consistency(checks: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """(key, checks_run, checks_passed, status, review_reason) of tables with anything to check; the reason names the first warnings."""
    order = F.struct((F.col("kind") == "row_total").alias("across"), "row", "column", "message")
    groups = checks.groupBy(key).agg(F.count("*").alias("checks_run"), F.count_if("ok").alias("checks_passed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), order))).alias("w"))
    more = F.when(F.size("w") > shown, F.concat(F.lit(" (+"), (F.size("w") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    reason = F.concat(F.lit("TABLE CONSISTENCY WARNING: "), F.array_join(F.transform(F.slice("w", 1, shown), lambda x: x["message"]), "; "), more)
    bad = F.size("w") > 0
    return groups.select(key, "checks_run", "checks_passed", F.when(bad, "WARNING").otherwise("PASS").alias("status"), F.when(bad, reason).alias("review_reason"))


def reviewed(blocks: DataFrame, report: DataFrame, key: str) -> DataFrame:
    """Blocks with the reasons of their tables' warnings behind their own; those need review, all else stays as it is."""
    r = report.filter("review_reason IS NOT NULL").select(key, F.col("review_reason").alias("_why"))
    out = blocks.join(r, key, "left")
    return out.withColumns({"status": F.when(F.col("_why").isNotNull(), "REVIEW_REQUIRED").otherwise(F.col("status")), "review_reason": F.when(F.col("_why").isNotNull(), F.concat_ws("; ", "review_reason", "_why")).otherwise(F.col("review_reason"))}).drop("_why")


def words_in_cells(words: DataFrame, grid: DataFrame, key: str) -> DataFrame:
    """Text of each grid cell (key, row, col, x0, y0, x1, y1) from the words whose centre it holds, in reading order."""
    w = words.select(key, F.col("text").alias("_t"), F.col("x0").alias("_x"), F.col("y0").alias("_y"), ((F.col("x0") + F.col("x1")) / 2).alias("_cx"), ((F.col("y0") + F.col("y1")) / 2).alias("_cy"))
    held = grid.join(w, key).filter("_cx BETWEEN x0 AND x1 AND _cy BETWEEN y0 AND y1")
    place = F.struct(F.round(F.col("_y") / 6).alias("line"), F.col("_x").alias("x"), F.col("_t").alias("t"))
    texts = held.groupBy(key, "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), " ").alias("text"))
    return grid.join(texts, [key, "row", "col"], "left").fillna("", ["text"])


def merge_score(a: str, b: str) -> Column:
    """How surely table ``b`` goes on with ``a`` on the next page: from column count, place, width, edges and header.

    Both are struct columns (n_cols, x0, y0, x1, y1, page_height, edges, headers, first) with ``edges`` an array of column borders,
    ``headers`` the last header row of the part and ``first`` its first row, lower-cased arrays (null without).
    """
    wide_a, wide_b = F.col(f"{a}.x1") - F.col(f"{a}.x0"), F.col(f"{b}.x1") - F.col(f"{b}.x0")
    ea, eb = F.col(f"{a}.edges"), F.col(f"{b}.edges")
    drift = F.aggregate(F.zip_with(ea, eb, lambda p, q: F.abs((p - ea[0]) - (q - eb[0]))), F.lit(0.0), lambda s, v: s + v) / F.size(ea)
    repeated = F.coalesce(F.col(f"{a}.headers") == F.coalesce(f"{b}.headers", f"{b}.first"), F.lit(False))
    points = [
        F.when((F.col(f"{a}.y1") > 0.7 * F.col(f"{a}.page_height")) & (F.col(f"{b}.y0") < 0.3 * F.col(f"{b}.page_height")), 0.15),
        F.when(F.abs(wide_a - wide_b) / F.greatest(wide_a, wide_b) <= 0.1, 0.15),
        F.when(F.abs(F.col(f"{a}.x0") - F.col(f"{b}.x0")) <= 8, 0.1),
        F.when((F.size(ea) == F.size(eb)) & (F.size(ea) > 0), F.when(drift <= 6, 0.2)),
        F.when(repeated, 0.3).when(F.col(f"{b}.headers").isNull(), 0.15).when(F.col(f"{a}.headers").isNotNull(), -0.3),
    ]
    total = reduce(lambda s, p: s + F.coalesce(p, F.lit(0.0)), points, F.lit(0.3))
    return F.when(F.col(f"{a}.n_cols") != F.col(f"{b}.n_cols"), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 2))


def continued(tables: DataFrame, key: str, least: float = 0.6, possible: float = 0.4) -> DataFrame:
    """Tables (key, order_no, page, part struct) with the number of the merged table they belong to, the score, and the maybes.

    A part is compared with the table right before it in the document if that one ends on the page before; a merged table keeps the
    columns, edges and headers of its first part, so a chain is scored against its first part's form and the last part's page.
    """
    by = Window.partitionBy(key).orderBy("order_no")
    near = F.coalesce(F.lag("page").over(by) + 1 == F.col("page"), F.lit(False))
    rows = tables.withColumns({"back": F.lag("part").over(by), "near": near}).withColumn("merge_score", F.when(F.col("near"), merge_score("back", "part")).otherwise(0.0))
    from paperloom.operators.blocks import islands

    joined = islands(rows, key, ["order_no"], F.col("merge_score") >= least)
    return joined.select(key, "order_no", "page", F.col("island").alias("table_no"), "merge_score", (F.col("merge_score").between(possible, least) & (F.col("merge_score") < least)).alias("possible_continuation"))
