"""Documents as JSON, Markdown, text and CSV, and the units that a search looks through.

Blocks: key, order_no, id, type, page, confidence, status, review_reason, text, and by type ``ordered`` and ``items`` (lists), ``latex``
(equations), ``chart`` (struct with chart_type, title, ...), ``caption`` (figures). Cells: key, id, row, col, text, is_header.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from paperloom.operators.markup import csv_field

CELL_WIDTH = 60


def _lines(items: Column, mark) -> Column:
    return F.array_join(F.transform(items, mark), "\n")


def clipped(text: Column, width: int) -> Column:
    """Single-spaced text of at most ``width`` characters, the last one dots where it was longer."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(t) > width, F.concat(F.left(t, F.lit(width - 1)), F.lit("…"))).otherwise(t)


def grids(cells: DataFrame, key: str, width: int = CELL_WIDTH) -> DataFrame:
    """(key, id, text): tables as text, columns padded to their widest cell, a rule under the header rows."""
    t = cells.withColumn("_t", clipped(F.col("text"), width))
    t = t.withColumn("_w", F.greatest(F.lit(1), F.max(F.length("_t")).over(Window.partitionBy(key, "id", "col"))))
    cell = F.struct("col", F.rpad("_t", F.col("_w"), F.lit(" ")).alias("t"), F.repeat(F.lit("─"), F.col("_w")).alias("r"))
    rows = t.groupBy(key, "id", "row").agg(F.array_sort(F.collect_list(cell)).alias("c"), F.bool_or("is_header").alias("head"))
    rows = rows.withColumn("_ends", F.col("head") & ~F.coalesce(F.lead("head").over(Window.partitionBy(key, "id").orderBy("row")), F.lit(False)))
    line = F.rtrim(F.array_join(F.transform("c", lambda x: x["t"]), " │ "))
    rule = F.array_join(F.transform("c", lambda x: x["r"]), "─┼─")
    shown = F.when(F.col("_ends"), F.concat(line, F.lit("\n"), rule)).otherwise(line)
    return rows.groupBy(key, "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", shown.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def plain_text() -> Column:
    """A block as text; tables need their grid in ``grid``."""
    kind = F.col("type")
    return (
        F.when(kind == "list", _lines(F.coalesce("items", F.array().cast("array<string>")), lambda x: F.concat(F.lit("• "), x)))
        .when(kind == "table", F.coalesce("grid", F.lit("")))
        .when(kind == "equation", F.coalesce(F.concat(F.lit("$$ "), F.col("latex"), F.lit(" $$")), F.col("text"), F.lit("")))
        .when(kind == "chart", F.concat(F.coalesce("chart.chart_type", F.lit("chart")), F.coalesce(F.concat(F.lit(": "), F.col("chart.title")), F.lit(""))))
        .when(kind == "figure", F.concat(F.lit("[figure]"), F.coalesce(F.concat(F.lit(" "), F.col("caption")), F.lit(""))))
        .otherwise(F.coalesce("text", F.lit("")))
    )


def text_export(blocks: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """One text a document, a blank line between blocks."""
    rows = blocks.join(grids(cells, key).withColumnRenamed("text", "grid"), [key, "id"], "left").withColumn("_t", plain_text())
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_no", "_t"))), lambda x: x["_t"]), "\n\n").alias("text"))


def block_csv(blocks: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """CSV lines (key, order_no, line) of blocks: id, type, page, confidence, content with line feeds shown; line 0 is the header."""
    rows = blocks.join(grids(cells, key).withColumnRenamed("text", "grid"), [key, "id"], "left").withColumn("_t", F.replace(plain_text(), F.lit("\n"), F.lit(" ⏎ ")))
    fields = [csv_field(F.coalesce(c.cast("string"), F.lit(""))) for c in (F.col("id"), F.col("type"), F.col("page"), F.col("confidence"), F.col("_t"))]
    head = blocks.select(key).distinct().select(key, F.lit(0).cast("long").alias("order_no"), F.lit("﻿id,type,page,confidence,content").alias("line"))
    return head.unionByName(rows.select(key, F.col("order_no").cast("long").alias("order_no"), F.concat_ws(",", *fields).alias("line")))


def table_csv(blocks: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """CSV lines (key, order_no, row, line) of tables: a "# id (p.n)" line in row -1, then the cells; an empty one between tables."""
    tables = blocks.filter("type = 'table'").select(key, "id", "order_no", "page")
    rows = cells.groupBy(key, "id", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", csv_field(F.coalesce("text", F.lit(""))).alias("t")))), lambda x: x["t"]), ",").alias("line"))
    body = tables.join(rows, [key, "id"]).select(key, "order_no", "row", "line")
    later = F.row_number().over(Window.partitionBy(key).orderBy("order_no")) > 1
    head = tables.withColumn("_later", later)
    titles = head.select(key, "order_no", F.lit(-1).alias("row"), csv_field(F.concat(F.lit("# "), "id", F.lit(" (p."), F.col("page").cast("string"), F.lit(")"))).alias("line"))
    return titles.unionByName(head.filter("_later").select(key, "order_no", F.lit(-2).alias("row"), F.lit("").alias("line"))).unionByName(body)


def json_documents(documents: DataFrame, children: dict[str, tuple[DataFrame, list[str]]], key: str) -> DataFrame:
    """(key, json): each document with its children as ordered arrays, indented, fields in the columns' order.

    ``children``: name to (rows, order columns). Numbers that JSON lacks (NaN, infinities) are an error, as are they in nested rows.
    """
    out = documents
    for name, (rows, order) in children.items():
        fields = [c for c in rows.columns if c != key]
        ranked = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
        sides = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["v"]).alias(name))
        out = out.join(sides, key, "left").withColumn(name, F.coalesce(name, F.array()))
    text = F.to_json(F.struct(*out.columns), {"pretty": "true", "ignoreNullFields": "false"})
    bad = reduce(lambda x, y: x | y, [_endless(F.col(f.name), f.dataType) for f in out.schema.fields])
    return out.select(key, F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("NaN and infinities have no JSON form"))).otherwise(text).alias("json"))


def _endless(value: Column, kind: DataType) -> Column:
    """Whether a value holds a NaN or an infinity, at any depth."""
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))
    if isinstance(kind, ArrayType) and _fractions(kind):
        return F.coalesce(F.exists(value, lambda v: _endless(v, kind.elementType)), F.lit(False))
    if isinstance(kind, MapType) and _fractions(kind):
        return F.coalesce(F.exists(F.map_values(value), lambda v: _endless(v, kind.valueType)), F.lit(False))
    if isinstance(kind, StructType) and _fractions(kind):
        return reduce(lambda x, y: x | y, [_endless(value[f.name], f.dataType) for f in kind.fields])
    return F.lit(False)


def _fractions(kind: DataType) -> bool:
    return any(t in kind.simpleString() for t in ("double", "float"))


def review_comment() -> Column:
    """The Markdown comment of a block that needs review, else null."""
    reason = F.coalesce("review_reason", F.lit("low confidence"))
    return F.when(F.col("status") == "REVIEW_REQUIRED", F.concat(F.lit("<!-- REVIEW_REQUIRED "), "id", F.lit(" p."), F.col("page").cast("string"), F.lit(": "), reason, F.lit(" -->")))


def search_units(blocks: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """(key, order_no, id, unit_no, text): what a phrase must lie in: items, cells, raw and LaTeX text, chart labels, or the block's text."""
    kind = F.col("type")
    chart = F.concat(F.array("chart.title", "chart.x_label", "chart.y_label"), F.coalesce("chart.categories", F.array().cast("array<string>")), F.coalesce("chart.series", F.array().cast("array<string>")))
    parts = F.when(kind == "list", F.col("items")).when(kind == "equation", F.array("text", "latex")).when(kind == "chart", chart).otherwise(F.array("text"))
    units = blocks.filter("type <> 'table'").select(key, "order_no", "id", F.posexplode(parts).alias("unit_no", "text"))
    of_cells = cells.join(blocks.filter("type = 'table'").select(key, "id", "order_no"), [key, "id"])
    # Cells count row by row with room for the widest table.
    place = F.row_number().over(Window.partitionBy(key, "id").orderBy("row", "col")) - 1
    return units.unionByName(of_cells.select(key, "order_no", "id", place.alias("unit_no"), "text")).filter("trim(text) <> ''")


def provenance(blocks: DataFrame, filename: Column) -> DataFrame:
    """Blocks with ``provenance``: document, page, box, extractor, and the sources kept through merges (the block itself without any)."""
    own = F.struct(F.col("page"), F.col("bbox"))
    sources = F.when(F.size(F.coalesce("sources", F.array())) > 0, F.col("sources")).otherwise(F.array(own))
    return blocks.withColumn("provenance", F.struct(filename.alias("document"), "page", "bbox", "extractor", sources.alias("sources")))
