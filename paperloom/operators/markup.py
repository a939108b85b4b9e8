"""HTML to blocks, blocks to Markdown, plain text and CSV rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entities that pages use.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Headings, paragraphs, list items and captions of a page in order, tags, scripts and navigation left out."""
    body = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<(script|style|nav|head)\b.*?</\1>", " ")
    # Block tags open a new piece that keeps its tag's name; other tags vanish.
    marked = F.regexp_replace(body, r"(?i)<(h[1-6]|p|li|figcaption|td|th|div|article|footer)\b[^>]*>", "\u0001$1\u0002")
    pieces = F.split(F.regexp_replace(marked, r"<[^>]*>", " "), "\u0001")
    rows = pages.select(key, F.posexplode(pieces).alias("pos", "piece"))
    tag = F.lower(F.substring_index("piece", "\u0002", 1))
    inner = F.when(F.contains(F.col("piece"), F.lit("\u0002")), F.substring_index("piece", "\u0002", -1)).otherwise(F.col("piece"))
    text = F.trim(F.regexp_replace(unescaped(inner), r"(?U)\s+", " "))
    kind = F.when(tag.rlike("^h[1-6]$"), "heading").when(tag == "li", "list").when(tag == "figcaption", "caption").when(tag == "footer", "footer").otherwise("paragraph")
    level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
    return rows.select(key, "pos", kind.alias("type"), level.alias("level"), text.alias("text")).filter("text != ''").withColumnRenamed("pos", "order_no")


def chunk(kind: Column, level: Column, text: Column) -> Column:
    """A block's Markdown; headers and footers have none."""
    t = F.trim(text)
    return (
        F.when(kind.isin("header", "footer"), None)
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.coalesce(level, F.lit(1))), F.lit(" "), t))
        .when(kind == "list", F.concat(F.lit("- "), t))
        .when(kind == "caption", F.concat(F.lit("*"), t, F.lit("*")))
        .otherwise(t)
    )


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    """One Markdown text for each document, chunks in order with a blank line between."""
    rows = blocks.withColumn("chunk", chunk(F.col("type"), F.col("level"), F.col("text"))).filter(F.col("chunk").isNotNull())
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("order_no", "chunk"))), lambda x: x["chunk"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("markdown"))


def pipe_tables(cells: DataFrame, key: str) -> DataFrame:
    """Pipe tables of cells (row, col, text); row 0 is the header."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    rows = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))).alias("c"))
    line = F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["t"]), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("c")))
    rows = rows.select(key, "row", F.when(F.col("row") == 0, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("line"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"])
    return rows.groupBy(key).agg(F.array_join(ordered, "\n").alias("markdown"))


def csv_field(value: Column) -> Column:
    """A field in quotes where it needs them."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(value, F.lit("")))
