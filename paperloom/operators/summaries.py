"""Extractive summaries of documents: counts, title, sections, key points, and a nested record for each document.

Every sentence stands in the document as it is given; blocks that were read badly are left out while there are better ones.
Blocks: key, order_no, page, type, text, level, confidence, confidence_level, status (lists: items joined by line feeds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import numbers as N
from paperloom.functions import text as T
from paperloom.operators.blocks import TEXT_TYPES

EXECUTIVE, POINTS, MORE_POINTS, SECTIONS = 3, 6, 2, 20


def is_low() -> Column:
    return (F.col("confidence_level") == "LOW") | F.col("status").isin("REVIEW_REQUIRED", "FAILED") | (F.col("confidence") < N.REVIEW)


def statistics(blocks: DataFrame, key: str) -> DataFrame:
    words = F.when(F.col("type").isin(*TEXT_TYPES) & (F.trim("text") != ""), F.size(F.split(T.squeezed(F.col("text")), " "))).otherwise(0)
    named = {"tables": "table", "figures": "figure", "charts": "chart", "equations": "equation"}
    return blocks.groupBy(key).agg(
        F.count_if(F.col("type").isin(*TEXT_TYPES)).alias("text_blocks"), *[F.count_if(F.col("type") == v).alias(k) for k, v in named.items()], F.sum(words).alias("words"),
        F.count_if(F.col("confidence_level") == "LOW").alias("low_confidence_blocks"), F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review_required_blocks"),
        F.count_if((F.col("status") == "REVIEW_REQUIRED") | (F.col("confidence_level") == "LOW")).alias("left_out"), F.count("*").alias("total_blocks"),
    )


def titles(blocks: DataFrame, key: str) -> DataFrame:
    """The first heading of the smallest level in each document."""
    heads = blocks.filter("type = 'heading' AND trim(text) <> ''").withColumn("low", is_low())
    best = F.min_by(F.struct(T.squeezed(F.col("text")).alias("text"), "order_no", "page", F.col("low").alias("uncertain")), F.struct(F.coalesce("level", F.lit(1)), "order_no"))
    return heads.groupBy(key).agg(best.alias("title"))


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """Headings of the two smallest levels in document order, twenty a document."""
    heads = blocks.filter("type = 'heading' AND trim(text) <> ''").withColumn("level", F.coalesce("level", F.lit(1)))
    ranked = heads.withColumn("_rank", F.dense_rank().over(Window.partitionBy(key).orderBy("level"))).filter("_rank <= 2")
    first = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("order_no"))).filter(F.col("_n") <= SECTIONS)
    return first.select(key, "order_no", "page", "level", T.squeezed(F.col("text")).alias("text"), is_low().alias("uncertain"))


def scored_sentences(blocks: DataFrame, key: str) -> DataFrame:
    """Sentences of paragraphs and lists, repeats once, with score and rank; those of doubtful blocks only where there are no others.

    Score: frequency of the terms over (number of terms) ** 0.7, up to a quarter more for terms of headings, 1.15 times for the first three.
    """
    text = blocks.filter("type IN ('paragraph', 'list')").withColumn("uncertain", F.coalesce(is_low(), F.lit(False)))
    lines = text.select(key, "order_no", "page", "confidence", "uncertain", F.posexplode(F.when(F.col("type") == "list", F.split("text", "\n")).otherwise(F.array("text"))).alias("item", "line"))
    pieces = lines.select(key, "order_no", "page", "confidence", "uncertain", "item", F.explode(T.sentences(F.col("line"))).alias("x")).select("*", "x.i", F.col("x.sentence").alias("text")).drop("x")
    whole = Window.partitionBy(key)
    pieces = pieces.withColumn("_sure", F.bool_or(~F.col("uncertain")).over(whole)).filter("NOT (_sure AND uncertain)")
    pieces = pieces.withColumn("seq", F.row_number().over(whole.orderBy("order_no", "item", "i")) - 1).withColumn("terms", T.terms(F.col("text")))
    each = pieces.select(key, "seq", F.explode("terms").alias("term"))
    heads = blocks.filter("type = 'heading'").select(key, F.explode(T.terms(F.col("text"))).alias("term")).distinct().withColumn("_head", F.lit(1))
    known = each.groupBy(key, "term").agg(F.count("*").alias("f")).join(heads, [key, "term"], "left")
    sums = each.join(known, [key, "term"]).groupBy(key, "seq").agg(F.sum("f").alias("f"), F.count_distinct(F.when(F.col("_head") == 1, F.col("term"))).alias("heads"), F.count_distinct("term").alias("kinds"))
    rows = pieces.join(sums, [key, "seq"], "left")
    base = F.coalesce(F.col("f") / F.pow(F.size("terms").cast("double"), F.lit(0.7)), F.lit(0.0))
    score = base * (1 + 0.25 * F.coalesce(F.col("heads") / F.col("kinds"), F.lit(0.0))) * F.when(F.col("seq") < 3, 1.15).otherwise(1.0)
    rows = rows.withColumn("score", score)
    once = rows.withColumn("_copy", F.row_number().over(Window.partitionBy(key, F.lower("text")).orderBy(F.desc("score"), "seq"))).filter("_copy = 1")
    ranked = once.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("score"), "seq")))
    return ranked.select(key, "order_no", "page", "seq", "text", "confidence", "uncertain", "score", "rank")


def table_point(caption: Column, n_rows: Column, n_cols: Column, heads: Column) -> Column:
    """What a summary says of a table: caption, shape, and up to six column names."""
    shape = F.concat(F.coalesce(F.concat(caption, F.lit(": ")), F.lit("Table: ")), n_rows.cast("string"), F.lit(" rows x "), n_cols.cast("string"), F.lit(" columns"))
    named = F.filter(F.coalesce(heads, F.array().cast("array<string>")), lambda h: F.trim(h) != "")
    return F.concat(shape, F.when(F.size(named) > 0, F.concat(F.lit(" (columns: "), F.array_join(F.slice(named, 1, 6), ", "), F.lit(")"))).otherwise(""))


def summaries(documents: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """One nested record a document: status, title, executive_summary, executive, key_points, sections, statistics, warnings.

    ``documents``: key, page_count, source_kind. A table's or chart's ``text`` is what its point says. Documents without blocks are
    "empty", those with doubtful sentences only "uncertain".
    """
    ranked = scored_sentences(blocks, key).filter(F.col("rank") <= EXECUTIVE + POINTS)
    point = F.struct("order_no", "seq", "text", "page", "confidence", "uncertain")

    def ordered(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, point)))

    picked = ranked.groupBy(key).agg(ordered(F.col("rank") <= EXECUTIVE).alias("executive"), ordered(F.col("rank") > EXECUTIVE).alias("sentences"), F.bool_and("uncertain").alias("low_only"))
    facts = blocks.filter("type IN ('table', 'chart') AND text IS NOT NULL").withColumn("uncertain", F.coalesce(is_low(), F.lit(False)))
    facts = facts.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("order_no"))).filter(F.col("seq") <= POINTS + MORE_POINTS)
    facts = facts.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("facts"))
    parts = sections(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("order_no", "text", "level", "page", "uncertain"))).alias("sections"))
    out = documents.join(statistics(blocks, key), key, "left")
    for side in (titles(blocks, key), picked, facts, parts):
        out = out.join(side, key, "left")
    points = F.concat(F.coalesce("sentences", F.array()), F.slice(F.coalesce("facts", F.array()), F.lit(1), F.greatest(F.lit(0), POINTS + MORE_POINTS - F.coalesce(F.size("sentences"), F.lit(0)))))
    names = F.slice(F.transform(F.filter("sections", lambda s: ~s["uncertain"]), lambda s: s["text"]), 1, 5)
    counted = [F.when(n > 0, F.concat(n.cast("string"), F.lit(w))) for n, w in ((F.col("tables"), " table(s)"), (F.col("figures") + F.col("charts"), " figure(s)/chart(s)"), (F.col("equations"), " equation(s)"))]
    having = F.concat_ws(", ", *counted)
    head = F.concat(
        F.coalesce(F.when(~F.col("title.uncertain"), F.concat(F.col("title.text"), F.lit(": "))), F.lit("")), F.col("page_count").cast("string"), F.lit("-page "),
        F.coalesce(F.concat("source_kind", F.lit(" ")), F.lit("")), F.lit("document"), F.when(having != "", F.concat(F.lit(" with "), having)).otherwise(""),
        F.when(F.size(names) > 0, F.concat(F.lit(". Main sections: "), F.array_join(names, "; "), F.lit("."))).otherwise("."),
    )
    none = F.col("executive").isNull()
    said = F.concat_ws(" ", head, F.array_join(F.transform("executive", lambda s: s["text"]), " "), F.when(none, "No complete sentences were extracted, so no main-content sentences are shown."))
    empty = F.col("total_blocks").isNull()
    low = F.coalesce("low_only", F.lit(False))
    warning = F.when(low, "All extracted text is low confidence; the sentences shown may be inaccurate and need review.").when(
        F.col("left_out") > 0, F.concat(F.col("left_out").cast("string"), F.lit(" low-confidence or review-required block(s) were left out of the executive summary and key points."))
    )
    stats = ("text_blocks", "tables", "figures", "charts", "equations", "words", "low_confidence_blocks", "review_required_blocks", "total_blocks")
    return out.select(
        key, F.when(empty, "empty").when(low, "uncertain").otherwise("ok").alias("status"), "title",
        F.when(empty, "No content was extracted from this document, so no summary can be given.").otherwise(said).alias("executive_summary"),
        "executive", points.alias("key_points"), "sections", F.struct(F.col("page_count").alias("pages"), *[F.coalesce(c, F.lit(0)).alias(c) for c in stats]).alias("statistics"),
        F.array_compact(F.array(warning)).alias("warnings"),
    )
