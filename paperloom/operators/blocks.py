"""Operators over blocks and other ordered rows, each a composition of filters, joins, groups and windows.

``key`` is the column (or columns) of a document; everything that compares rows does so within it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

TEXT_TYPES = ("heading", "paragraph", "list", "caption", "footnote", "reference")


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each line that isn't blank, numbered from 1 as it stands in the text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.trim("line") != "").select(key, (F.col("pos") + 1).alias("order_no"), F.col("line").alias("text"))


def classified(rows: DataFrame) -> DataFrame:
    """Type of a line by its form: list item, caption, heading (short, without an end mark) or paragraph."""
    t = F.trim("text")
    kind = (
        F.when(t.rlike(r"^(?:[-*•]|\d+[.)])\s"), "list")
        .when(t.rlike(r"(?i)^(?:table|figure)\s+\d+\s*:"), "caption")
        .when((F.length(t) <= 110) & ~t.rlike(r"[.!?;:,]$"), "heading")
        .otherwise("paragraph")
    )
    return rows.withColumn("type", kind)


def pages_in(spec: str, page: str = "page") -> Column:
    """Predicate of a page list such as "1-3,5"; ranges may be written backwards, anything else is an error."""
    test = F.lit(False)
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not a page range: {part!r}")
        a, b = int(m[1]), int(m[2] or m[1])
        test = test | F.col(page).between(min(a, b), max(a, b))
    return test


def selected(blocks: DataFrame, types: tuple[str, ...] = (), pages: str | None = None, least: float | None = None) -> DataFrame:
    if types:
        blocks = blocks.filter(F.col("type").isin(*types))
    if pages:
        blocks = blocks.filter(pages_in(pages))
    return blocks.filter(F.col("confidence") >= least) if least is not None else blocks


def search(units: DataFrame, key: str, query: str, limit: int = 200) -> DataFrame:
    """Hits by block: first match, count over the block's units, snippet; ``limit`` hits a document after the total.

    ``units``: key, order_no (block), unit_no, text. One scan answers for all documents.
    """
    q = T.phrase(query)
    rows = units.withColumn("text", T.squeezed(F.col("text"))).withColumn("n", T.phrase_count(F.col("text"), q)).filter("n > 0")
    at = F.instr(F.lower(F.col("text")), q)
    first = F.struct("unit_no", F.substring("text", at, F.lit(len(q))).alias("matched"), T.snippet(F.col("text"), at, len(q)).alias("snippet"))
    hits = rows.groupBy(key, "order_no").agg(F.min(first).alias("first"), F.sum("n").alias("match_count"))
    by = Window.partitionBy(key)
    hits = hits.withColumn("total", F.count("*").over(by)).withColumn("rank", F.row_number().over(by.orderBy("order_no"))).filter(F.col("rank") <= limit)
    return hits.select(key, "order_no", F.col("first.matched").alias("matched"), F.col("first.snippet").alias("snippet"), "match_count", "total", (F.col("total") > limit).alias("truncated"))


def margins(rows: DataFrame, group: str, page: str, share: float = 0.4) -> DataFrame:
    """Lines that recur on max(2, share of the group's pages) pages or more, by their margin key."""
    pages = rows.groupBy(group).agg(F.countDistinct(page).alias("pages"))
    keys = rows.groupBy(group, T.margin_key(F.col("text")).alias("margin")).agg(F.countDistinct(page).alias("on_pages"))
    return keys.join(pages, group).filter((F.col("pages") >= 2) & (F.col("on_pages") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share)))).select(group, "margin", "on_pages")


def islands(rows: DataFrame, key: str, order: list[str], same: Column) -> DataFrame:
    """Numbers runs of rows: a new one starts where ``same`` (which may look back with lag) isn't true."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def clusters(rows: DataFrame, key: str, value: str, gap: float) -> DataFrame:
    """One-dimensional clusters: values nearer than ``gap`` to the one before belong together; mean and size."""
    w = Window.partitionBy(key).orderBy(value)
    marked = rows.withColumn("_back", F.lag(value).over(w))
    found = islands(marked, key, [value], (F.col(value) - F.col("_back")) <= gap)
    return found.groupBy(key, "island").agg(F.avg(value).alias("mean"), F.count("*").alias("members"))


def sections(rows: DataFrame, key: str, order: str, is_heading: Column, id_col: str) -> DataFrame:
    """Each row's latest heading, itself included (an as-of join without a join)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section_id", F.last(F.when(is_heading, F.col(id_col)), ignorenulls=True).over(w))


def parents(headings: DataFrame, key: str, order: str, level: str, id_col: str, levels: int = 6) -> DataFrame:
    """For each heading the nearest one before it of a smaller level."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None)
    for k in range(2, levels + 1):
        parent = F.when(F.col(level) == k, F.last(F.when(F.col(level) < k, F.col(id_col)), ignorenulls=True).over(w)).otherwise(parent)
    return headings.withColumn("parent_id", parent)


def nearest(left: DataFrame, right: DataFrame, key: str, place: str, id_col: str, within: float) -> DataFrame:
    """For each left row the nearest right row of its key within a distance; ties go to the smaller id."""
    r = right.select(key, F.col(place).alias("_place"), F.col(id_col).alias("target_id"))
    distance = F.abs(F.col(place) - F.col("_place"))
    pairs = left.join(r, key).filter(distance <= within).withColumn("distance", distance)
    best = pairs.groupBy(key, id_col).agg(F.min(F.struct("distance", "target_id")).alias("best"))
    return best.select(key, id_col, F.col("best.target_id").alias("target_id"), F.col("best.distance").alias("distance"))


def weighted_mode(rows: DataFrame, key: str, value: str, weight: str, order: str) -> DataFrame:
    """The value with the greatest weight; of equals the one that comes first."""
    sums = rows.groupBy(key, value).agg(F.sum(weight).alias("w"), F.min(order).alias("seen"))
    return sums.groupBy(key).agg(F.max_by(F.struct(value, "w"), F.struct("w", -F.col("seen"))).alias("best")).select(key, f"best.{value}", F.col("best.w").alias("weight"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: the state that a log of events leaves."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def dense_grid(cells: DataFrame, key: str) -> DataFrame:
    """Every (row, col) of the used rectangle of each key, empty ones with null text."""
    used = cells.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))])
    grid = used.select(key, F.explode(F.sequence("min_row", "max_row")).alias("row"), "min_col", "max_col").select(key, "row", F.explode(F.sequence("min_col", "max_col")).alias("col"))
    return grid.join(cells, [key, "row", "col"], "left")


def totals(items: DataFrame, key: str, printed: DataFrame, unit: str = "0.01") -> DataFrame:
    """Checks printed totals against exact sums: expected, extracted, difference, and whether rounding explains it.

    ``items``: key, value decimal. ``printed``: key, total decimal. Totals of fewer than two items aren't checked.
    """
    from paperloom.functions.numbers import tolerance

    sums = items.groupBy(key).agg(F.sum("value").alias("expected"), F.count("value").alias("terms")).filter("terms >= 2")
    out = sums.join(printed, key)
    step = F.lit(unit).cast("decimal(10,6)")
    return out.select(key, "expected", F.col("total").alias("extracted"), (F.col("total") - F.col("expected")).alias("difference"), (F.abs(F.col("total") - F.col("expected")) <= tolerance(step, F.col("terms"), F.col("total"))).alias("passed"))


def ranked_sentences(blocks: DataFrame, key: str, order: str, top: int = 3) -> DataFrame:
    """The best sentences of each document by the frequency of their terms, repeats of a sentence left out.

    Score: sum of the terms' frequencies over length ** 0.7, and 1.15 times that for the first three.
    """
    pieces = blocks.select(key, order, F.explode(T.sentences(F.col("text"))).alias("x")).select(key, order, F.col("x.i").alias("i"), F.col("x.sentence").alias("sentence"))
    w = Window.partitionBy(key).orderBy(order, "i")
    pieces = pieces.withColumn("seq", F.row_number().over(w) - 1).withColumn("terms", T.terms(F.col("sentence")))
    each = pieces.select(key, "seq", F.explode("terms").alias("term"))
    frequency = each.groupBy(key, "term").agg(F.count("*").alias("f"))
    sums = each.join(frequency, [key, "term"]).groupBy(key, "seq").agg(F.sum("f").alias("f"))
    size = F.size("terms")
    scored = pieces.join(sums, [key, "seq"]).withColumn("score", F.col("f") / F.pow(size.cast("double"), F.lit(0.7)) * F.when(F.col("seq") < 3, 1.15).otherwise(1.0))
    once = scored.withColumn("copy", F.row_number().over(Window.partitionBy(key, F.lower("sentence")).orderBy(F.desc("score"), "seq"))).filter("copy = 1")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "seq"))).filter(F.col("rank") <= top).select(key, "seq", "sentence", "score", "rank")
