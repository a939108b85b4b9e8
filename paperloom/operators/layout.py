"""Operators over boxes on pages: reading order, paragraphs of lines, text that goes on behind a break, captions, overlapping boxes.

Blocks are rows (key, page, id, type, x0, y0, x1, y1 in points, y downwards); a block without a box has nulls there. All work is within
a page or a document; a page's blocks are the largest unit that one task must hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.blocks import islands

GUTTER = 10  # points of white space that part two columns
SPAN = 0.65  # share of the content's width from which a block spans the columns
SIDE = 0.25  # share of it under which a column is a side bar, read after the rest
MARGINS = ("header", "footer", "footnote")

# How a finished paragraph ends, how list items, numbered headings and headings of references begin.
TERMINAL = r"[.!?:;\"”’)\]]$"
BULLET = r"^\s*(?:[-*•–▪◦]|\d+[.)]|[a-z][.)])\s+"
REFERENCES = r"(?i)^\s*(references|bibliography|works cited|citations)\s*$"
NUMBERED = r"^\s*(\d+(?:\.\d+)*)[.)]?\s"


def gutters(body: DataFrame, page: list[str]) -> DataFrame:
    """(page, gutters array<struct<g0, g1>>): runs of GUTTER points or more that little text covers, with text on both sides.

    Little is at most 0.3 of the median height that covers a point.
    """
    # The key's columns may have any names, those of the columns made here too.
    inner = [f"_page{k}" for k in range(len(page))]
    body = body.select(*[F.col(c).alias(i) for c, i in zip(page, inner, strict=True)], "x0", "y0", "x1", "y1")
    high = F.col("y1") - F.col("y0")
    # A box covers whole points; each is an event where it begins and one behind its end, whatever its width.
    ends = F.array(F.struct(F.col("x0").cast("int").alias("x"), high.alias("d")), F.struct((F.col("x1").cast("int") + 1).alias("x"), (-high).alias("d")))
    on_page = Window.partitionBy(*inner)
    by_x = on_page.orderBy("x")
    cover = body.filter("x0 IS NOT NULL AND x1 IS NOT NULL").select(*inner, F.explode(ends).alias("e")).select(*inner, "e.*")
    cover = cover.select(*inner, "x", F.round(F.sum("d").over(by_x.rangeBetween(Window.unboundedPreceding, 0)), 6).alias("h"), F.lead("x").over(by_x).alias("end"))
    cover = cover.withColumn("n", F.col("end") - F.col("x")).filter("n > 0 AND h > 0")
    # The median over points, from runs of points: the runs up to the middle place, and up to the next one for even counts.
    up_to = F.sum("n").over(on_page.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    cover = cover.withColumns({"up_to": up_to, "points": F.sum("n").over(on_page)})
    lower, upper = (F.min(F.when(F.col("up_to") >= k, F.col("h"))).over(on_page) for k in (F.ceil(F.col("points") / 2), F.floor(F.col("points") / 2) + 1))
    dense = cover.withColumn("middle", (lower + upper) / 2).filter("h > 0.3 * middle").withColumn("next", F.lead("x").over(by_x))
    found = dense.filter(F.col("next") - F.col("end") >= GUTTER)
    found = found.groupBy(*inner).agg(F.array_sort(F.collect_list(F.struct(F.col("end").cast("double").alias("g0"), F.col("next").cast("double").alias("g1")))).alias("gutters"))
    return found.withColumnsRenamed(dict(zip(inner, page, strict=True)))


def reading_order(blocks: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """Blocks with ``place`` (1, 2, ... within a page) and ``ambiguous`` (of the page).

    Headers come first, footnotes, footers and blocks without a box last. Blocks that span the columns cut a page into bands; a band is
    read column by column, side bars last, each from top to bottom. A page is ambiguous if two blocks that don't span overlap.
    Ties go to the smaller id; pages without boxes keep the order of ids.
    """
    page = [key, "page"]
    boxed = F.col("x0").isNotNull()
    zone = F.when(~boxed, 4).when(F.col("type") == "header", 0).when(F.col("type") == "footnote", 2).when(F.col("type") == "footer", 3).otherwise(1)
    rows = blocks.withColumn("_zone", zone)
    body = rows.filter("_zone = 1")
    on_page = Window.partitionBy(*page)
    body = body.join(gutters(body, page), page, "left").withColumn("gutters", F.coalesce("gutters", F.array().cast("array<struct<g0:double,g1:double>>")))
    wide = (F.col("x1") - F.col("x0")) >= SPAN * (F.max("x1").over(on_page) - F.min("x0").over(on_page))
    across = F.exists("gutters", lambda g: (F.col("x0") < g["g1"] - 2) & (F.col("x1") > g["g0"] + 2))
    body = body.withColumn("_spans", wide | across)
    middle = (F.col("y0") + F.col("y1")) / 2
    cuts = F.collect_list(F.when(F.col("_spans"), F.struct("y0", F.col(id_col).alias("id"), middle.alias("m")))).over(on_page)
    body = body.withColumn("_cuts", F.array_sort(cuts))
    # A block belongs before the first spanning block whose middle lies below its own.
    own = F.array_position(F.transform("_cuts", lambda c: c["id"]), F.col(id_col))
    first = F.array_position(F.transform("_cuts", lambda c: c["m"] > middle), True)
    band = F.when(F.col("_spans"), own).when(first > 0, first).otherwise(F.size("_cuts") + 1)
    centre = (F.col("x0") + F.col("x1")) / 2
    column = F.size(F.filter("gutters", lambda g: (g["g0"] + g["g1"]) / 2 <= centre))
    body = body.withColumns({"_band": band, "_col": F.when(F.col("_spans"), -1).otherwise(column)})
    in_band, in_col = Window.partitionBy(*page, "_band", "_spans"), Window.partitionBy(*page, "_band", "_spans", "_col")
    width = F.max("x1").over(in_col) - F.min("x0").over(in_col)
    total = F.max("x1").over(in_band) - F.min("x0").over(in_band)
    narrow = F.when(total > 0, width / total < SIDE).otherwise(False)
    body = body.withColumn("_side", narrow)
    # Within a band its blocks come before the spanning block that ends it.
    keys = body.select(*page, id_col, "_band", "_spans", "_side", "_col")
    rest = body.filter("NOT _spans").select(*page, F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    # Equal boxes' ids part a pair, so each pair of a page is met once.
    pairs = rest.alias("a").join(rest.alias("b"), page).filter("a._id < b._id")
    over = (F.least("a._x1", "b._x1") - F.greatest("a._x0", "b._x0") > 0) & (F.least("a._y1", "b._y1") - F.greatest("a._y0", "b._y0") > 2)
    doubtful = pairs.filter(over).select(*page).distinct().withColumn("ambiguous", F.lit(True))
    out = rows.join(keys, [*page, id_col], "left").join(doubtful, page, "left").fillna(False, ["ambiguous"])
    order = Window.partitionBy(*page).orderBy("_zone", F.coalesce("_band", F.lit(0)), F.coalesce("_spans", F.lit(False)), "_side", "_col", "y0", "x0", id_col)
    return out.withColumn("place", F.row_number().over(order)).drop("_zone", "_band", "_spans", "_side", "_col")


def paragraphs(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """Lines with the number of their paragraph: a new one after a gap, a change of size, at a bullet, beside, or above.

    ``lines``: key, order, text, size, x0, y0, x1, y1.
    """
    by = Window.partitionBy(*key).orderBy(order)
    rows = lines.withColumn("_p", F.lag(F.struct("x0", "y0", "x1", "y1", "size")).over(by))
    p = F.col("_p")
    high = F.greatest(p["y1"] - p["y0"], F.lit(1.0))
    side = ((F.least(F.col("y1"), p["y1"]) - F.greatest(F.col("y0"), p["y0"])) > 0.5 * high) & (F.col("x0") - p["x1"] > 20)
    new = (F.col("y0") - p["y1"] > 0.45 * high) | (F.abs(F.col("size") - p["size"]) > 1) | F.col("text").rlike(BULLET) | side | (F.col("y0") < p["y0"] - 2 * high)
    rows = rows.withColumn("_new", F.when(p.isNull() | new, 1).otherwise(0))
    return rows.withColumn("paragraph_no", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_p", "_new")


def joined_lines(lines: Column) -> Column:
    """Lines as one text; a hyphen behind a letter goes if the next line starts in lower case."""

    def add(text: Column, line: Column) -> Column:
        broken = text.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}")
        return F.when(text == "", line).when(broken, F.concat(F.left(text, F.length(text) - 1), line)).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(F.transform(lines, F.trim), F.lit(""), add)


def grouped(lines: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each paragraph of ``paragraphs``: text, box, mean size weighted by characters, number of lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    chars = F.length("text")
    return lines.groupBy(*key, "paragraph_no").agg(
        joined_lines(ordered).alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.round(F.try_divide(F.sum(F.col("size") * chars), F.sum(chars)), 3).alias("size"), F.count("*").alias("n_lines"),
    )


def continued_text(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Paragraphs that go on behind a page or column break become one; other blocks stay.

    ``blocks``: key, order, page, type, text, x0, y0, x1, y1. A paragraph goes on if the one before (margins left out) doesn't end
    like a sentence and it starts in lower case, or if that one ends in a hyphen; on the same page only if it starts to the right and
    higher up. The first part's place is kept; n_parts, first_page and last_page tell the extent.
    """
    margin = F.col("type").isin(*MARGINS)
    by = Window.partitionBy(key).orderBy(order)
    rows = blocks.filter(~margin).withColumn("_p", F.lag(F.struct("type", "text", "page", "x1", "y0")).over(by))
    p = F.col("_p")
    hyphen = p["text"].endswith("-")
    open_end = hyphen | (~p["text"].rlike(TERMINAL) & F.col("text").rlike(r"^\p{Ll}"))
    jump = (F.col("page") != p["page"]) | ((F.col("x0") > p["x1"] - 5) & (F.col("y0") < p["y0"]))
    goes_on = (p["type"] == "paragraph") & (F.col("type") == "paragraph") & (F.col("text") != "") & (p["text"] != "") & open_end & jump
    chained = islands(rows.withColumn("_on", F.coalesce(goes_on, F.lit(False))), key, [order], F.col("_on"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])

    def add(text: Column, part: Column) -> Column:
        return F.when(text.isNull(), part).when(text.endswith("-"), F.concat(F.left(text, F.length(text) - 1), part)).otherwise(F.concat(text, F.lit(" "), part))

    merged = chained.groupBy(key, "island").agg(
        F.min(order).alias(order), F.min_by("type", order).alias("type"), F.aggregate(parts, F.lit(None).cast("string"), add).alias("text"),
        F.count("*").alias("n_parts"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
    ).drop("island")
    kept = blocks.filter(margin).select(key, order, "type", "text", F.lit(1).cast("long").alias("n_parts"), F.col("page").alias("first_page"), F.col("page").alias("last_page"))
    return merged.unionByName(kept)


def marked_references(blocks: DataFrame, key: str, order: str) -> DataFrame:
    """Long paragraphs and lists behind a heading of references, up to the next heading, become references."""
    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = F.coalesce(F.last(F.when(F.col("type") == "heading", F.col("text").rlike(REFERENCES)), ignorenulls=True).over(by), F.lit(False))
    counts = ((F.col("type") == "paragraph") & (F.length("text") > 20)) | (F.col("type") == "list")
    return blocks.withColumn("_in", within).withColumn("type", F.when(F.col("_in") & counts, "reference").otherwise(F.col("type"))).drop("_in")


def heading_levels(headings: DataFrame, key: str, text: str = "text", size: str = "size") -> DataFrame:
    """Headings with a level up to 6: the depth of their number, else the rank of their size (to half a point), largest first."""
    half = F.round(F.coalesce(F.col(size), F.lit(0.0)) * 2) / 2
    number = F.regexp_extract(text, NUMBERED, 1)
    rank = F.dense_rank().over(Window.partitionBy(key).orderBy(F.desc("_half")))
    depth = F.size(F.split(number, r"\."))
    return headings.withColumn("_half", half).withColumn("level", F.least(F.lit(6), F.when(number != "", depth).otherwise(rank))).drop("_half")


def caption_targets(blocks: DataFrame, key: str, id_col: str = "id", within: float = 55.0) -> DataFrame:
    """(key, page, caption id, target id, distance): the nearest table, figure or chart above or below each caption.

    Captions that begin with "table" go to tables only, others to none. Ties go to the smaller id.
    """
    page = [key, "page"]
    captions = blocks.filter("type = 'caption' AND x0 IS NOT NULL").select(*page, F.col(id_col), F.lower("text").startswith("table").alias("_table"), *[F.col(c).alias(f"c_{c}") for c in ("x0", "y0", "x1", "y1")])
    targets = blocks.filter("type IN ('table', 'figure', 'chart') AND x0 IS NOT NULL").select(*page, F.col(id_col).alias("target_id"), (F.col("type") == "table").alias("_table"), "x0", "y0", "x1", "y1")
    pairs = captions.join(targets, [*page, "_table"])
    distance = F.least(F.abs(F.col("c_y0") - F.col("y1")), F.abs(F.col("y0") - F.col("c_y1")))
    beside = F.least("c_x1", "x1") - F.greatest("c_x0", "x0") >= -30
    clear = (F.col("c_y0") >= F.col("y1") - 3) | (F.col("c_y1") <= F.col("y0") + 3)
    near = pairs.filter(beside & clear & (distance < within)).withColumn("distance", distance)
    best = near.groupBy(*page, id_col).agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return best.select(*page, id_col, F.col("b.target_id").alias("target_id"), F.col("b.distance").alias("distance"))


def merged_boxes(boxes: DataFrame, page: list[str], pad: float = 4.0) -> DataFrame:
    """Boxes that overlap after padding, until none does any more: the unions, with their number of members.

    The unions of a page grow until nothing changes, which joins can't say in a fixed number of steps; a page's boxes fit in a task.
    """
    import pandas as pd

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        todo = [(r.x0, r.y0, r.x1, r.y1, 1) for r in rows.sort_values(["y0", "x0", "y1", "x1"]).itertuples()]
        done: list[tuple] = []
        while todo:
            a = todo.pop()
            hit = next((i for i, b in enumerate(done) if a[0] - pad <= b[2] and b[0] - pad <= a[2] and a[1] - pad <= b[3] and b[1] - pad <= a[3]), None)
            if hit is None:
                done.append(a)
            else:  # the union may reach others, so it starts again
                b = done.pop(hit)
                todo.append((min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4]))
        out = pd.DataFrame(sorted(done), columns=["x0", "y0", "x1", "y1", "members"])
        for c in reversed(page):
            out.insert(0, c, rows[c].iloc[0])
        return out

    fields = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in page)
    return boxes.select(*page, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]).groupBy(*page).applyInPandas(merge, f"{fields}, x0 double, y0 double, x1 double, y1 double, members long")


def scan_decision(pages: DataFrame, least: int = 25, sparse: int = 150) -> DataFrame:
    """Pages (text, image_coverage) with text_chars, garbled and is_scanned: too little, unreadable, or a picture with little text."""
    text = F.coalesce("text", F.lit(""))
    chars = F.length(F.trim(text))
    odd = F.length(F.regexp_replace(text, r"[^�\x00-\x08\x0B\x0C\x0E-\x1F]", ""))
    garbled = F.coalesce(F.try_divide(odd, F.length(text)) > 0.2, F.lit(False))
    rows = pages.withColumns({"text_chars": chars, "garbled": garbled})
    return rows.withColumn("is_scanned", (F.col("text_chars") < least) | F.col("garbled") | ((F.coalesce("image_coverage", F.lit(0.0)) >= 0.8) & (F.col("text_chars") < sparse)))


def image_coverage(images: DataFrame, page: list[str]) -> DataFrame:
    """Share of each page that its images cover, at most 1; images: page, x0, y0, x1, y1, width, height."""
    whole = F.col("width") * F.col("height")
    area = F.least((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), whole)
    return images.groupBy(*page).agg(F.least(F.lit(1.0), F.sum(F.try_divide(area, whole))).alias("image_coverage"))
