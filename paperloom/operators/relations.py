"""Joins and summaries of rows by keys, boxes and baselines: the first box that holds a point, markers glued to their lines,
children counted for every parent, new ids through all columns that refer to the old, the last rows of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How near a marker stands to its line, names of readers of scanned text, and types of text.
MARKER_REACH, MARKER_DRIFT = 40, 4
SCANNED = r"(?i)ocr|tesseract|paddle|htr|trocr|handwrit"
SCANNED_TYPES = ("heading", "paragraph", "list", "header", "footer")


def first_boxes(rows: DataFrame, boxes: DataFrame, key: list[str], id_col: str, box_id: str) -> DataFrame:
    """(key, id, box id): of the boxes that hold a row's centre, borders included, the one with the least id.

    ``rows`` and ``boxes``: key, id, x0, y0, x1, y1. Rows in no box are missing; ``outside`` gives those.
    """
    points = rows.select(*key, id_col, ((F.col("x0") + F.col("x1")) / 2).alias("_x"), ((F.col("y0") + F.col("y1")) / 2).alias("_y"))
    pairs = points.join(boxes.select(*key, box_id, "x0", "y0", "x1", "y1"), key).filter("_x BETWEEN x0 AND x1 AND _y BETWEEN y0 AND y1")
    return pairs.groupBy(*key, id_col).agg(F.min(box_id).alias(box_id))


def outside(rows: DataFrame, boxes: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """The rows, all columns as they are, whose centre no box holds."""
    held = first_boxes(rows, boxes.withColumn("_box", F.lit(0)), key, id_col, "_box")
    return rows.join(held, [*key, id_col], "left_anti").select(*rows.columns)


def glued_markers(lines: DataFrame, key: list[str], id_col: str, marker: str) -> DataFrame:
    """Lines whose whole text matches ``marker`` go in front of the line beside them: the leftmost that begins less than
    40 points behind the marker's end and whose middle is less than 4 points off. A line takes one marker, the nearest;
    a marker without a line stays."""
    middle = (F.col("y0") + F.col("y1")) / 2
    marks = lines.filter(F.col("text").rlike(marker)).select(*key, F.col(id_col).alias("_m"), F.col("text").alias("_mark"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y0").alias("_y0"), F.col("y1").alias("_y1"), middle.alias("_mid"))
    beside = lines.filter(~F.col("text").rlike(marker)).select(*key, id_col, "x0", middle.alias("_line"))
    near = marks.join(beside, key).filter((F.col("x0") >= F.col("_x1")) & (F.col("x0") - F.col("_x1") < MARKER_REACH) & (F.abs(F.col("_line") - F.col("_mid")) < MARKER_DRIFT))
    target = near.groupBy(*key, "_m").agg(F.min_by(F.struct(id_col, "x0"), F.struct("x0", id_col)).alias("_t"), *[F.first(c).alias(c) for c in ("_mark", "_x0", "_x1", "_y0", "_y1")])
    taken = target.groupBy(*key, F.col(f"_t.{id_col}").alias(id_col)).agg(F.min_by(F.struct("_m", "_mark", "_x0", "_y0", "_y1"), F.struct(-F.col("_x1"), "_m")).alias("_g"))
    gone = taken.select(*key, F.col("_g._m").alias(id_col))
    out = lines.join(gone, [*key, id_col], "left_anti").join(taken, [*key, id_col], "left")
    g = F.col("_g")
    changed = {"text": F.coalesce(F.concat(g["_mark"], F.lit(" "), F.col("text")), F.col("text")), "x0": F.least("x0", g["_x0"]), "y0": F.least("y0", g["_y0"]), "y1": F.greatest("y1", g["_y1"])}
    return out.withColumns(changed).select(*lines.columns)


def renumbered(blocks: DataFrame, key: str, order: str, id_col: str = "id", refers: tuple[str, ...] = ("parent_id",)) -> DataFrame:
    """Ids by order within a key, B0001 on, and the columns that refer to old ids changed with them (null if there is none)."""
    ids = blocks.select(key, F.col(id_col).alias("_old"), F.format_string("B%04d", F.row_number().over(Window.partitionBy(key).orderBy(order, id_col))).alias("_new"))
    out = blocks.join(ids.withColumnRenamed("_old", id_col), [key, id_col]).withColumn(id_col, F.col("_new")).drop("_new")
    for c in refers:
        out = out.join(ids.withColumnsRenamed({"_old": c, "_new": "_to"}), [key, c], "left").withColumn(c, F.col("_to")).drop("_to")
    return out.select(*blocks.columns)


def child_counts(parents: DataFrame, children: DataFrame, key: list[str], kind: str, kinds: dict[str, str], total: str = "n") -> DataFrame:
    """Every parent with the number of its children, in all and of each kind (column name: kind); zeros without any."""
    counts = children.groupBy(*key).agg(F.count("*").alias(total), *[F.count_if(F.col(kind) == v).alias(c) for c, v in kinds.items()])
    return parents.join(counts, key, "left").fillna(0, [total, *kinds])


def by_precedence(key: str, value: str, *sources: DataFrame) -> DataFrame:
    """(key, value) of the last source that knows a key; of several in one the greatest."""
    ranked = [s.select(key, value, F.lit(k).alias("_rank")) for k, s in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked).groupBy(key).agg(F.max_by(value, F.struct("_rank", value)).alias(value))


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both have, each once."""
    return a.intersect(b)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't among those gone."""
    return rows.join(gone.select(*key), key, "left_anti")


def last_rows(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row, as column ``name``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def final_status(errors: Column, blocks: Column) -> Column:
    """What a document comes to: nothing went wrong; something did and nothing was read; or something was."""
    return F.when(errors == 0, "SUCCESS").when(blocks == 0, "FAILED").otherwise("PARTIAL_SUCCESS")


def middles_and_shares(rows: DataFrame, key: str, value: str, holds: Column) -> DataFrame:
    """(key, middle, share): the median of a value, and in what share of the rows a condition holds."""
    return rows.groupBy(key).agg(F.median(value).alias("middle"), F.round(F.avg(holds.cast("int")), 6).alias("share"))


def dashboard(documents: DataFrame, pages: str, score: str, kind: str) -> DataFrame:
    """Number of documents, their pages in all, the mean score of those that have one, and the number of kinds."""
    return documents.agg(F.count("*").alias("n_docs"), F.sum(pages).alias("n_pages"), F.round(F.avg(score), 4).alias("mean"), F.countDistinct(kind).alias("n_kinds"))


def from_scan(blocks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Blocks that come from a picture of text: by their reader's name, as handwriting, or as text of a scanned page.

    ``blocks``: key, page, type, extractor, kind; ``pages``: key, page, source.
    """
    rows = blocks.join(pages.select(key, "page", F.col("source").alias("_source")), [key, "page"], "left")
    scanned = F.coalesce(F.col("extractor").rlike(SCANNED), F.lit(False)) | F.coalesce(F.col("kind") == "handwritten", F.lit(False))
    return rows.filter(scanned | (F.coalesce(F.col("_source") == "ocr", F.lit(False)) & F.col("type").isin(*SCANNED_TYPES))).select(*blocks.columns)


def source_label(kind: Column, page: Column, slide: Column, sheet: Column, cell: Column) -> Column:
    """Where a block comes from, in the words of its document's kind."""
    number = page.cast("string")
    return (
        F.when(kind == "pptx", F.concat(F.lit("slide "), F.coalesce(slide.cast("string"), number)))
        .when(kind == "xlsx", F.concat(F.coalesce(sheet, F.lit("sheet")), F.coalesce(F.concat(F.lit("!"), cell), F.lit(""))))
        .when(kind == "docx", F.concat(F.lit("unit "), number))
        .otherwise(F.concat(F.lit("p."), number))
    )


def hex_colour(red: Column, green: Column, blue: Column) -> Column:
    """#rrggbb of shares from 0 to 1."""
    return F.when(red.isNotNull(), F.format_string("#%02x%02x%02x", *[F.bround(c * 255).cast("int") for c in (red, green, blue)]))


def snapped(positions: DataFrame, lines: DataFrame, key: str, id_col: str, pos: str, reach: float = 3.0) -> DataFrame:
    """Every row's position, moved to the nearest line within reach; of equally near ones the lower."""
    near = positions.join(lines.select(key, F.col(pos).alias("_line")), key).filter(F.abs(F.col("_line") - F.col(pos)) <= reach)
    best = near.groupBy(key, id_col).agg(F.min_by("_line", F.struct(F.abs(F.col("_line") - F.col(pos)), "_line")).alias("_line"))
    return positions.join(best, [key, id_col], "left").withColumn(pos, F.coalesce("_line", pos)).drop("_line")


def json_value(json: Column, path: str) -> Column:
    """The value at a path of names and places, as in ``blocks.0.text``."""
    return F.get_json_object(json, "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in path.split(".")))
