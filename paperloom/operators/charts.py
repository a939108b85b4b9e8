"""Values of vector charts from the boxes of their bars, markers, lines and wedges, and the printed numbers around them.

Shapes and labels are rows with a chart key, so all charts are read in the same joins and groups; pictures without shapes keep their
printed text only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import numbers as N


def _middle(a: str, b: str) -> Column:
    return (F.col(a) + F.col(b)) / 2


def fitted(points: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """(key, a, b, r2, n, step): the least-squares line through axis ticks and their smallest distance; two places at least."""
    rows = points.filter(F.col(pos).isNotNull() & F.col(value).isNotNull()).withColumn("_back", F.lag(value).over(Window.partitionBy(key).orderBy(value)))
    out = rows.groupBy(key).agg(
        F.regr_slope(value, pos).alias("a"), F.regr_intercept(value, pos).alias("b"), F.coalesce(F.regr_r2(value, pos), F.lit(1.0)).alias("r2"), F.count("*").alias("n"),
        F.coalesce(F.min(F.when(F.col(value) > F.col("_back"), F.col(value) - F.col("_back"))), F.lit(1.0)).alias("step"), F.count_distinct(F.round(pos, 1)).alias("_places"),
    )
    return out.filter("_places >= 2").drop("_places")


def y_ticks(labels: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """(key, y, value, text): numbers left of the plot in the right-aligned cluster with the most members."""
    value = N.chart_number(F.col("text"))
    near = labels.join(plots.select(key, F.col("x0").alias("_left")), key).withColumn("value", value).filter("value IS NOT NULL AND x1 <= _left + 6")
    near = near.withColumns({"_c": F.round(F.col("x1") / 4), "y": _middle("y0", "y1")})
    sizes = near.groupBy(key, "_c").agg(F.count("*").alias("_n")).filter("_n >= 2")
    best = sizes.groupBy(key).agg(F.max_by("_c", F.struct("_n", -F.col("_c"))).alias("_c"))
    return near.join(best, [key, "_c"]).select(key, "y", "value", "text")


def x_ticks(labels: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """(key, x, text, value, gap): the row below the plot with the most labels, nearest first; gap is its median spacing."""
    below = labels.join(plots.select(key, F.col("y1").alias("_foot")), key).filter("y0 >= _foot - 6").withColumns({"_row": F.round(_middle("y0", "y1") / 3), "x": _middle("x0", "x1")})
    best = below.groupBy(key, "_row").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max_by("_row", F.struct("_n", -F.col("_row"))).alias("_row"))
    row = below.join(best, [key, "_row"]).withColumn("_step", F.col("x") - F.lag("x").over(Window.partitionBy(key).orderBy("x")))
    return row.withColumn("gap", F.median("_step").over(Window.partitionBy(key))).select(key, "x", "text", N.chart_number(F.col("text")).alias("value"), "gap")


def nearest_label(shapes: DataFrame, ticks: DataFrame, key: str, id_col: str = "id") -> DataFrame:
    """(key, id, category): the tick nearest to each shape's ``x``, within 0.6 of the ticks' spacing; ties go to the left."""
    pairs = shapes.select(key, id_col, F.col("x").alias("_x")).join(ticks, key).withColumn("_d", F.abs(F.col("_x") - F.col("x")))
    near = pairs.filter("gap IS NULL OR _d <= 0.6 * gap")
    return near.groupBy(key, id_col).agg(F.min_by("text", F.struct("_d", "x")).alias("category"))


def legend(shapes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, fill, name): the text right of a swatch of at most 14 points, on its line and within 14 points."""
    small = shapes.filter("x1 - x0 <= 14 AND y1 - y0 <= 14").select(key, "fill", F.col("x1").alias("_right"), _middle("y0", "y1").alias("_y"))
    pairs = small.join(labels.select(key, "text", "x0", _middle("y0", "y1").alias("_ly")), key).filter("abs(_ly - _y) < 6 AND x0 - _right >= 0 AND x0 - _right < 14")
    return pairs.groupBy(key, "fill").agg(F.min_by("text", F.struct(F.col("x0") - F.col("_right"), F.col("text"))).alias("name"))


def bars(shapes: DataFrame, labels: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """Bars on the commonest base line: key, id, fill, series, category, value, label_value, agrees, bin_start, bin_end, chart_type.

    The value is the printed number at the bar's head if there is one, else the axis value; ``agrees`` says whether both fit (2 % or 0.15
    of a tick). Touching bars of one colour are a histogram, with edges in axis units where the ticks below are numbers on a line.
    """
    tall = shapes.filter("NOT (x1 - x0 <= 14 AND y1 - y0 <= 14)").withColumn("_base", F.round("y1"))
    base = tall.groupBy(key, "_base").agg(F.count("*").alias("_n")).filter("_n >= 2").groupBy(key).agg(F.max_by("_base", F.struct("_n", "_base")).alias("_foot"))
    row = tall.join(base, key).filter("abs(y1 - _foot) <= 1.5").withColumn("x", _middle("x0", "x1"))
    by = Window.partitionBy(key).orderBy("x0")
    whole = Window.partitionBy(key)
    row = row.withColumn("_gap", F.abs(F.col("x0") - F.lag("x1").over(by)))
    touching = (F.max("_gap").over(whole) <= 0.15 * F.median(F.col("x1") - F.col("x0")).over(whole)) & (F.size(F.collect_set("fill").over(whole)) == 1)
    row = row.withColumn("chart_type", F.when(touching, "histogram").otherwise("bar"))
    axis = fitted(y_ticks(labels, plots, key), key, "y", "value").select(key, F.col("a").alias("_a"), F.col("b").alias("_b"), "step")
    ticks = x_ticks(labels, plots, key)
    printed = labels.withColumns({"_v": N.chart_number(F.col("text")), "_lx": _middle("x0", "x1"), "_ly": _middle("y0", "y1")}).filter("_v IS NOT NULL").select(key, "_v", "_lx", "_ly")
    near = row.select(key, "id", "x", "x0", "x1", "y0", "y1").join(printed, key).filter("abs(_lx - x) <= greatest(6, (x1 - x0) * 0.7) AND _ly >= y0 - 24 AND _ly <= y1 AND _lx > x0 - 5")
    head = near.groupBy(key, "id").agg(F.min_by("_v", F.struct(F.abs(F.col("_ly") - F.col("y0")), F.col("_v"))).alias("label_value"))
    edges = fitted(ticks, key, "x", "value").filter("r2 > 0.999").select(key, F.col("a").alias("_xa"), F.col("b").alias("_xb"))
    out = row.join(axis, key, "left").join(nearest_label(row, ticks, key), [key, "id"], "left").join(head, [key, "id"], "left").join(edges, key, "left").join(legend(shapes, labels, key), [key, "fill"], "left")
    read = F.col("_a") * F.col("y0") + F.col("_b")
    agrees = F.abs(F.col("label_value") - read) <= F.greatest(0.02 * F.abs("label_value"), 0.15 * F.col("step"))
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("_first_x", "fill"))
    out = out.withColumn("_first_x", F.min("x0").over(Window.partitionBy(key, "fill"))).withColumn("_s", number)
    several = F.max("_s").over(whole) > 1
    hist = F.col("chart_type") == "histogram"
    return out.select(
        key, "id", "fill", F.coalesce("name", F.when(several, F.concat(F.lit("Series "), F.col("_s").cast("string")))).alias("series"), "category",
        F.round(F.coalesce("label_value", read), 6).alias("value"), "label_value", agrees.alias("agrees"),
        F.when(hist, F.round(F.col("_xa") * F.col("x0") + F.col("_xb"), 3)).alias("bin_start"), F.when(hist, F.round(F.col("_xa") * F.col("x1") + F.col("_xb"), 3)).alias("bin_end"), "chart_type",
    )


def line_points(segments: DataFrame, labels: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """Corners of slanted segments (color, x0, y0, x1, y1 as ends): key, color, x, category, value; one corner for each whole x."""
    ends = F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))))
    points = segments.select(key, "color", ends.alias("p")).groupBy(key, "color", F.round("p.x").alias("id")).agg(F.min("p").alias("p")).select(key, "color", "id", "p.x", "p.y")
    axis = fitted(y_ticks(labels, plots, key), key, "y", "value").select(key, "a", "b")
    near = nearest_label(points, x_ticks(labels, plots, key), key)
    return points.join(axis, key, "left").join(near, [key, "id"], "left").select(key, "color", F.round("x", 2).alias("x"), "category", F.round(F.col("a") * F.col("y") + F.col("b"), 6).alias("value"))


def scatter_points(markers: DataFrame, labels: DataFrame, plots: DataFrame, key: str) -> DataFrame:
    """Markers (id, box) in axis units: key, id, x, value; null where an axis has no numbers."""
    xs = fitted(x_ticks(labels, plots, key), key, "x", "value").select(key, F.col("a").alias("_xa"), F.col("b").alias("_xb"))
    ys = fitted(y_ticks(labels, plots, key), key, "y", "value").select(key, F.col("a").alias("_ya"), F.col("b").alias("_yb"))
    x, y = F.col("_xa") * _middle("x0", "x1") + F.col("_xb"), F.col("_ya") * _middle("y0", "y1") + F.col("_yb")
    return markers.join(xs, key, "left").join(ys, key, "left").select(key, "id", F.round(x, 3).alias("x"), F.round(y, 6).alias("value"))


def turned(a: Column, b: Column) -> Column:
    """The angle from a to b, between -pi and pi."""
    return F.pmod(b - a + math.pi, F.lit(2 * math.pi)) - math.pi


def pie_shares(arcs: DataFrame, centres: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Shares of wedges from their arcs (id, fill, x0, y0, x1, y1): key, id, category, value in percent, label_value.

    ``centres``: key, cx, cy. A pie's arcs must make up 0.8 to 1.2 of a full turn; names and percentages go by the wedge's direction.
    """
    at = arcs.join(centres, key)
    start, end = F.atan2(F.col("y0") - F.col("cy"), F.col("x0") - F.col("cx")), F.atan2(F.col("y1") - F.col("cy"), F.col("x1") - F.col("cx"))
    mid = F.struct((F.cos(start) + F.cos(start + turned(start, end)) + 2 * F.cos(start + turned(start, end) / 2)).alias("x"), (F.sin(start) + F.sin(start + turned(start, end)) + 2 * F.sin(start + turned(start, end) / 2)).alias("y"))
    wedges = at.withColumns({"sweep": F.abs(turned(start, end)), "_m": mid}).groupBy(key, "id").agg(F.first("fill").alias("fill"), F.sum("sweep").alias("sweep"), F.atan2(F.sum("_m.y"), F.sum("_m.x")).alias("_angle"))
    wedges = wedges.withColumn("_all", F.sum("sweep").over(Window.partitionBy(key))).filter(F.col("_all").between(0.8 * 2 * math.pi, 1.2 * 2 * math.pi))
    words = labels.join(centres, key).select(key, "text", N.chart_number(F.col("text")).alias("_v"), F.atan2(_middle("y0", "y1") - F.col("cy"), _middle("x0", "x1") - F.col("cx")).alias("_dir"))
    near = wedges.join(words, key).withColumn("_d", F.abs(turned(F.col("_angle"), F.col("_dir")))).filter("_d < 0.5")
    named = near.groupBy(key, "id").agg(
        F.min_by(F.when(F.col("_v").isNull(), F.col("text")), F.when(F.col("_v").isNull(), F.struct("_d", "text"))).alias("category"),
        F.min_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull() & F.contains("text", F.lit("%")), F.struct("_d", "text"))).alias("label_value"),
    )
    return wedges.join(named, [key, "id"], "left").select(key, "id", "fill", "category", F.round(100 * F.col("sweep") / F.col("_all"), 1).alias("value"), "label_value")


def chart_kind(wedges: Column, markers: Column, bars_on_base: Column, slants: Column) -> Column:
    """What a chart's shapes make it: pie, scatter, bar, line, or null."""
    return F.when(wedges >= 2, "pie").when(markers >= 5, "scatter").when(bars_on_base >= 2, "bar").when(slants >= 2, "line")


def looks_like_chart(paths: Column, numeric_labels: Column, caption: Column) -> Column:
    return ((paths >= 15) & (numeric_labels >= 3)) | F.coalesce(caption.rlike(r"(?i)\b(chart|graph|plot|histogram|trend)\b"), F.lit(False))


def chart_tables(points: DataFrame, key: str) -> DataFrame:
    """Markdown tables of charts; points: key, chart_type, unit, series_no, series, point_no, category, x, bin_start, bin_end, value.

    Scatter charts list x and y, pies shares, histograms bins; the others have a row for each category and a column for each series.
    """

    def cell(c: Column) -> Column:
        return F.trim(F.replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))

    def bar(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    unit = F.coalesce(F.concat(F.lit("Value ("), F.col("unit"), F.lit(")")), F.lit("Value"))
    kind = F.col("chart_type")
    bins = F.coalesce(F.col("category"), F.when(F.col("bin_start").isNotNull(), F.concat(F.col("bin_start").cast("string"), F.lit("–"), F.col("bin_end").cast("string"))), F.lit("?"))
    first = F.when(kind == "scatter", F.col("x").cast("string")).when(kind == "histogram", bins).otherwise(F.col("category"))
    # A series of a listing chart starts its own rows; the others share rows by place.
    part = F.when(kind == "scatter", F.col("series_no")).otherwise(0)
    several = points.filter("chart_type IN ('scatter') OR chart_type NOT IN ('scatter', 'pie', 'histogram') OR series_no = 0")
    rows = several.withColumns({"_first": first, "_part": part, "_unit": unit}).groupBy(key, "chart_type", "_part", "point_no").agg(
        F.min_by("_first", "series_no").alias("_first"), F.array_sort(F.collect_list(F.struct("series_no", cell(F.col("value")).alias("v")))).alias("_v")
    )
    heads = several.groupBy(key, "chart_type").agg(F.first(unit).alias("_unit"), F.array_sort(F.collect_set(F.struct("series_no", F.coalesce("series", unit).alias("n")))).alias("_names"))
    names = F.when(kind == "scatter", F.array(F.lit("x"), F.lit("y"))).when(kind == "pie", F.array(F.lit("Category"), F.lit("Share (%)"))).when(kind == "histogram", F.array(F.lit("Bin"), F.col("_unit")))
    names = names.otherwise(F.concat(F.array(F.lit("Category")), F.transform("_names", lambda s: s["n"])))
    spread = F.transform("_names", lambda s: F.coalesce(F.try_element_at(F.filter("_v", lambda v: v["series_no"] == s["series_no"]), F.lit(1))["v"], F.lit("")))
    values = F.when(kind.isin("scatter", "pie", "histogram"), F.transform("_v", lambda v: v["v"])).otherwise(spread)
    lines = rows.join(heads, [key, "chart_type"]).withColumn("_line", bar(F.concat(F.array(cell(F.col("_first"))), values)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "point_no", "_line"))), lambda r: r["_line"]), "\n")
    out = lines.groupBy(key, "chart_type").agg(body.alias("_body"), F.first(bar(names)).alias("_head"), F.first(F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(names)))).alias("_rule"))
    return out.select(key, F.concat_ws("\n", "_head", "_rule", "_body").alias("markdown"))
