"""Queries over tables of cells, boxes on pages and whole documents, on rows that the driver's tables lend themselves to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.operators import blocks as B
from paperloom.operators import layout as L
from paperloom.operators import summaries as S
from paperloom.operators import tables as X
from paperloom.plans.catalog import query, table
from paperloom.plans.texts import LINES, TYPED

# A table for each supplier: line numbers by return flag with printed row and column totals, every fifth grand total off by one.
TOTALS_SQL = """WITH q AS (SELECT l_suppkey, l_linenumber, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r FROM lineitem GROUP BY ALL),
t AS (SELECT l_suppkey, count(*) AS modes, CAST(round(100 * sum(a + n + r)) AS BIGINT) AS total FROM q GROUP BY l_suppkey)
SELECT l_suppkey AS suppkey, CASE WHEN modes >= 2 THEN modes + 4 ELSE modes END AS checks_run, CASE WHEN modes >= 2 THEN modes + 4 ELSE modes END - CASE WHEN modes >= 2 AND l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS checks_passed FROM t"""


def _supplier_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    flags = ("A", "N", "R")
    sums = [F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0)).cast("decimal(18,2)").alias(f) for f in flags]
    rows = items.groupBy("l_suppkey", F.concat(F.lit("Line "), "l_linenumber").alias("by")).agg(*sums).withColumn("all", sum((F.col(f) for f in flags[1:]), F.col("A")))
    ends = rows.groupBy("l_suppkey").agg(*[F.sum(c).cast("decimal(18,2)").alias(c) for c in (*flags, "all")])
    ends = ends.withColumn("all", F.when(F.col("l_suppkey") % 5 == 0, F.col("all") + 100).otherwise(F.col("all")).cast("decimal(18,2)")).withColumn("by", F.lit("Total"))
    head = ends.select("l_suppkey", F.lit(0).alias("part"), F.lit("").alias("by"), F.array(*[F.lit(c) for c in ("Mode", *flags, "Total")]).alias("texts"))

    def body(rows: DataFrame, part: int) -> DataFrame:
        return rows.select("l_suppkey", F.lit(part).alias("part"), "by", F.array("by", *[F.col(c).cast("string") for c in (*flags, "all")]).alias("texts"))

    lines = head.unionByName(body(rows, 1)).unionByName(body(ends, 2))
    numbered = lines.withColumn("row", F.row_number().over(Window.partitionBy("l_suppkey").orderBy("part", "by")) - 1)
    return numbered.select(F.col("l_suppkey").alias("suppkey"), "row", F.posexplode("texts").alias("col", "text"))


@query(TOTALS_SQL)
def table_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = X.header_rows(_supplier_cells(spark, sf_dir), "suppkey")
    return X.consistency(X.check_totals(cells, "suppkey"), "suppkey").select("suppkey", "checks_run", "checks_passed")


@query("""SELECT l_suppkey AS suppkey, unnest([0, 1, 2, 3, 4]) AS col, unnest(['Mode', 'A', 'N', 'R', 'Total']) AS label FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def column_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.column_labels(X.header_rows(_supplier_cells(spark, sf_dir), "suppkey"), "suppkey")


@query("SELECT l_suppkey AS suppkey, count(DISTINCT l_linenumber) + 2 AS n_rows, 5 AS n_cols, 1.0 AS table_fill, 1.0 AS structure, false AS degenerate FROM lineitem GROUP BY l_suppkey")
def table_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.quality(X.header_rows(_supplier_cells(spark, sf_dir), "suppkey"), "suppkey")


BOXES = """boxes AS (SELECT l_orderkey AS orderkey, l_linenumber AS id, CAST(50 + 300 * (l_linenumber % 2) AS DOUBLE) AS x0, CAST(250 + 300 * (l_linenumber % 2) AS DOUBLE) AS x1, CAST(l_partkey % 700 AS DOUBLE) AS y0, CAST(l_partkey % 700 + 12 AS DOUBLE) AS y1 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL))"""


@query(
    f"""WITH {BOXES}, d AS (SELECT DISTINCT a.orderkey FROM boxes a JOIN boxes b USING (orderkey) WHERE a.id < b.id AND a.x0 = b.x0 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 2 AND (SELECT count(DISTINCT x0) FROM boxes c WHERE c.orderkey = a.orderkey) > 1)
    SELECT orderkey, id, row_number() OVER (PARTITION BY orderkey ORDER BY x0, y0, id) AS place, orderkey IN (SELECT orderkey FROM d) AS ambiguous FROM boxes"""
)
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes in two columns; a single column spans itself."""
    side = 300 * (F.col("l_linenumber") % 2)
    y = F.col("l_partkey") % 700
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    boxes = items.select(
        F.col("l_orderkey").alias("orderkey"), F.lit(1).alias("page"), F.col("l_linenumber").alias("id"), F.lit("paragraph").alias("type"),
        *[c.cast("double").alias(n) for n, c in (("x0", side + 50), ("y0", y), ("x1", side + 250), ("y1", y + 12))],
    )
    return L.reading_order(boxes, "orderkey").select("orderkey", "id", "place", "ambiguous")


@query(
    f"""WITH {LINES}, p AS (SELECT doc_id, order_no, text, lag(text) OVER w AS back FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY order_no)),
    m AS (SELECT *, CASE WHEN coalesce((right(back, 1) = '-' OR (NOT regexp_matches(back, '[.!?:;"”’)\\]]$') AND regexp_matches(text, '^\\p{{Ll}}'))), false) THEN 0 ELSE 1 END AS new FROM p),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY order_no) AS island FROM m)
    SELECT doc_id, min(order_no) AS order_no, count(*) AS n_parts, replace(replace(string_agg(text, chr(1) ORDER BY order_no), '-' || chr(1), ''), chr(1), ' ') AS text FROM i GROUP BY doc_id, island"""
)
def continued_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as a paragraph of its own page: those that go on behind the break become one."""
    rows = B.lines(table(spark, sf_dir, "documents"), "doc_id")
    rows = rows.select("doc_id", "order_no", F.col("order_no").alias("page"), F.lit("paragraph").alias("type"), "text", *[F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")])
    return L.continued_text(rows, "doc_id", "order_no").select("doc_id", "order_no", "n_parts", "text")


@query("SELECT p_partkey, least(6, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC)) AS level FROM part")
def heading_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lit("Heading").alias("text"), F.col("p_size").cast("double").alias("size"))
    return L.heading_levels(heads, "p_brand").select("p_partkey", "level")


@query(
    """SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS text_chars, length(trim(coalesce(text, ''), ' ')) < 25 OR ((doc_id % 10) / 10.0 >= 0.8 AND length(trim(coalesce(text, ''), ' ')) < 150) AS is_scanned
    FROM documents"""
)
def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("image_coverage", (F.col("doc_id") % 10) / F.lit(10.0))
    return L.scan_decision(docs).select("doc_id", "text_chars", "is_scanned")


def _doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.classified(B.lines(table(spark, sf_dir, "documents"), "doc_id"))
    level = F.when(F.col("type") == "heading", 1 + F.length("text") % 4)
    return rows.select("doc_id", "order_no", F.lit(1).alias("page"), "type", "text", level.alias("level"), F.lit(0.9).alias("confidence"), F.lit("HIGH").alias("confidence_level"), F.lit("OK").alias("status"))


@query(
    f"""WITH {TYPED}, h AS (SELECT doc_id, order_no, text, 1 + length(text) % 4 AS level FROM typed WHERE type = 'heading'),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY level) AS k FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY order_no) AS n FROM r WHERE k <= 2)
    SELECT doc_id, order_no, level, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM n WHERE n <= 20"""
)
def main_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sections(_doc_blocks(spark, sf_dir), "doc_id").select("doc_id", "order_no", "level", "text")


@query(
    f"""WITH {TYPED} SELECT doc_id, count(*) AS total_blocks, sum(CASE WHEN type IN ('heading', 'paragraph', 'list', 'caption') THEN 1 ELSE 0 END) AS text_blocks,
    CAST(sum(len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), ' '))) AS BIGINT) AS words FROM typed GROUP BY doc_id"""
)
def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statistics(_doc_blocks(spark, sf_dir), "doc_id").select("doc_id", "total_blocks", F.col("text_blocks").cast("long").alias("text_blocks"), F.col("words").cast("long").alias("words"))


@query()
def document_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole nested summary of every document, as JSON, for the comparison takes scalars."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_count"), F.lit("digital").alias("source_kind"))
    out = S.summaries(docs, _doc_blocks(spark, sf_dir), "doc_id")
    return out.select("doc_id", "status", "executive_summary", F.to_json(F.struct("title", "key_points", "sections", "statistics", "warnings")).alias("summary"))
