"""Queries over documents, pages and conversations as blocks of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import blocks as B
from paperloom.operators import markup as M
from paperloom.plans.catalog import query, table

# Lines of every document, numbered as they stand; SQL for the oracles.
LINES = r"""lines AS (SELECT doc_id, lang, order_no, text FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS order_no FROM documents) WHERE trim(text, ' ') <> '')"""
TYPED = LINES + r""", typed AS (SELECT *, CASE WHEN regexp_matches(trim(text, ' '), '^(?:[-*•]|\d+[.)])\s') THEN 'list' WHEN regexp_matches(trim(text, ' '), '^(?i:table|figure)\s+\d+\s*:') THEN 'caption' WHEN length(trim(text, ' ')) <= 110 AND NOT regexp_matches(trim(text, ' '), '[.!?;:,]$') THEN 'heading' ELSE 'paragraph' END AS type FROM lines)"""


def _lines(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return B.classified(B.lines(docs, "doc_id"))


@query(f"WITH {TYPED} SELECT type, count(*) AS n_blocks, count(DISTINCT doc_id) AS n_docs, sum(length(text)) AS n_chars FROM typed GROUP BY type")
def block_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n_blocks"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, order_no, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM lines),
    m AS (SELECT doc_id, order_no, t, (length(lower(t)) - length(replace(lower(t), 'of the', ''))) // 6 AS n, instr(lower(t), 'of the') AS p FROM s WHERE contains(lower(t), 'of the')),
    r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY order_no) AS k FROM m)
    SELECT doc_id, order_no, substr(t, p, 6) AS matched,
      (CASE WHEN p - 50 > 1 THEN '...' ELSE '' END) || substr(t, greatest(1, p - 50), least(length(t) + 1, p + 56) - greatest(1, p - 50)) || (CASE WHEN p + 56 <= length(t) THEN '...' ELSE '' END) AS snippet,
      n AS match_count, total, total > 3 AS truncated FROM r WHERE k <= 3"""
)
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = B.lines(table(spark, sf_dir, "documents"), "doc_id").withColumn("unit_no", F.lit(0))
    return B.search(units, "doc_id", "'of  the'", limit=3)


@query(
    f"""WITH {LINES}, k AS (SELECT lang, doc_id, regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g') AS margin FROM lines),
    p AS (SELECT lang, count(DISTINCT doc_id) AS pages FROM lines GROUP BY lang), c AS (SELECT lang, margin, count(DISTINCT doc_id) AS on_pages FROM k GROUP BY ALL)
    SELECT lang, margin, on_pages FROM c JOIN p USING (lang) WHERE pages >= 2 AND on_pages >= greatest(2, ceil(pages * 0.02))"""
)
def running_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = B.lines(docs, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    return B.margins(rows, "lang", "doc_id", share=0.02)


@query()
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document; the break looks behind and ahead, which the oracle's patterns can't."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


STOP_SQL = ", ".join(f"'{w}'" for w in T.STOP)


@query(
    f"""SELECT term, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']{{2,}}'))) AS term FROM documents)
    WHERE term NOT IN ({STOP_SQL}) GROUP BY term HAVING count(*) >= 5"""
)
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return each.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs")).filter("n >= 5")


@query(
    f"""SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']{{2,}}'))) AS term FROM documents)
    WHERE term NOT IN ({STOP_SQL}) GROUP BY doc_id, term"""
)
def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every document, however rare."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return each.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query()
def key_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.lines(table(spark, sf_dir, "documents"), "doc_id")
    return B.ranked_sentences(rows, "doc_id", "order_no", top=3).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {TYPED} SELECT doc_id, order_no, max(CASE WHEN type = 'heading' THEN order_no END) OVER (PARTITION BY doc_id ORDER BY order_no) AS section_id FROM typed"""
)
def section_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sections(_lines(spark, sf_dir), "doc_id", "order_no", F.col("type") == "heading", "order_no").select("doc_id", "order_no", "section_id")


@query(
    f"""WITH {TYPED}, h AS (SELECT doc_id, order_no, 1 + length(text) % 4 AS level FROM typed WHERE type = 'heading')
    SELECT doc_id, order_no, level, (SELECT max(p.order_no) FROM h p WHERE p.doc_id = h.doc_id AND p.order_no < h.order_no AND p.level < h.level) AS parent_id FROM h"""
)
def heading_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = _lines(spark, sf_dir).filter("type = 'heading'").select("doc_id", "order_no", (1 + F.length("text") % 4).alias("level"))
    return B.parents(heads, "doc_id", "order_no", "level", "order_no")


@query(
    f"""WITH {TYPED}, m AS (SELECT *, CASE WHEN type = lag(type) OVER w THEN 0 ELSE 1 END AS new FROM typed WINDOW w AS (PARTITION BY doc_id ORDER BY order_no)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY order_no) AS island FROM m)
    SELECT doc_id, CAST(island AS BIGINT) AS island, min(type) AS type, count(*) AS n_lines, string_agg(text, ' ' ORDER BY order_no) AS text FROM i GROUP BY doc_id, island"""
)
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring blocks of one type become one, as lists and paragraphs do when they go on."""
    w = Window.partitionBy("doc_id").orderBy("order_no")
    rows = _lines(spark, sf_dir).withColumn("back", F.lag("type").over(w))
    found = B.islands(rows, "doc_id", ["order_no"], F.col("type") == F.col("back"))
    return found.groupBy("doc_id", "island").agg(
        F.min("type").alias("type"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order_no", "text"))), lambda x: x["text"]), " ").alias("text")
    )


@query("SELECT page_id, regexp_extract(html, '(?i)<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?i)<html lang=\"([a-z]+)\"', 1) AS lang, length(html) AS n_chars FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "(?i)<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '(?i)<html lang="([a-z]+)"', 1).alias("lang"), F.length(h).alias("n_chars"))


@query()
def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")


@query()
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.html_blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return M.markdown(rows, "page_id")


@query(
    f"""WITH {TYPED} SELECT doc_id, string_agg(CASE type WHEN 'heading' THEN '## ' || trim(text, ' ') WHEN 'list' THEN '- ' || trim(text, ' ') WHEN 'caption' THEN '*' || trim(text, ' ') || '*' ELSE trim(text, ' ') END, chr(10) || chr(10) ORDER BY order_no) AS markdown FROM typed GROUP BY doc_id"""
)
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.markdown(_lines(spark, sf_dir).withColumn("level", F.lit(2)), "doc_id")


@query("SELECT conv_id, count(*) AS turns, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS user_turns, max(length(text)) AS longest, min(CASE WHEN turn = 0 THEN role END) AS first_role FROM conversations GROUP BY conv_id")
def conversation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    return t.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).alias("user_turns"), F.max(F.length("text")).alias("longest"), F.min(F.when(F.col("turn") == 0, F.col("role"))).alias("first_role"))


@query("SELECT d.doc_id, d.source, l.quality, l.toxic, (l.quality = 0 OR l.toxic = 1) AS needs_review FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", "quality", "toxic", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("needs_review"))


@query("SELECT doc_id, right(regexp_replace(source || ' / ' || lang || '#' || doc_id || '.txt', '[^A-Za-z0-9._-]', '_', 'g'), 120) AS safe_name FROM documents")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("source", F.lit(" / "), "lang", F.lit("#"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", T.safe_name(name).alias("safe_name"))
