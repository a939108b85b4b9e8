"""The operators over the driver's tables, under the names and columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontam, fingerprints, langid, minhash, pii, secrets, suffix_dedup, toxicity, warc
from paperloom.llm.common import Scratch, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), exclude=(5, 0))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


@query
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(table(spark, sf_dir, "documents"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs, exclude=(4, 2)))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), Scratch(spark, "warc"), min_bytes=0)
    rows = warc.read(archives)
    own = F.col("payload").isNotNull()
    length = F.when(own, F.octet_length("payload")).otherwise(F.col("payload_length"))
    return rows.select(
        F.expr("try_cast(page_id AS long)").alias("page_id"),
        length.cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.expr("try_cast(refers_to AS long)").alias("refers_to"),
    )


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: Base 32 of the hexadecimal SHA-1: five hexadecimal digits are four letters.
ORACLE["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT *, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((CAST('0x' || substr(hex, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS INT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CAST(CASE WHEN page_id <> first THEN first END AS BIGINT) AS refers_to
FROM h"""

#: Equal sets are one class, so that copies aren't paired; classes that share a shingle are compared in full.
ORACLE["op10_minhash"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) < 2 THEN words
    ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS shingles FROM w),
c AS (SELECT *, CASE WHEN len(shingles) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY shingles) END AS class FROM s),
m AS (SELECT DISTINCT class, len(shingles) AS size, unnest(shingles) AS shingle FROM c),
links AS (SELECT a.class AS one, b.class AS other FROM m a JOIN m b USING (shingle)
    WHERE a.class <> b.class AND 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
    GROUP BY a.class, b.class, a.size, b.size HAVING 100 * count(*) >= 80 * (a.size + b.size - count(*))),
reach(class, seen) AS (SELECT DISTINCT class, class FROM c UNION SELECT reach.class, links.other FROM reach JOIN links ON links.one = reach.seen),
comp AS (SELECT class, min(seen) AS component FROM reach GROUP BY class)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component AS component_id, doc_id = component AS kept FROM c JOIN comp USING (class)"""
