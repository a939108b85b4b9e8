"""Ingest as a stream: files that arrive become blocks, and a log of job events gives each job's latest status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.blocks import latest
from paperloom.sources import office, pdf

STATES = ("UPLOADED", "QUEUED", "PROCESSING", "SUCCESS", "PARTIAL_SUCCESS", "FAILED")


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they land in a folder, each read once."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*").load(folder)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Parse what has arrived; a batch that is run again writes the same folder of its own again."""

    def write(batch: DataFrame, number: int) -> None:
        office.blocks(batch).write.mode("overwrite").parquet(f"{out}/blocks/batch={number}")
        # Decoding is the dear part, so blocks are made from the rows as written.
        pdf.rows(batch).write.mode("overwrite").parquet(f"{out}/pdf_rows/batch={number}")
        pdf.blocks(batch.sparkSession.read.parquet(f"{out}/pdf_rows/batch={number}")).write.mode("overwrite").parquet(f"{out}/pdf_blocks/batch={number}")
        done = office.admitted(batch).select(F.col("path").alias("document_id"), F.when(F.col("error_code").isNull(), "SUCCESS").otherwise("FAILED").alias("status"), F.lit(number).alias("seq"))
        done.write.mode("overwrite").parquet(f"{out}/job_events/batch={number}")

    return arriving(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(events: DataFrame) -> DataFrame:
    """The latest status of each job of a log (document_id, status, seq)."""
    return latest(events, "document_id", ["seq"])


def rates(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type in tumbling windows; rows later than the watermark are dropped when this runs as a stream."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")


def exclusive_times(spans: DataFrame, key: str) -> DataFrame:
    """Spans (key, id, parent_id, stage, seconds) summed by stage without the time of the spans inside them."""
    inner = spans.filter("parent_id IS NOT NULL").groupBy(key, F.col("parent_id").alias("id")).agg(F.sum("seconds").alias("_inner"))
    own = spans.join(inner, [key, "id"], "left").withColumn("own", F.greatest(F.lit(0.0), F.col("seconds") - F.coalesce("_inner", F.lit(0.0))))
    return own.groupBy(key, "stage").agg(F.round(F.sum("own"), 6).alias("seconds"), F.count("*").alias("spans"))
