"""Continuous ingest: new subtitle cues become chunks of a collection, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuecraft.functions.text import content_id
from cuecraft.operators.chunking import chunk_cues
from cuecraft.schema import MAX_CHUNK, MIN_CHUNK

_CUES = ("lecture_id", "seq", "start_us", "end_us", "content")


def start(cues: DataFrame, path: str, checkpoint: str, min_size: int = MIN_CHUNK, max_size: int = MAX_CHUNK, overlap: bool = True, **trigger):
    """Chunks of the lectures of each batch under ``path``, each batch in a folder of its own; ``current`` reads them.

    A lecture may come in several batches: cues are kept beside the chunks (``path_cues``), and the lectures that a batch
    touches are cut anew as wholes, so that the newest batch of a lecture has all of its chunks. A batch that is run
    again overwrites its own folders, and ids are hashes of the content, so nothing comes twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.select(*_CUES).write.mode("overwrite").parquet(f"{path}_cues/batch={number}")
        new = spark.read.parquet(f"{path}_cues/batch={number}").select("lecture_id").distinct()
        so_far = spark.read.option("basePath", f"{path}_cues").parquet(f"{path}_cues").where(F.col("batch") <= number)
        chunks = chunk_cues(so_far.select(*_CUES).join(new, "lecture_id", "left_semi"), min_size, max_size, overlap)
        named = chunks.select(content_id(F.col("lecture_id"), F.col("chunk_no"), F.col("piece_no"), F.col("text")).alias("id"), "*")
        named.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cues.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of every lecture as of its newest batch."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("lecture_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["lecture_id", "batch"]).drop("batch")


def event_counts(events: DataFrame, ts: str, kind: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Rows by event-time window and kind; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
