"""Incremental ingestion: new files only, each chunk once, results appended by batch and merged by key.

An extension of resuming by seen ids: the stream's checkpoint knows the files, the keyed state knows the chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from skein.operators import runs

RECORD = "chunk_id string, doc_id string, text string, arrived timestamp"


def arriving(spark: SparkSession, path: str, schema: str = RECORD, late: str = "1 day") -> DataFrame:
    """Chunks of JSON files as they arrive, each once within the watermark, so that the state is bounded."""
    found = spark.readStream.schema(schema).json(path)
    return found.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["chunk_id"])


def extract_stream(chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Runs an extractor over each batch and appends its records with the batch as their run.

    A batch that is run again overwrites its own folder, so every record is there once.
    """

    def store(batch: DataFrame, number: int) -> None:
        extract(batch).withColumn("run", F.lit(number)).write.mode("overwrite").parquet(f"{out}/run={number}")

    return chunks.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """One record for each chunk over all runs: the last good one, or the last."""
    return runs.merged(spark.read.parquet(out), "chunk_id", "run", F.col("status") == "ok")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each type in windows of time, for a stream or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
