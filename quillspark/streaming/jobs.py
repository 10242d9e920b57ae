"""Structured Streaming: events into an index, bad events aside, status per key."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.versions import status_latest
from ..session import shared_folder


def stream_of(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of the table."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there in batches and stop. After a failure the batch that was under way comes again, so ``each`` must be idempotent."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def index_events(spark: SparkSession, stream: DataFrame, *, valid: Column, key: str, at: str, status: Column, sequence: str) -> tuple[DataFrame, DataFrame]:
    """(status per key, bad events) after all available events: valid ones are written by batch, others go to their own table."""
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")

    def each(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_ok", F.coalesce(valid, F.lit(False))).persist()  # of one batch, for both writers
        # one folder per batch, overwritten when the batch comes again
        marked.where("_ok").select(key, at, sequence, status.alias("status")).write.mode("overwrite").parquet(f"{base}/good/batch={number}")
        marked.where("not _ok").drop("_ok").write.mode("overwrite").parquet(f"{base}/bad/batch={number}")
        marked.unpersist()

    run_available(stream, each, f"{base}/checkpoint")
    good = spark.read.parquet(f"{base}/good")
    bad = spark.read.parquet(f"{base}/bad").drop("batch")
    return status_latest(good, key, at, "status", sequence), bad


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, by: str) -> DataFrame:
    """Counts per window and value over a stream, with a watermark for late rows."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def collected(spark: SparkSession, stream: DataFrame, value: str = "n") -> DataFrame:
    """The result of an aggregate over all available rows, as a table of files.

    Each batch holds the groups it changed, so state that the watermark has
    passed can be dropped; the last row of each group counts.  All columns but
    ``value`` name the group.
    """
    base = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return rows.groupBy(*[c for c in stream.columns if c != value]).agg(F.max_by(value, "batch").alias(value))
