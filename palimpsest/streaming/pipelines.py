"""Streams of events and records: sources, windows with late data, deduplication across arrivals, storing, the scheduler's cycle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.enrichment import noise


def read_events(spark: SparkSession, folder: str, schema, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, `files` a batch at most; ts is a point in time, as watermarks ask for."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def bursts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", least: int = 3) -> DataFrame:
    """(user_id, start, n) of sessions with gaps under `gap`; events over `late` behind are dropped, a session is given once it can't grow."""
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.where(F.col("n") >= least).select("user_id", F.col("w.start").alias("start"), "n")


def counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n) of tumbling windows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def said(texts: DataFrame) -> DataFrame:
    """Texts (ts, content, ...) that say something, with content_hash."""
    return texts.where(~noise(F.col("content"))).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))


def first_arrivals(texts: DataFrame, late: str = "1 hour") -> DataFrame:
    """Texts (ts, content, ...) that say something, the first of each content within the watermark, with content_hash."""
    return said(texts).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def unexpired(values: DataFrame, ttl: str) -> DataFrame:
    """The last value of each key of a stream (key, ts, value) in windows of `ttl`; older state is let go with the watermark."""
    rows = values.withWatermark("ts", ttl).groupBy("key", F.window("ts", ttl).alias("w")).agg(F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts"))
    return rows.select("key", "value", "ts")


def store(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "10 minutes"):
    """Run write(batch, number) on each batch: all that is there (once), or every tick.

    The checkpoint must be in a folder that all executors share; it gives each batch one number however often it runs,
    so a write that is keyed by the number is done once. One stream writes a sink at a time.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def cycle(records: DataFrame, scratch: DataFrame, log: DataFrame, now, phase: str, vectors: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables that a consolidation cycle changes: decay, strengthening and expiry always, the log unless light, clusters if deep."""
    from palimpsest.operators import analysis, clusters
    from palimpsest.operators import store as writes

    out = {"strength": analysis.decay(records, now), "confidence": analysis.strengthen(records), "scratch": writes.unexpired(scratch, now)}
    if phase != "light":
        out["log"] = writes.younger(log, now, 7, "ts")
    if phase == "deep" and vectors is not None:
        out["clusters"] = clusters.clusters(vectors)
    return out
