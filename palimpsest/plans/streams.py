"""Streams over the event table as it is: each query runs all batches that are there and gives the sink's table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.plans.base import query
from palimpsest.sources.staging import own_dir
from palimpsest.sources.tables import table
from palimpsest.streaming import pipelines, state


def ran(stream, mode: str = "append"):
    """The table that a stream writes to the shared folder until nothing is left to read."""
    spark = stream.sparkSession
    folder = f"{own_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # the same batch twice is one

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(*[f"{folder}/out"]).select(*stream.columns)


#: Files of a batch of events at least, and events of a file about, so that the tasks of a batch grow with the table.
FILES, FILE_EVENTS = 4, 100_000


def events(spark, sf_dir):
    """The events in three batches by time, FILES files each or as many as hold FILE_EVENTS."""
    folder = f"{own_dir(spark)}/events-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events")
    files = max(FILES, -(-e.count() // (3 * FILE_EVENTS)))
    for k in range(3):
        e.where(f"dayofmonth(ts) > {10 * k} AND dayofmonth(ts) <= {10 * (k + 1) + (k == 2)}").repartition(files).write.parquet(f"{folder}/{k}")
    return pipelines.read_events(spark, f"{folder}/*", e.schema, files)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-29' GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    """Daily counts; only windows that the watermark has passed are given, so the last two days are left out."""
    return ran(pipelines.counts(events(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz")).where("start < TIMESTAMP_NTZ '2024-01-29 00:00:00'")


@query("""WITH i AS (SELECT user_id, event_id, ts, event_type = 'error' AS e, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT user_id, event_id, (sum(e::INTEGER) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS empty_run FROM i""")
def stream_empty_runs(spark, sf_dir):
    """The batch query empty_search_runs as a stream with state."""
    return ran(state.empty_runs_stream(events(spark, sf_dir).withColumn("empty", F.col("event_type") == "error")))


@query("""WITH h AS (SELECT event_id, ts, sha256('the value of this event is ' || user_id || event_type || ' and it says something') AS content_hash FROM events)
SELECT content_hash, min(ts) AS ts FROM h GROUP BY 1""")
def stream_first_arrivals(spark, sf_dir):
    """Texts of events, the time of the first arrival of each, which the stream's state gives."""
    text = F.expr("'the value of this event is ' || user_id || event_type || ' and it says something'")
    rows = ran(state.first_arrivals(pipelines.said(events(spark, sf_dir).withColumn("content", text))))
    return rows.select("content_hash", F.col("ts").cast("timestamp_ntz").alias("ts"))


_UNIT = "list_transform({0}, lambda c: c / sqrt(list_sum(list_transform({0}, lambda d: d * d))))"
_MIXED = "list_transform(list_zip(m, v), lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2])"


@query(f"""WITH e AS (SELECT user_id, ts, event_id, event_id % (SELECT count(*) FROM embeddings) AS id FROM events WHERE event_type <> 'error'),
l AS (SELECT user_id, count(*) AS n, list(embedding::DOUBLE[] ORDER BY ts, event_id) AS vs FROM e JOIN embeddings ON vec_id = id GROUP BY 1)
SELECT user_id, n, array_to_string(list_transform(list_reduce(list_prepend({_UNIT.format("vs[1]")}, vs[2:]), lambda m, v: {_UNIT.format(_MIXED)}), lambda x: round(x, 4)::DECIMAL(9, 4) + 0), ',') AS mean FROM l""")
def vector_averages(spark, sf_dir):
    """Moving averages of the vectors that a user's events touch, in order of time, as a stream with state; the last of each user."""
    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_vectors"))
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding AS vector")
    e = events(spark, sf_dir).where("event_type <> 'error'").crossJoin(F.broadcast(n)).withColumn("id", F.expr("event_id % n_vectors"))  # one row
    made = ran(state.averages_stream(e.join(v, "id").withColumn("weight", F.lit(1.0))), "update")
    last = made.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("mean", "n").alias("mean"))
    return last.select("user_id", "n", F.array_join(F.transform("mean", lambda x: (F.round(x, 4).cast("decimal(9,4)") + F.lit(0).cast("decimal(9,4)")).cast("decimal(9,4)").cast("string")), ",").alias("mean"))
