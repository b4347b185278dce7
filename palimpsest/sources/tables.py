"""Input tables: memories, events as co-retrieval and tool calls, transcripts, all from parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.enrichment import classify, importance

NOW = "TIMESTAMP_NTZ '2024-02-01 00:00:00'"
# Opening phrases that make the enrichment rules fire, by doc_id modulo 12.
MARKERS = ("We decided to ", "How to ", "I prefer ", "It happened: ", "I noticed ", "critical error ", "security fix ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Columns of memories that need the labels, the vectors, or the text's type.
LABELLED, VECTOR, TYPED = ("confidence", "contradiction_count"), ("embedding", "concept"), ("type", "importance")


def memories(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """Text records with project, validity, tier and counters; `extra`: further columns of LABELLED, VECTOR and TYPED.

    Only the tables that the wanted columns need are read and joined. A record with several labels takes the greatest.
    """
    marker = "CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MARKERS)) + " ELSE '' END"
    rows = table(spark, sf_dir, "documents").withColumn("content", F.expr(f"{marker} || coalesce(text, '')"))
    typed = bool(set(extra) & set(TYPED))
    if typed:  # before the joins, which texts then needn't pass where only this is wanted of them
        # Both are made in one lambda over the text: as plain columns their hundred conditions would be written out again in each filter and
        # column that uses them, and code of that size isn't compiled.
        of_kind = lambda low, content: lambda kind: F.struct(kind.alias("type"), importance(low, content, kind).alias("importance"))
        kinds = lambda t: F.element_at(F.transform(F.array(classify(t["low"])), of_kind(t["low"], t["content"])), 1)
        rows = rows.withColumn("kinds", F.element_at(F.transform(F.array(F.struct(F.lower("content").alias("low"), "content")), kinds), 1))
    if set(extra) & set(LABELLED):
        labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        rows = rows.join(labels, "doc_id", "left")
    if set(extra) & set(VECTOR):
        rows = rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").alias("concept")), "doc_id", "left")
    rows = rows.withColumn("created_at", F.expr("timestamp_ntz'2023-11-01 00:00:00' + make_dt_interval(cast(doc_id % 90 as int), 0, 0, cast(doc_id as decimal(18,6)))"))
    given = {
        "confidence": "CASE WHEN doc_id % 7 <> 0 THEN 0.3D + 0.6D * coalesce(cast(quality as double), 0.5D) END",
        "contradiction_count": "coalesce(toxic, 0) * (doc_id % 5)", "embedding": "embedding", "concept": "concept",
    }
    rows = rows.selectExpr(
        "doc_id", "'m' || lpad(cast(doc_id as string), 8, '0') AS id",
        "CASE WHEN source = 'src0' THEN 'global' ELSE source END AS project_id",
        "content",
        "created_at", "created_at + make_dt_interval(cast(doc_id % 5 as int)) AS last_accessed",
        "CASE WHEN doc_id % 11 <> 0 THEN created_at END AS valid_from",
        "CASE WHEN doc_id % 6 = 0 THEN created_at + INTERVAL '20' DAY END AS valid_to",
        f"CASE WHEN doc_id % 17 = 0 THEN {NOW} END AS deleted_at",
        "CASE WHEN doc_id % 13 = 0 THEN 'm' || lpad(cast(doc_id + 1 as string), 8, '0') END AS superseded_by",
        "CASE doc_id % 3 WHEN 1 THEN 'system' WHEN 2 THEN 'agent-a' END AS agent_id",
        "element_at(array('ephemeral', 'relevant', 'established', 'core'), cast(doc_id % 4 as int) + 1) AS tier",
        "doc_id % 12 AS access_count", "doc_id % 9 AS search_hit_count", "1 + doc_id % 3 AS source_count",
        "1.0D AS strength", "CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 5) / 5.0D END AS processing_depth",
        *(f"{given[c]} AS {c}" for c in extra if c in given), *(["kinds"] if typed else []),
    )
    if not typed:
        return rows
    return rows.select(*(c for c in rows.columns if c != "kinds"), *(F.col(f"kinds.{c}").alias(c) for c in TYPED if c in extra or c == "type"))


def asked(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    """Queries made of every record whose doc_id is divisible by 20: its third and fourth word, its project, a date."""
    d = table(spark, sf_dir, "documents").where("doc_id % 20 = 0")
    rows = d.selectExpr(
        "doc_id AS query_id", "array_join(slice(filter(split(text, '[^A-Za-z]+'), w -> length(w) > 1), 3, 2), ' ') AS text",
        "CASE WHEN source = 'src0' THEN 'global' ELSE source END AS project", "TIMESTAMP_NTZ '2024-01-15 00:00:00' AS as_of",
    )
    if vectors:
        rows = rows.join(table(spark, sf_dir, "embeddings").selectExpr("vec_id AS query_id", "embedding AS vector"), "query_id", "left")
    return rows.where("text <> ''")


def co_retrieval_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(memory_a < memory_b, n, weight): consecutive events of a user, on records event_id mod the number of documents.

    The events of a user are put in order within a project's day first (user_id, day), then the last of a day meets
    the first of the next, so that no window holds all events of one user.
    """
    n_docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("n_docs"))
    events = table(spark, sf_dir, "events").crossJoin(F.broadcast(n_docs))  # one row
    events = events.selectExpr("user_id", "ts", "event_id", "event_id % n_docs AS x", "to_date(ts) AS day")
    inside = W.partitionBy("user_id", "day").orderBy("ts", "event_id")
    steps = events.withColumn("y", F.lag("x").over(inside))
    ends = events.groupBy("user_id", "day").agg(F.min_by("x", F.struct("ts", "event_id")).alias("x"), F.max_by("x", F.struct("ts", "event_id")).alias("last"))
    across = ends.withColumn("y", F.lag("last").over(W.partitionBy("user_id").orderBy("day")))
    pairs = steps.select("x", "y").union(across.select("x", "y")).where("y IS NOT NULL AND x <> y")
    counted = pairs.selectExpr("least(x, y) AS memory_a", "greatest(x, y) AS memory_b").groupBy("memory_a", "memory_b").agg(F.count("*").alias("n"))
    return counted.withColumn("weight", F.expr("least(0.1D * n, 1.0D)"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "event_type AS tool_name", "event_type <> 'error' AS success", "value AS duration_ms", "ts AS timestamp", "'src' || cast(user_id % 20 as string) AS project_id"
    )
