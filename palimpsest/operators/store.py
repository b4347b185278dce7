"""Writes as new versions of tables: every function takes tables and gives the table that replaces them, or its changed rows.

A caller writes the result beside the old table and swaps them; nothing is updated in place, so a lost executor or a second
run does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators.enrichment import classify, importance
from palimpsest.operators.predicates import active

# Bytes that a record may have, confidence of a new and of an ingested one, step of a confirmation.
MOST_CONTENT, CONFIDENCE, STEP = 100_000, 0.5, 0.1


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with every column of defaults: missing ones are added, nulls filled."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    return rows


def patched(table: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """table with the columns of patch (one row a key) in place of its own wherever they aren't null; unknown keys of patch are ignored."""
    columns = [c for c in patch.columns if c != key]
    new = patch.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    rows = table.join(new, key, "left")
    return rows.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))


def upserted(table: DataFrame, new: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """table and new (same columns) with one row for each key: the one with the greatest `newest`, among equals one of new."""
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(newest, "_new")).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*table.columns)


def replaced(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table without the rows whose keys new has, and all rows of new."""
    return table.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def soft_deleted(table: DataFrame, ids: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """table in which the records named in ids and still in use are deleted at a time."""
    rows = table.join(ids.select(key).distinct().withColumn("_gone", F.lit(True)), key, "left")
    return rows.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_gone").select(*table.columns)


def hard_deleted(table: DataFrame, condition: Column) -> DataFrame:
    """table without the rows of which condition is true."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def exported(table: DataFrame) -> DataFrame:
    """(id, line): active records as JSON, newest first."""
    rows = table.where(active()).orderBy(F.desc("created_at"), "id")
    return rows.select("id", F.to_json(F.struct(*(c for c in table.columns if c not in ("embedding", "deleted_at")))).alias("line"))


def write_export(table: DataFrame, path: str, lines: bool = True) -> None:
    """The export as text files of one JSON object a line, or, not lines, Spark's json files of the rows."""
    if lines:
        exported(table).select("line").write.text(path)
    else:
        table.where(active()).drop("embedding", "deleted_at").write.json(path)


def existing(keys: DataFrame, table: DataFrame, key: str = "id", condition: Column | None = None) -> DataFrame:
    """The keys of which table has a row (that meets the condition)."""
    rows = table if condition is None else table.where(condition)
    return keys.join(rows.select(key).distinct(), key, "left_semi")


def unexpired(table: DataFrame, at: Column, expiry: str = "expires_at") -> DataFrame:
    """Rows that don't expire, or not yet."""
    return table.where(F.col(expiry).isNull() | (F.col(expiry) > at))


def newest_of(table: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The n first rows of each key in an order (columns; ties must be settled by it)."""
    return table.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def younger(table: DataFrame, at: Column, days: int, timestamp: str) -> DataFrame:
    """Rows of the last days."""
    return table.where(F.col(timestamp) > at - F.expr(f"INTERVAL '{days}' DAY"))


def recalled(table: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Active records of the ids, with one more access and the time of it: the rows to show and to write back."""
    rows = table.where(active()).join(ids.select("id").distinct(), "id", "left_semi")
    return rows.withColumn("access_count", F.col("access_count") + 1).withColumn("last_accessed", at)


def judged(table: DataFrame, votes: DataFrame) -> DataFrame:
    """(id, confidence, confirmations, contradictions) of the records with votes (id, confirm boolean).

    Each confirmation adds a tenth, each contradiction takes one away, within 0 and 1. Votes are counted first: the
    order among them doesn't matter unless the bounds are met, and then the sum counts.
    """
    counted = votes.groupBy("id").agg(F.count_if("confirm").alias("confirmations"), F.count_if(~F.col("confirm")).alias("contradictions"))
    moved = F.coalesce("confidence", F.lit(CONFIDENCE)) + STEP * (F.col("confirmations") - F.col("contradictions"))
    return table.join(counted, "id").select("id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), moved)), 6).alias("confidence"), "confirmations", "contradictions")


def stored(new: DataFrame, table: DataFrame, at: Column, confidence: float = CONFIDENCE, agent: str | None = None) -> DataFrame:
    """Records out of new (id, project_id, content): valid ones that neither table nor an earlier row of new has already.

    Too long and empty contents are left out. Type, importance and hash are derived; of equal contents in a project
    the row with the least id is taken.
    """
    rows = new.where((F.octet_length("content") <= MOST_CONTENT) & (F.trim("content") != "")).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    known = table.where(active()).select("project_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")).distinct()
    fresh = rows.join(known, ["project_id", "content_hash"], "left_anti")
    firsts = fresh.groupBy("project_id", "content_hash").agg(F.min("id").alias("id"))
    fresh = fresh.join(firsts, ["project_id", "content_hash", "id"], "left_semi").withColumn("low", F.lower("content")).withColumn("type", classify(F.col("low")))
    fresh = fresh.withColumn("importance", importance(F.col("low"), F.col("content"), F.col("type"))).drop("low")
    return fresh.select("id", "project_id", "content", "content_hash", "type", "importance", F.lit(confidence).alias("confidence"), F.lit(agent).cast("string").alias("agent_id"), at.alias("created_at"))


def logged(calls: DataFrame, log: DataFrame) -> DataFrame:
    """log with the calls that it doesn't have yet; a call that fails to say how long it took has no duration."""
    return log.unionByName(calls.join(log.select("id"), "id", "left_anti"), allowMissingColumns=True)


class VectorStore:
    """Vectors (id, project_id, embedding, deleted_at) as an immutable table: each change gives a new store."""

    def __init__(self, table: DataFrame):
        self.table = table

    def upsert(self, new: DataFrame) -> VectorStore:
        return VectorStore(replaced(self.table, new, ["id"]))

    def delete(self, ids: DataFrame) -> VectorStore:
        return VectorStore(self.table.join(ids.select("id").distinct(), "id", "left_anti"))

    def count(self) -> int:
        return self.table.count()

    def ready(self) -> bool:
        return not self.table.isEmpty()

    def search(self, queries: DataFrame, k: int, least: float = 0.3, rescaled: bool = False) -> DataFrame:
        from palimpsest.operators.retrieval import semantic

        return semantic(self.table, queries, k, least, rescaled)
