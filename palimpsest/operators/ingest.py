"""Texts out of transcript lines, and tiers by use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources import lines

#: Bytes from which a text is kept, and over which it is cut.
LEAST_BYTES, MOST_BYTES = 50, 2000


def transcript_texts(rows: DataFrame, key: str = "line_id", line: str = "line") -> DataFrame:
    """(key, part, content) of JSON lines: message.content (text, or blocks with texts), else the top content.

    Texts under LEAST_BYTES are left out; those over MOST_BYTES are cut to as many characters, with "..." after them
    (characters, so that none is split). A line that isn't JSON gives no rows. part counts from 0.
    """

    def text(v: str) -> str:
        return f"CASE WHEN schema_of_variant({v}) = 'STRING' THEN CAST({v} AS STRING) END"

    def kept(array: str) -> str:
        return f"filter({array}, t -> octet_length(t) >= {LEAST_BYTES})"

    rows = rows.select(key, F.expr(f"try_parse_json(`{line}`)").alias("v"))
    rows = rows.select(key, *(F.expr(f"try_variant_get(v, '{path}', 'variant')").alias(name) for name, path in (("inner", "$.message.content"), ("outer", "$.content"))))
    blocks = "transform(transform(try_variant_get(inner, '$', 'array<variant>'), b -> try_variant_get(b, '$.text', 'variant')), t -> " + text("t") + ")"
    found = rows.withColumn("texts", F.expr(kept(f"CASE WHEN schema_of_variant(inner) = 'STRING' THEN array(CAST(inner AS STRING)) ELSE {blocks} END")))
    outer = kept(f"array({text('outer')})")
    found = found.withColumn("texts", F.expr(f"CASE WHEN size(texts) > 0 THEN texts ELSE {outer} END"))
    cut = F.when(F.octet_length("content") > MOST_BYTES, F.concat(F.substring("content", 1, MOST_BYTES), F.lit("..."))).otherwise(F.col("content"))
    return found.select(key, F.posexplode("texts").alias("part", "content")).select(key, F.col("part").cast("long").alias("part"), cut.alias("content"))


def tier_by_use(reads: Column, tier: Column) -> Column:
    """core from 10 reads on; an ephemeral record is established from 5, relevant from 2; else the tier stays."""
    fresh = tier == "ephemeral"
    return F.when(reads >= 10, "core").when(fresh & (reads >= 5), "established").when(fresh & (reads >= 2), "relevant").otherwise(tier)


def folder_summary(files: DataFrame) -> DataFrame:
    """(folder, n_files, n_bytes) of files (path, length), and a row with the totals (folder null)."""
    return files.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).rollup("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


def list_files(spark, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, length) of the files below a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")


def read_lines(spark, folder: str) -> DataFrame:
    """(line_id, line) of transcript files: line_id has the file and the line's number in it, from 1."""
    rows = lines.read_lines(spark, folder)
    return rows.select(F.struct("file", F.col("line_number").alias("n")).alias("line_id"), "line")


def bad_lines(rows: DataFrame, group: str = "file", line: str = "line") -> DataFrame:
    """(group, n_lines, n_bad): lines that aren't JSON are counted, they end nothing."""
    bad = F.expr(f"try_parse_json(`{line}`) IS NULL AND trim(`{line}`) <> ''")
    return rows.groupBy(group).agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_bad"))


def ingested(texts: DataFrame, known: DataFrame, confidence: float = 0.7, agent: str = "transcript_ingest") -> DataFrame:
    """Records out of texts (id, project_id, content, created_at) that say something and aren't there yet, with type, importance and hash.

    known: (content_hash) of earlier records. Of equal texts the earliest (then least id) is taken.
    """
    from palimpsest.operators.enrichment import classify, importance, noise

    rows = texts.where(~noise(F.col("content"))).withColumn("content_hash", F.sha2(F.col("content").cast("binary"), 256))
    fresh = rows.join(known.select("content_hash").distinct(), "content_hash", "left_anti")
    firsts = fresh.groupBy("content_hash").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"))
    fresh = fresh.join(firsts, ["content_hash", "id"], "left_semi").withColumn("low", F.lower("content")).withColumn("type", classify(F.col("low")))
    fresh = fresh.withColumn("importance", importance(F.col("low"), F.col("content"), F.col("type")))
    return fresh.select("id", "project_id", "content", "content_hash", "type", "importance", F.lit(confidence).alias("confidence"), F.lit(agent).alias("agent_id"), "created_at")


def ingest_counts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(project_id, n_new, n_noise, n_duplicate): what ingesting would do; all duplicates but the first taken are counted."""
    from palimpsest.operators.enrichment import noise

    rows = texts.select("project_id", "id", noise(F.col("content")).alias("noise"))
    new = ingested(texts, known).select("id").withColumn("new", F.lit(True))
    marked = rows.join(new, "id", "left")
    return (
        marked.groupBy("project_id")
        .agg(F.count_if("new").alias("n_new"), F.count_if("noise").alias("n_noise"), F.count_if(F.col("new").isNull() & ~F.col("noise")).alias("n_duplicate"))
    )
