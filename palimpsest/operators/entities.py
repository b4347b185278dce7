"""Named entities with observations, tasks, code files: lookups, lists and what changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folders that hold no sources of their own.
SKIPPED = ("node_modules", "target", "__pycache__")
# What a status may become.
TASK_STATES = {"set": "active", "clear": "cleared"}
# Name segments that say nothing of a project, and the name without any.
DULL_SEGMENTS, DEFAULT_SLUG = ("var", "home", "Desktop", "Project", "src"), "workspace"


def added(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities and the new ones (project_id, name, type) whose name their project doesn't have; of equal names the least type."""
    keys = ["project_id", "name"]
    once = new.groupBy(*keys).agg(F.min("type").alias("type"))
    return entities.unionByName(once.join(entities.select(*keys), keys, "left_anti").select(*entities.columns))


def observed(entities: DataFrame, observations: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after new observations (project_id, name, type, note, at): unknown entities are made first."""
    return added(entities, new.select("project_id", "name", "type")), observations.unionByName(new.select(*observations.columns))


def described(entities: DataFrame, observations: DataFrame, n: int = 10) -> DataFrame:
    """entities with n_notes and notes: the n newest observations, ties by the note.

    Notes are ranked before they are gathered, so no row holds all of a busy entity.
    """
    from palimpsest.operators.store import newest_of

    keys = ["project_id", "name"]
    counts = observations.groupBy(*keys).agg(F.count("*").alias("n_notes"))
    newest = newest_of(observations, keys, [F.desc("at"), "note"], n)
    lists = (
        newest.groupBy(*keys)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at").cast("timestamp"))).alias("t"), "note"))), lambda s: s["note"]).alias("notes"))
    )
    rows = entities.join(counts, keys, "left").join(lists, keys, "left")
    return rows.withColumn("n_notes", F.coalesce("n_notes", F.lit(0))).withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def removed(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the named entities (project_id, name) and the relations that they take part in."""
    keys = ["project_id", "name"]
    left = entities.join(names, keys, "left_anti")
    for end in ("from_name", "to_name"):
        relations = relations.join(names.withColumnRenamed("name", end), ["project_id", end], "left_anti")
    return left, relations


def linked(entities: DataFrame, links: DataFrame) -> DataFrame:
    """links (project_id, from_name, to_name, relation) whose ends both exist, each once."""
    known = entities.select("project_id", "name")
    rows = links.join(known.withColumnRenamed("name", "from_name"), ["project_id", "from_name"], "left_semi")
    return rows.join(known.withColumnRenamed("name", "to_name"), ["project_id", "to_name"], "left_semi").distinct()


def found_by_name(table: DataFrame, name: str, part: str, n: int, equal: dict[str, str] | None = None) -> DataFrame:
    """The n first rows by name of which it holds part, in any case, as it is written; further columns must be equal where given."""
    rows = table.where(F.contains(F.lower(name), F.lit(part.lower())))
    for column, value in (equal or {}).items():
        rows = rows.where(F.col(column) == value)
    return rows.orderBy(name).limit(n)


def source_files(paths: Column) -> Column:
    """Whether a path is a source file: no hidden part, no skipped folder, an extension."""
    parts = F.split(paths, "/")
    dull = F.exists(parts, lambda p: (p.startswith(".") & ~p.isin(".", "..")) | p.isin(*SKIPPED))
    return ~dull & F.element_at(parts, -1).rlike(r".\.[A-Za-z0-9]+$")


def code_files(files: DataFrame) -> DataFrame:
    """(path, language, n_lines, hash) of source files (path, content): the extension is the language."""
    return files.where(source_files(F.col("path"))).select(
        "path", F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1).alias("language"), F.size(F.split("content", "\n")).cast("long").alias("n_lines"),
        F.sha2(F.col("content").cast("binary"), 256).alias("hash"),
    )


def read_sources(spark, folder: str) -> DataFrame:
    """(path, content) of all files below a folder, by Spark's own reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("content").cast("string").alias("content"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or changed, by hash; equal files are left out."""
    both = old.select("path", F.col("hash").alias("was")).join(new.select("path", F.col("hash").alias("now")), "path", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("path", kind.alias("change"))


def to_index(known: DataFrame, files: DataFrame) -> DataFrame:
    """Files that are new or whose hash has changed."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def latest_tasks(events: DataFrame) -> DataFrame:
    """(project_id, task, status, detail): the last event (project_id, task, at, action, detail) of each task; updates keep the status.

    An update doesn't change the status, so the last set or clear gives it, the last event the detail.
    """
    order = F.struct("at", "detail")
    status = F.max_by(F.when(F.col("action") == "set", TASK_STATES["set"]).when(F.col("action") == "clear", TASK_STATES["clear"]), F.when(F.col("action") != "update", order))
    return events.groupBy("project_id", "task").agg(F.coalesce(status, F.lit(TASK_STATES["set"])).alias("status"), F.max_by("detail", order).alias("detail"))


def briefing_size(tokens: int) -> tuple[int, int]:
    """Records and characters of each that fit a number of tokens: four characters a token, three fifths of them for records."""
    budget = tokens * 4 * 60 // 100
    n = min(10, max(1, budget // 120))
    return n, min(500, max(50, budget // n))


def briefing(records: DataFrame, tokens: int) -> DataFrame:
    """(id, content): the newest active records, as many and as much of each as fit."""
    n, chars = briefing_size(tokens)
    rows = records.where("deleted_at IS NULL").orderBy(F.desc("created_at"), "id").limit(n)
    return rows.select("id", F.substring("content", 1, chars).alias("content"))


def project_slug(folder: Column) -> Column:
    """A project's name out of a transcript folder's: the last segment of more than two bytes that says something, else the default."""
    parts = F.filter(F.split(folder, "-"), lambda p: (F.octet_length(p) > 2) & ~p.isin(*DULL_SEGMENTS))
    return F.coalesce(F.lower(F.try_element_at(parts, F.lit(-1))), F.lit(DEFAULT_SLUG))


def analyse(spark, name: str) -> None:
    """Statistics of a catalogue table and its columns, for the optimiser."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
