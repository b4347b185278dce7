"""Queries over entities, source files, tasks and lists, and the figures of status reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import entities, store
from palimpsest.operators.predicates import active
from palimpsest.plans.base import EDGES_SQL, MEMORIES_SQL, query
from palimpsest.sources.tables import co_retrieval_edges, memories, table

NAMED_SQL = """named AS (SELECT 'src' || (s_suppkey % 5) AS project_id, s_name AS name, 'nation ' || s_nationkey AS type FROM supplier),
notes AS (SELECT 'src' || (user_id % 5) AS project_id, 'Supplier#' || lpad(user_id::VARCHAR, 9, '0') AS name, event_type || ' ' || event_id AS note, ts AS moment FROM events)"""


def named(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("'src' || (s_suppkey % 5) AS project_id", "s_name AS name", "'nation ' || s_nationkey AS type")


def notes(spark, sf_dir):
    return (
        table(spark, sf_dir, "events")
        .selectExpr("'src' || (user_id % 5) AS project_id", "'Supplier#' || lpad(cast(user_id as string), 9, '0') AS name", "event_type || ' ' || event_id AS note", "ts AS at")
    )


@query(f"""WITH {NAMED_SQL}, fresh AS (SELECT project_id, name, min('seen ' || split_part(note, ' ', 1)) AS type FROM notes GROUP BY 1, 2)
SELECT * FROM named UNION ALL SELECT * FROM fresh ANTI JOIN named USING (project_id, name)""")
def entity_create(spark, sf_dir):
    """Suppliers are entities; users with a note become some if no supplier has their name."""
    new = notes(spark, sf_dir).selectExpr("project_id", "name", "'seen ' || split_part(note, ' ', 1) AS type", "note", "at")
    return entities.observed(named(spark, sf_dir), notes(spark, sf_dir), new)[0]


@query(f"""WITH {NAMED_SQL}, newest AS (SELECT *, row_number() OVER (PARTITION BY project_id, name ORDER BY moment DESC, note) AS r FROM notes QUALIFY r <= 10),
lists AS (SELECT project_id, name, string_agg(note, ',' ORDER BY r) AS notes FROM newest GROUP BY 1, 2), counts AS (SELECT project_id, name, count(*) AS n FROM notes GROUP BY 1, 2)
SELECT project_id, name, type, coalesce(n, 0) AS n_notes, coalesce(notes, '') AS notes FROM named LEFT JOIN lists USING (project_id, name) LEFT
  JOIN counts USING (project_id, name)""")
def entity_get(spark, sf_dir):
    return entities.described(named(spark, sf_dir), notes(spark, sf_dir)).withColumn("notes", F.array_join("notes", ","))


LINKS_SQL = "links AS (SELECT DISTINCT 'src' || (user_id % 5) AS project_id, 'Supplier#' || lpad(user_id::VARCHAR, 9, '0') AS from_name, 'Supplier#' || lpad((event_id % (SELECT count(*) + 1 FROM supplier))::VARCHAR, 9, '0') AS to_name, event_type AS relation FROM events)"


def links(spark, sf_dir):
    n = table(spark, sf_dir, "supplier").agg((F.count("*") + 1).alias("n"))
    return (
        table(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
        .selectExpr("'src' || (user_id % 5) AS project_id", "'Supplier#' || lpad(cast(user_id as string), 9, '0') AS from_name", "'Supplier#' || lpad(cast(event_id % n as string), 9, '0') AS to_name", "event_type AS relation")
    )


@query(f"""WITH {NAMED_SQL}, {LINKS_SQL} SELECT * FROM links WHERE (project_id, from_name) IN (SELECT (project_id, name)
  FROM named) AND (project_id, to_name) IN (SELECT (project_id, name) FROM named)""")
def entity_link(spark, sf_dir):
    return entities.linked(named(spark, sf_dir), links(spark, sf_dir))


@query(f"""WITH {NAMED_SQL}, {LINKS_SQL}, gone AS (SELECT project_id, name FROM named WHERE type LIKE '%1') SELECT * FROM links
  WHERE (project_id, from_name) NOT IN (SELECT (project_id, name) FROM gone)
  AND (project_id, to_name) NOT IN (SELECT (project_id, name) FROM gone)""")
def entity_delete(spark, sf_dir):
    """Entities of some types go, and the relations that they take part in."""
    e = named(spark, sf_dir)
    return entities.removed(e, links(spark, sf_dir).distinct(), e.where("type LIKE '%1'").select("project_id", "name"))[1]


@query("SELECT s_name AS name, s_suppkey FROM supplier WHERE contains(lower(s_name), '01') ORDER BY s_name LIMIT 20")
def entity_search(spark, sf_dir):
    return entities.found_by_name(table(spark, sf_dir, "supplier").selectExpr("s_name AS name", "s_suppkey"), "name", "01", 20)


def pages_as_files(spark, sf_dir):
    """Pages as files (path, content): some lie in folders that are skipped, some have no extension."""
    path = "CASE page_id % 6 WHEN 0 THEN 'a/node_modules/x/' WHEN 1 THEN 'a/.hidden/' WHEN 2 THEN 'b/target/' ELSE 'lib/' END || 'page' || page_id || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '.py' ELSE '.rs' END"
    return table(spark, sf_dir, "pages").selectExpr(f"{path} AS path", "html AS content")


FILES_SQL = """files AS (SELECT CASE page_id % 6 WHEN 0 THEN 'a/node_modules/x/' WHEN 1 THEN 'a/.hidden/' WHEN 2 THEN 'b/target/' ELSE 'lib/' END || 'page' || page_id
  || CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '.py' ELSE '.rs' END AS path, html AS content FROM pages),
code AS (SELECT path, split_part(path, '.', -1) AS language, len(string_split(content, chr(10)))::BIGINT AS n_lines, sha256(content) AS hash FROM files
  WHERE path LIKE 'lib/%.%')"""


@query(f"WITH {FILES_SQL} SELECT * FROM code")
def code_scan(spark, sf_dir):
    """Source files with language, lines and hash; hidden and skipped folders are left out."""
    return entities.code_files(pages_as_files(spark, sf_dir))


@query(f"WITH {FILES_SQL} SELECT path AS name, language FROM code WHERE contains(lower(path), 'page1') AND language = 'rs' ORDER BY 1 LIMIT 20")
def code_search(spark, sf_dir):
    files = entities.code_files(pages_as_files(spark, sf_dir)).select(F.col("path").alias("name"), "language")
    return entities.found_by_name(files, "name", "PAGE1", 20, {"language": "rs"})


_OLD = "old AS (SELECT path, CASE WHEN n_lines % 2 = 0 AND path LIKE '%1.rs' THEN 'x' ELSE hash END AS hash FROM code WHERE path NOT LIKE '%3.rs' UNION ALL SELECT 'lib/gone.rs', 'y')"


def known_files(spark, sf_dir):
    now_there = entities.code_files(pages_as_files(spark, sf_dir))
    old = now_there.where("path NOT LIKE '%3.rs'").selectExpr("path", "CASE WHEN n_lines % 2 = 0 AND path LIKE '%1.rs' THEN 'x' ELSE hash END AS hash")
    return old.union(spark.createDataFrame([("lib/gone.rs", "y")], "path string, hash string")), now_there


@query(f"""WITH {FILES_SQL}, {_OLD} SELECT path, CASE WHEN o.hash IS NULL THEN 'added' WHEN c.hash IS NULL THEN 'removed' ELSE 'changed' END AS change
  FROM code c FULL JOIN old o USING (path) WHERE c.hash IS DISTINCT FROM o.hash""")
def code_diff(spark, sf_dir):
    return entities.changes(*known_files(spark, sf_dir))


@query(f"WITH {FILES_SQL}, {_OLD} SELECT path, hash FROM code WHERE (path, hash) NOT IN (SELECT (path, hash) FROM old)")
def code_to_index(spark, sf_dir):
    return entities.to_index(*known_files(spark, sf_dir)).select("path", "hash")


@query(f"WITH {FILES_SQL} SELECT language, (n_lines > 1)::VARCHAR AS kind, count(*) AS n, sum(n_lines)::BIGINT AS n_lines FROM code GROUP BY GROUPING SETS ((language), (kind), ())")
def code_stats(spark, sf_dir):
    """Files by language, by kind, and in all, in one pass."""
    files = entities.code_files(pages_as_files(spark, sf_dir)).withColumn("kind", (F.col("n_lines") > 1).cast("string"))
    return files.groupingSets([[F.col("language")], [F.col("kind")], []], F.col("language"), F.col("kind")).agg(F.count("*").alias("n"), F.sum("n_lines").alias("n_lines"))


_ACTION = "CASE event_type WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'clear' ELSE 'update' END"


@query(f"""WITH t AS (SELECT 'src' || (user_id % 20) AS project_id, 'task' || user_id AS task, ts AS moment, {_ACTION} AS action, event_type || event_id AS detail FROM events)
SELECT project_id, task, coalesce(arg_max(CASE action WHEN 'set' THEN 'active' WHEN 'clear' THEN 'cleared' END, struct_pack(moment,
  detail)) FILTER (action <> 'update'), 'active') AS status, arg_max(detail, struct_pack(moment, detail)) AS detail FROM t GROUP BY 1, 2""")
def task_states(spark, sf_dir):
    return entities.latest_tasks(table(spark, sf_dir, "events").selectExpr("'src' || (user_id % 20) AS project_id", "'task' || user_id AS task", "ts AS at", f"{_ACTION} AS action", "event_type || event_id AS detail"))


@query(f"WITH {MEMORIES_SQL} SELECT id, substr(content, 1, 120) AS content FROM memories WHERE deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 9")
def briefing(spark, sf_dir):
    """A briefing of 450 tokens: 1,080 characters, nine records of 120 each."""
    return entities.briefing(memories(spark, sf_dir), 450)


@query(f"WITH {MEMORIES_SQL} SELECT id, round(importance, 6) AS importance, type FROM memories WHERE deleted_at IS NULL ORDER BY importance DESC, id LIMIT 5")
def top_importance(spark, sf_dir):
    rows = memories(spark, sf_dir, "type", "importance").where(active()).orderBy(F.desc("importance"), "id").limit(5)
    return rows.select("id", F.round("importance", 6).alias("importance"), "type")


@query(f"WITH {MEMORIES_SQL} SELECT id, created_at FROM memories WHERE contains(lower(content), 'the') ORDER BY created_at DESC, id LIMIT 30 OFFSET 10")
def paged_list(spark, sf_dir):
    """The second page of a listing with a search word."""
    rows = memories(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("the"))).orderBy(F.desc("created_at"), "id")
    return rows.offset(10).limit(30).select("id", "created_at")


@query(f"""WITH {MEMORIES_SQL}, five AS (SELECT id, regexp_replace(unnest(string_split_regex(lower(substr(content, 1, 200)), '\\s+')), '[^\\p{{L}}\\p{{N}}_-]',
  '', 'g') AS tag FROM memories)
SELECT id, CASE WHEN length(content) > 500 THEN substr(content, 1, 500) ELSE content END AS content, length(content) > 500 AS truncated,
  round(coalesce(confidence, 0.5), 6) AS confidence,
  coalesce(agent_id, 'system') AS agent_id, round(CASE WHEN strlen(content) > 20 THEN 0.5::DOUBLE ELSE 0.2 END + CASE WHEN doc_id % 2 = 0 THEN 0.3::DOUBLE ELSE 0 END + 0.2::DOUBLE, 6) AS quality FROM memories WHERE deleted_at IS NULL""")
def shaped_results(spark, sf_dir):
    """Records as a search shows them: content cut, defaults filled, quality by length, tags and type."""
    from palimpsest.operators.scoring import quality_fallback

    rows = memories(spark, sf_dir, "confidence", "type").where(active()).withColumn("tags", F.expr("CASE WHEN doc_id % 2 = 0 THEN '[]' END"))
    return rows.select("id", F.substring("content", 1, 500).alias("content"), (F.char_length("content") > 500).alias("truncated"), F.round(F.coalesce("confidence", F.lit(0.5)), 6).alias("confidence"),
                       F.coalesce("agent_id", F.lit("system")).alias("agent_id"), F.round(quality_fallback(), 6).alias("quality"))


@query(f"""WITH {MEMORIES_SQL}, {EDGES_SQL} SELECT (SELECT count(*) FROM edges) AS n_edges, round((SELECT avg(weight)
  FROM edges), 6) AS avg_weight, round((SELECT max(weight) FROM edges), 6) AS max_weight,
  (SELECT count(DISTINCT label) FROM embeddings) AS n_concepts, count(*) FILTER (tier = 'core') AS n_core, count(*) FILTER (tier = 'ephemeral') AS n_ephemeral,
  round(avg(processing_depth), 6) AS avg_depth FROM memories""")
def system_stats(spark, sf_dir):
    edges = co_retrieval_edges(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.round(F.avg("weight"), 6).alias("avg_weight"), F.round(F.max("weight"), 6).alias("max_weight"))
    nodes = table(spark, sf_dir, "embeddings").agg(F.count_distinct("label").alias("n_concepts"))
    rows = (
        memories(spark, sf_dir)
        .agg(F.count_if(F.col("tier") == "core").alias("n_core"), F.count_if(F.col("tier") == "ephemeral").alias("n_ephemeral"), F.round(F.avg("processing_depth"), 6).alias("avg_depth"))
    )
    return edges.crossJoin(nodes).crossJoin(rows)  # one row each


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'embeddings', count(*)
  FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels""")
def health(spark, sf_dir):
    """Rows of each table."""
    counts = [table(spark, sf_dir, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("documents", "events", "embeddings", "labels")]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("""WITH f AS (SELECT CASE page_id % 4 WHEN 0 THEN '-var-home-user-Project-Lake' || page_id WHEN 1 THEN '-home-src' WHEN 2 THEN '-a-b-River-Desktop' ELSE 'Sea-x' END AS folder FROM pages)
SELECT DISTINCT folder, CASE WHEN folder LIKE '%Lake%' THEN lower(split_part(folder, '-',
  -1)) WHEN folder = '-home-src' THEN 'workspace' WHEN folder LIKE '%River%' THEN 'river' ELSE 'sea' END AS project FROM f""")
def project_slugs(spark, sf_dir):
    folder = F.expr("CASE page_id % 4 WHEN 0 THEN '-var-home-user-Project-Lake' || page_id WHEN 1 THEN '-home-src' WHEN 2 THEN '-a-b-River-Desktop' ELSE 'Sea-x' END")
    return table(spark, sf_dir, "pages").select(folder.alias("folder")).distinct().withColumn("project", entities.project_slug(F.col("folder")))


@query("""SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3""")
def keep_newest(spark, sf_dir):
    return store.newest_of(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 3)


