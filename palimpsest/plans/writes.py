"""Queries that give new versions of tables: inserts, updates, deletes, upserts, exports, ingestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import graph, ingest, store
from palimpsest.operators.enrichment import NOISE_OPENINGS
from palimpsest.operators.predicates import active
from palimpsest.plans.base import IMPORTANCE_SQL, KIND_SQL, MEMORIES_SQL, TS, now, query
from palimpsest.plans.graphs import relations
from palimpsest.plans.records import transcript_lines
from palimpsest.sources.tables import memories, table

DATE = "TIMESTAMP '2024-01-15 00:00:00'"


def date():
    return F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")


@query("SELECT event_id AS id, event_type AS tool_name, coalesce(nullif(event_type, 'error'), 'unknown') AS kind, coalesce(CASE WHEN event_id % 3 > 0 THEN value END, 0.5) AS importance, 'system' AS agent_id FROM events")
def insert_with_defaults(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "events")
        .selectExpr("event_id AS id", "event_type AS tool_name", "nullif(event_type, 'error') AS kind", "CASE WHEN event_id % 3 > 0 THEN value END AS importance")
    )
    return store.with_defaults(rows, {"kind": F.lit("unknown"), "importance": F.lit(0.5), "agent_id": F.lit("system")})


def by_id(spark, sf_dir, every: int):
    return table(spark, sf_dir, "documents").where(f"doc_id % {every} = 0").selectExpr("'m' || lpad(cast(doc_id as string), 8, '0') AS id")


@query(f"WITH {MEMORIES_SQL} SELECT id, project_id, tier, agent_id, created_at FROM memories WHERE doc_id % 20 = 0")
def lookup_by_ids(spark, sf_dir):
    return memories(spark, sf_dir).join(by_id(spark, sf_dir, 20), "id").select("id", "project_id", "tier", "agent_id", "created_at")


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN doc_id % 20 = 0 THEN 'core' ELSE tier END AS tier, CASE WHEN doc_id % 40 = 0 THEN 'patched' ELSE agent_id END AS agent_id FROM memories")
def partial_update(spark, sf_dir):
    """Every twentieth record gets a tier, every fortieth an agent; nulls in the patch change nothing."""
    patch = by_id(spark, sf_dir, 20).selectExpr("id", "'core' AS tier", "CASE WHEN cast(substring(id, 2) as bigint) % 40 = 0 THEN 'patched' END AS agent_id")
    return store.patched(memories(spark, sf_dir).select("id", "tier", "agent_id"), patch)


@query("""WITH b AS (SELECT user_id AS key, event_type AS value, ts AS moment, 0 AS new FROM events WHERE event_id % 2 = 0 UNION ALL
  SELECT user_id, 'new ' || event_type, ts, 1 FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0)
SELECT key, arg_max(value, struct_pack(moment, new, value)) AS value FROM b GROUP BY 1""")
def upsert(spark, sf_dir):
    """The newest value of each key out of an old and a new table."""
    e = table(spark, sf_dir, "events")
    old = e.where("event_id % 2 = 0").selectExpr("user_id AS key", "event_type AS value", "ts AS at")
    new = e.where("event_id % 2 = 1 AND user_id % 3 = 0").selectExpr("user_id AS key", "'new ' || event_type AS value", "ts AS at")
    return store.upserted(old, new, ["key"], "at").select("key", "value")


@query("SELECT user_id AS key, event_id AS value FROM events WHERE user_id % 3 > 0 UNION ALL SELECT DISTINCT user_id, -1 FROM events WHERE user_id % 3 = 0")
def replace_by_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("user_id AS key", "event_id AS value")
    return store.replaced(e, e.where("key % 3 = 0").selectExpr("key", "-1L AS value").distinct(), ["key"])


@query(f"WITH {MEMORIES_SQL} SELECT id, CASE WHEN doc_id % 20 = 0 AND deleted_at IS NULL THEN {DATE} ELSE deleted_at END AS deleted_at FROM memories")
def soft_delete(spark, sf_dir):
    return store.soft_deleted(memories(spark, sf_dir).select("id", "deleted_at"), by_id(spark, sf_dir, 20), date())


@query(f"WITH {MEMORIES_SQL} SELECT id, project_id FROM memories WHERE project_id <> 'src1' AND deleted_at IS NULL")
def hard_delete(spark, sf_dir):
    """A project is deleted, and what was marked as deleted before."""
    return store.hard_deleted(memories(spark, sf_dir).select("id", "project_id", "deleted_at"), (F.col("project_id") == "src1") | ~active()).drop("deleted_at")


@query(f"""WITH {MEMORIES_SQL} SELECT id, '{{"id":"' || id || '","tier":"' || tier || '","access_count":' || access_count || '}}' AS line FROM memories WHERE deleted_at IS NULL""")
def export_lines(spark, sf_dir):
    return store.exported(memories(spark, sf_dir).select("id", "tier", "access_count", "created_at", "deleted_at").withColumn("at", F.col("created_at"))).select(
        "id", F.concat(F.regexp_extract("line", r'^(\{"id":.*?"access_count":[0-9]+)', 1), F.lit("}")).alias("line")
    )


@query(f"WITH {MEMORIES_SQL} SELECT DISTINCT user_id FROM events WHERE 'm' || lpad(user_id::VARCHAR, 8, '0') IN (SELECT id FROM memories WHERE deleted_at IS NULL AND tier = 'core')")
def existence(spark, sf_dir):
    """Users whose number is that of an active core record."""
    keys = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("id", F.concat(F.lit("m"), F.lpad(F.col("user_id").cast("string"), 8, "0")))
    return store.existing(keys, memories(spark, sf_dir), "id", active() & (F.col("tier") == "core")).select("user_id")


@query(f"WITH t AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL 5 DAY END AS expires_at FROM events) SELECT * FROM t WHERE expires_at IS NULL OR expires_at > {DATE}")
def unexpired(spark, sf_dir):
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 3 > 0 THEN ts + INTERVAL '5' DAY END AS expires_at")
    return store.unexpired(rows, date())


@query(f"SELECT event_id, ts FROM events WHERE ts > {DATE} - INTERVAL 7 DAY")
def log_pruning(spark, sf_dir):
    return store.younger(table(spark, sf_dir, "events").select("event_id", "ts"), date(), 7, "ts")


@query(f"WITH {MEMORIES_SQL} SELECT id, access_count + 1 AS access_count, {TS} AS last_accessed FROM memories WHERE deleted_at IS NULL AND doc_id % 20 = 0")
def recall(spark, sf_dir):
    return store.recalled(memories(spark, sf_dir), by_id(spark, sf_dir, 20), now()).select("id", "access_count", "last_accessed")


@query(f"""WITH {MEMORIES_SQL}, votes AS (SELECT 'm' || lpad((event_id % (SELECT count(*) FROM documents))::VARCHAR, 8, '0') AS id, event_type <> 'error' AS yes FROM events)
SELECT id, round(greatest(0.0, least(1.0, any_value(coalesce(confidence, 0.5)) + 0.1::DOUBLE * (count(*) FILTER (yes) - count(*) FILTER (NOT yes)))), 6) AS confidence,
  count(*) FILTER (yes) AS confirmations, count(*) FILTER (NOT yes) AS contradictions FROM votes JOIN memories USING (id) GROUP BY 1""")
def confirmations(spark, sf_dir):
    votes = relations(spark, sf_dir).selectExpr("'m' || lpad(cast(from_id as string), 8, '0') AS id", "relation_type <> 'error' AS confirm")
    return store.judged(memories(spark, sf_dir, "confidence"), votes)


@query(f"""WITH {MEMORIES_SQL}, incoming AS (SELECT 'n' || lpad(doc_id::VARCHAR, 8, '0') AS id, project_id,
  CASE WHEN doc_id % 4 = 0 THEN content ELSE 'note: ' || content END AS content FROM memories),
valid AS (SELECT *, sha256(content) AS content_hash FROM incoming WHERE strlen(content) <= 100000 AND trim(content) <> ''),
fresh AS (SELECT * FROM valid WHERE (project_id, content_hash) NOT IN (SELECT (project_id, sha256(content)) FROM memories WHERE deleted_at IS NULL)
  QUALIFY row_number() OVER (PARTITION BY project_id, content_hash ORDER BY id) = 1),
kinds AS (SELECT *, {KIND_SQL} AS type FROM fresh) SELECT id, project_id, content_hash, type, round({IMPORTANCE_SQL}, 6) AS importance, 0.5::DOUBLE AS confidence FROM kinds""")
def store_records(spark, sf_dir):
    """Storing all records again, three quarters of them changed."""
    m = memories(spark, sf_dir)
    new = m.selectExpr("'n' || substring(id, 2) AS id", "project_id", "CASE WHEN doc_id % 4 = 0 THEN content ELSE 'note: ' || content END AS content")
    return store.stored(new, m, now()).select("id", "project_id", "content_hash", "type", F.round("importance", 6).alias("importance"), "confidence")


@query("SELECT event_id AS id, event_type AS tool_name FROM events WHERE event_id % 3 < 2")
def audit_append(spark, sf_dir):
    """Two overlapping batches of calls: each is logged once."""
    e = table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS tool_name")
    return store.logged(e.where("id % 3 < 2"), e.where("id % 3 = 0"))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE vec_id % 7 <> 0")
def vector_upsert(spark, sf_dir):
    """Every fifth vector is replaced, then every seventh deleted."""
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "embedding", "1 AS version")
    made = store.VectorStore(e).upsert(e.where("id % 5 = 0").withColumn("version", F.lit(2))).delete(e.where("id % 7 = 0"))
    return made.table.select("id", "version")


RELATIONS = "SELECT event_id % (SELECT count(*) FROM documents) AS from_id, user_id AS to_id, event_type AS relation_type, CASE WHEN event_type = 'error' THEN ts END AS valid_to FROM events"


@query(f"""WITH r AS ({RELATIONS}), n AS (SELECT DISTINCT from_id, to_id, 'knows' AS relation_type FROM r UNION SELECT from_id, to_id, relation_type FROM r WHERE from_id % 3 = 0)
SELECT from_id, to_id, relation_type, valid_to FROM r UNION ALL SELECT *, NULL FROM n WHERE (from_id, to_id, relation_type) NOT IN (SELECT (from_id, to_id,
  relation_type) FROM r WHERE valid_to IS NULL)""")
def edge_create(spark, sf_dir):
    r = relations(spark, sf_dir).drop("weight")
    new = r.selectExpr("from_id", "to_id", "'knows' AS relation_type").union(r.where("from_id % 3 = 0").select("from_id", "to_id", "relation_type"))
    return graph.created(r, new.withColumn("valid_to", F.lit(None).cast("timestamp_ntz")))


@query(f"WITH r AS ({RELATIONS}) SELECT from_id, to_id, relation_type, CASE WHEN from_id % 20 = 0 AND relation_type = 'click' THEN {TS} ELSE valid_to END AS valid_to FROM r")
def edge_invalidate(spark, sf_dir):
    r = relations(spark, sf_dir).drop("weight")
    return graph.invalidated(r, r.where("from_id % 20 = 0 AND relation_type = 'click'"), now())


TEXTS_SQL = """texts AS (SELECT 't' || conv_id || '-' || turn AS id, 'src' || (conv_id % 5) AS project_id, CASE WHEN turn % 3 = 2 THEN 'Sure, ' || substr(text,
  1, 100) ELSE text END AS content,
  TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn) AS created_at FROM conversations UNION ALL
  SELECT 'u' || conv_id || '-' || turn, 'src9', text, TIMESTAMP '2024-01-02' FROM conversations WHERE turn = 1)"""
_TRIMMED = "regexp_replace(content, '^\\s+|\\s+$', '', 'g')"
_NOISE = f"""(strlen({_TRIMMED}) < 50 OR (strlen({_TRIMMED}) < 500 AND starts_with({_TRIMMED},
  '{{') AND ends_with({_TRIMMED}, '}}')) OR (strlen({_TRIMMED}) < 200 AND (""" + " OR ".join(
    f"starts_with({_TRIMMED}, '{p.replace(chr(39), chr(39) * 2)}')" for p in NOISE_OPENINGS) + ")))"
INGEST_SQL = f"""{TEXTS_SQL}, hashed AS (SELECT *, sha256(content) AS content_hash, {_NOISE} AS noise FROM texts
  WHERE content IS NOT NULL), known AS (SELECT DISTINCT sha256(text) AS h FROM conversations WHERE conv_id % 10 = 0),
fresh AS (SELECT * FROM hashed WHERE NOT noise AND content_hash NOT IN (SELECT h FROM known WHERE h IS NOT NULL) QUALIFY row_number()
  OVER (PARTITION BY content_hash ORDER BY created_at, id) = 1)"""


def texts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    own = c.selectExpr("'t' || conv_id || '-' || turn AS id", "'src' || (conv_id % 5) AS project_id", "CASE WHEN turn % 3 = 2 THEN 'Sure, ' || substring(text, 1, 100) ELSE text END AS content",
                       "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(conv_id * 60 + turn as decimal(18,6))) AS created_at")
    again = c.where("turn = 1").selectExpr("'u' || conv_id || '-' || turn", "'src9'", "text", "TIMESTAMP_NTZ '2024-01-02 00:00:00'")
    return own.union(again).where("content IS NOT NULL"), c.where("conv_id % 10 = 0").select(F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query(f"WITH {INGEST_SQL}, kinds AS (SELECT *, {KIND_SQL} AS type FROM fresh) SELECT id, project_id, content_hash, type, round({IMPORTANCE_SQL}, 6) AS importance, 0.7::DOUBLE AS confidence, 'transcript_ingest' AS agent_id FROM kinds")
def transcript_ingest(spark, sf_dir):
    made = ingest.ingested(*texts(spark, sf_dir))
    return made.select("id", "project_id", "content_hash", "type", F.round("importance", 6).alias("importance"), "confidence", "agent_id")


@query(f"WITH {INGEST_SQL} SELECT h.project_id, count(f.id) AS n_new, count(*) FILTER (h.noise) AS n_noise, count(*) FILTER (NOT h.noise AND f.id IS NULL) AS n_duplicate FROM hashed h LEFT JOIN fresh f USING (id) GROUP BY 1")
def ingest_dry_run(spark, sf_dir):
    return ingest.ingest_counts(*texts(spark, sf_dir))


@query("SELECT conv_id AS file, count(*) AS n_lines, count(*) FILTER (turn % 5 = 4) AS n_bad FROM conversations GROUP BY 1")
def transcript_bad_lines(spark, sf_dir):
    """Every fifth line is cut off in the middle."""
    lines = (
        transcript_lines(spark, sf_dir)
        .select(F.col("line_id.conv_id").alias("file"), F.expr("CASE WHEN line_id.turn % 5 = 4 THEN substring(line, 1, 12) ELSE line END").alias("line"))
    )
    return ingest.bad_lines(lines)


@query("""SELECT 'dir' || (conv_id % 7) || '/sub' AS folder, count(*) AS n_files, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM conversations GROUP BY ROLLUP (folder)""")
def folder_summary(spark, sf_dir):
    """Turns as files of folders, with the totals."""
    c = (
        table(spark, sf_dir, "conversations")
        .selectExpr("'dir' || (conv_id % 7) || '/sub/' || conv_id || '.jsonl' AS path", "cast(coalesce(octet_length(text), 0) as bigint) AS length")
    )
    return ingest.folder_summary(c)


@query(f"WITH {MEMORIES_SQL} SELECT coalesce(agent_id, 'none') AS agent, count(*) AS n, count(*) FILTER (created_at > {TS} - INTERVAL 24 HOUR) AS n_day FROM memories GROUP BY 1")
def ingest_status(spark, sf_dir):
    rows = memories(spark, sf_dir).groupBy(F.coalesce("agent_id", F.lit("none")).alias("agent"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.expr("created_at > TIMESTAMP_NTZ '2024-02-01 00:00:00' - INTERVAL '24' HOUR")).alias("n_day"))
