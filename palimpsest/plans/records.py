"""Queries over records, events and transcripts: enrichment, counts, lists, decay, deduplication, drift."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.operators import analysis, enrichment, ingest, scoring
from palimpsest.operators.predicates import active, confident, in_project, valid_at, visible_to
from palimpsest.plans.base import ACT_R_SQL, CONFIDENCE_SQL, MEMORIES_SQL, QUALITY_SQL, TS, now, query, quoted
from palimpsest.sources.tables import memories, table, tool_calls

DAY_BEFORE = "TIMESTAMP_NTZ '2024-02-01 00:00:00' - INTERVAL '24' HOUR"


@query(f"""WITH {MEMORIES_SQL} SELECT id, project_id, type, round(importance, 6) AS importance, round(confidence, 6) AS confidence, created_at, tier, agent_id FROM memories""")
def enriched_records(spark, sf_dir):
    m = memories(spark, sf_dir, "confidence", "type", "importance")
    return m.select("id", "project_id", "type", F.round("importance", 6).alias("importance"), F.round("confidence", 6).alias("confidence"), "created_at", "tier", "agent_id")


@query(f"""WITH {MEMORIES_SQL} SELECT project_id, count(*) FILTER (deleted_at IS NULL) AS n_active, count(*) FILTER (deleted_at IS NOT NULL) AS n_deleted,
  count(*) FILTER (deleted_at IS NULL AND created_at > {TS} - INTERVAL 24 HOUR) AS n_day, count(*) FILTER (created_at > {TS} - INTERVAL 7 DAY) AS n_new FROM memories GROUP BY 1""")
def status_counts(spark, sf_dir):
    """Records in use, deleted, of the last 24 hours and of the last week, by project."""
    return memories(spark, sf_dir).groupBy("project_id").agg(
        F.count_if(active()).alias("n_active"), F.count_if(~active()).alias("n_deleted"), F.count_if(active() & F.expr(f"created_at > {DAY_BEFORE}")).alias("n_day"),
        F.count_if(F.expr("created_at > TIMESTAMP_NTZ '2024-02-01 00:00:00' - INTERVAL '7' DAY")).alias("n_new"),
    )


@query(f"""WITH {MEMORIES_SQL} SELECT type, count(*) AS n, format('{{:.3f}}', coalesce(avg(importance), 0)) AS importance, format('{{:.3f}}',
  coalesce(avg(confidence), 0.5)) AS confidence
  FROM memories WHERE deleted_at IS NULL GROUP BY 1""")
def count_by_type(spark, sf_dir):
    rows = memories(spark, sf_dir, "confidence", "type", "importance").where(active()).groupBy("type")
    text = lambda name, empty: F.format_string("%.3f", F.coalesce(F.avg(name), F.lit(empty))).alias(name)
    return rows.agg(F.count("*").alias("n"), text("importance", 0.0), text("confidence", 0.5))


@query(f"WITH {MEMORIES_SQL} SELECT project_id, count(*) AS n, count(*) FILTER (deleted_at IS NULL) AS n_active FROM memories GROUP BY ROLLUP (project_id)")
def count_by_project(spark, sf_dir):
    """Records and active records by project, and a row with their totals (project null)."""
    return memories(spark, sf_dir).rollup("project_id").agg(F.count("*").alias("n"), F.count_if(active()).alias("n_active"))


@query(f"WITH {MEMORIES_SQL} SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM memories WHERE deleted_at IS NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 30")
def daily_histogram(spark, sf_dir):
    days = memories(spark, sf_dir).where(active()).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"))
    return days.agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30)


@query("""SELECT event_type AS tool_name, count(*) AS n, count(*) FILTER (event_type <> 'error') AS n_ok, round(avg(value), 6) AS avg_ms, max(value) AS max_ms,
  min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1""")
def tool_stats(spark, sf_dir):
    return tool_calls(spark, sf_dir).groupBy("tool_name").agg(
        F.count("*").alias("n"), F.count_if("success").alias("n_ok"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.max("duration_ms").alias("max_ms"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


@query("""SELECT 'src' || (user_id % 20)::VARCHAR AS project_id, event_id AS id, ts AS timestamp FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts DESC, event_id DESC) <= 20""")
def recent_tool_calls(spark, sf_dir):
    order = W.partitionBy("project_id").orderBy(F.desc("timestamp"), F.desc("id"))
    return tool_calls(spark, sf_dir).withColumn("r", F.row_number().over(order)).where("r <= 20").select("project_id", "id", "timestamp")


@query(f"""WITH {MEMORIES_SQL} SELECT id, substr(content, 1, 500) AS content, length(content) > 500 AS truncated FROM memories
  WHERE deleted_at IS NULL AND project_id IN ('src1', 'global') ORDER BY created_at DESC, id LIMIT 50""")
def list_recent(spark, sf_dir):
    rows = memories(spark, sf_dir).where(active() & in_project("src1")).orderBy(F.desc("created_at"), "id").limit(50)
    return rows.select("id", F.substring("content", 1, 500).alias("content"), (F.char_length("content") > 500).alias("truncated"))


@query(f"""WITH {MEMORIES_SQL} SELECT id FROM memories WHERE deleted_at IS NULL AND (agent_id IS NULL OR agent_id IN ('agent-a', 'system')) AND coalesce(confidence, 0.5) >= 0.5
  AND (valid_from IS NULL OR valid_from <= TIMESTAMP '2024-01-15') AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15')""")
def valid_as_of(spark, sf_dir):
    at = F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return memories(spark, sf_dir, "confidence").where(active() & visible_to("agent-a") & confident(0.5) & valid_at(at)).select("id")


@query(f"WITH {MEMORIES_SQL} SELECT id, round({CONFIDENCE_SQL}, 6) AS effective FROM memories")
def effective_confidence(spark, sf_dir):
    rows = memories(spark, sf_dir, "confidence", "contradiction_count", "type", "importance")
    return rows.select("id", F.round(scoring.effective_confidence(now()), 6).alias("effective"))


@query(f"WITH {MEMORIES_SQL} SELECT id, round({QUALITY_SQL}, 6) AS quality FROM memories")
def quality_score(spark, sf_dir):
    return memories(spark, sf_dir, "confidence", "contradiction_count").select("id", F.round(scoring.quality(now()), 6).alias("quality"))


@query(f"""WITH {MEMORIES_SQL}, r AS (SELECT *, {ACT_R_SQL} AS r FROM memories WHERE deleted_at IS NULL AND importance < 0.9),
  s AS (SELECT id, round(greatest(strength * (r + (1 - r) * coalesce(processing_depth, 0) * 0.3), 0.1), 6) AS new, strength AS was FROM r)
  SELECT id, new AS strength FROM s WHERE abs(was - new) > 0.001""")
def act_r_decay(spark, sf_dir):
    return analysis.decay(memories(spark, sf_dir, "type", "importance"), now())


@query(f"""WITH {MEMORIES_SQL} SELECT id, round(least(coalesce(confidence, 0.5) + 0.05, 0.95), 6) AS confidence FROM memories
  WHERE access_count > 3 AND coalesce(confidence, 0.5) < 0.95""")
def strengthen(spark, sf_dir):
    return analysis.strengthen(memories(spark, sf_dir, "confidence"))


@query(f"WITH {MEMORIES_SQL}, firsts AS (SELECT id, min(id) OVER (PARTITION BY project_id, sha256(content)) AS first FROM memories) SELECT * FROM firsts")
def exact_dedup(spark, sf_dir):
    return enrichment.exact_copies(memories(spark, sf_dir))


@query(f"""WITH {MEMORIES_SQL}, words AS (SELECT id, project_id, created_at, list_distinct(list_filter(string_split_regex(lower(content), '\\s+'),
  lambda w: w <> '')) AS w FROM memories),
recent AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id DESC) AS r FROM words QUALIFY r <= 20),
pairs AS (SELECT a.id, b.id AS other, b.r, len(list_intersect(a.w, b.w)) AS n, len(a.w) + len(b.w) AS m FROM words a JOIN recent b ON a.project_id = b.project_id AND a.id <> b.id)
SELECT id, other, round(n / (m - n)::DOUBLE, 6) AS jaccard FROM pairs WHERE n / (m - n)::DOUBLE > 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY r) = 1""")
def near_dedup(spark, sf_dir):
    return enrichment.recent_similar(memories(spark, sf_dir))


@query(f"""WITH {MEMORIES_SQL}, w AS (SELECT id, regexp_replace(unnest(string_split_regex(lower(content), '\\s+')), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS tag FROM memories)
SELECT id, tag, count(*) AS n, row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, tag) AS r FROM w WHERE strlen(tag) >= 3
  AND tag NOT IN ({quoted(enrichment.STOP_WORDS)}) GROUP BY id, tag QUALIFY r <= 5""")
def tags(spark, sf_dir):
    return enrichment.tags(memories(spark, sf_dir))


@query("""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t FROM
  (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN '{"a": 1, "b": "' || substr(text, 1, 60) || '"}' || chr(10) ELSE text END AS text FROM conversations))
SELECT conv_id, turn, strlen(t) < 50 OR (strlen(t) < 500 AND starts_with(t, '{') AND ends_with(t, '}')) OR (strlen(t) < 200 AND ("""
       + " OR ".join(f"starts_with(t, '{p.replace(chr(39), chr(39) * 2)}')" for p in enrichment.NOISE_OPENINGS) + ")) AS noise FROM t")
def noise_filter(spark, sf_dir):
    """Turns that say nothing; every fourth is made a JSON text with a line end after it."""
    text = F.expr("CASE WHEN turn % 4 = 1 THEN '{\"a\": 1, \"b\": \"' || substr(text, 1, 60) || '\"}\\n' ELSE text END")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", enrichment.noise(F.coalesce(text, F.lit(""))).alias("noise"))


@query("""WITH s AS (SELECT event_type AS concept, week(ts) AS cycle, list(DISTINCT user_id) AS members FROM events GROUP BY 1, 2),
b AS (SELECT *, lag(members) OVER (PARTITION BY concept ORDER BY cycle) AS before FROM s),
c AS (SELECT concept, cycle, round(CASE WHEN before IS NULL THEN 0 ELSE 1 - len(list_intersect(members, before)) / len(list_distinct(list_concat(members,
  before)))::DOUBLE END, 6) AS churn FROM b)
SELECT concept, cycle, churn, round(sum(churn) OVER (PARTITION BY concept ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS drift5 FROM c""")
def concept_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("concept"), F.weekofyear("ts").cast("long").alias("cycle"), F.col("user_id").alias("member"))
    return analysis.drift(rows)


@query("""WITH i AS (SELECT user_id, event_id, ts, event_type = 'error' AS e, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT user_id, event_id, (sum(e::INTEGER) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS empty_run FROM i""")
def empty_search_runs(spark, sf_dir):
    return analysis.empty_runs(table(spark, sf_dir, "events").withColumn("empty", F.col("event_type") == "error"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s
  GROUP BY user_id, k HAVING count(*) >= 3""")
def event_bursts(spark, sf_dir):
    return analysis.bursts(table(spark, sf_dir, "events"), "6 hours")


@query("SELECT user_id, arg_max(event_id, struct_pack(ts, event_id)) AS event_id FROM events GROUP BY 1")
def latest_per_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"""WITH {MEMORIES_SQL} SELECT id, CASE WHEN access_count >= 10 THEN 'core' WHEN tier = 'ephemeral' AND access_count >= 5 THEN 'established'
  WHEN tier = 'ephemeral' AND access_count >= 2 THEN 'relevant' ELSE tier END AS tier FROM memories WHERE deleted_at IS NULL""")
def tier_backfill(spark, sf_dir):
    return memories(spark, sf_dir).where(active()).select("id", ingest.tier_by_use(F.col("access_count"), F.col("tier")).alias("tier"))


@query(f"WITH {MEMORIES_SQL} SELECT id, coalesce(valid_from, created_at) AS valid_from FROM memories")
def valid_from_backfill(spark, sf_dir):
    return memories(spark, sf_dir).select("id", F.coalesce("valid_from", "created_at").alias("valid_from"))


@query("""SELECT conv_id, turn, 0::BIGINT AS part, CASE WHEN strlen(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS content FROM conversations
  WHERE strlen(text) >= 50
UNION ALL SELECT conv_id, turn, 1, CASE WHEN strlen(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END FROM conversations WHERE strlen(text) >= 50 AND turn % 3 = 1""")
def transcript_extract(spark, sf_dir):
    """Conversations as transcript lines: message with text, message with two equal blocks, or content at the top."""
    return ingest.transcript_texts(transcript_lines(spark, sf_dir)).select("line_id.*", "part", "content")


def transcript_lines(spark, sf_dir):
    """Turns as JSON lines (line_id, line) of three shapes by turn."""
    c = table(spark, sf_dir, "conversations")
    block = "named_struct('type', 'text', 'text', text)"
    blocks = F.expr(f"to_json(named_struct('message', named_struct('role', role, 'content', array({block}, {block}))))")
    line = F.when(c.turn % 3 == 0, F.expr("to_json(named_struct('message', named_struct('role', role, 'content', text)))")).when(c.turn % 3 == 1, blocks)
    return c.select(F.struct("conv_id", "turn").alias("line_id"), line.otherwise(F.expr("to_json(named_struct('content', text))")).alias("line"))
