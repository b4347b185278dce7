"""The register of queries and the SQL pieces that several of them share."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import enrichment, scoring
from palimpsest.sources.tables import MARKERS

QUERIES, SQL = {}, {}
TS = "TIMESTAMP '2024-02-01 00:00:00'"


def now():
    return F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def has(phrases, text: str = "lower(content)") -> str:
    return "(" + " OR ".join(f"contains({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def cases(column: str, values: dict, otherwise=None) -> str:
    """CASE column WHEN key THEN value ... in SQL."""
    end = "" if otherwise is None else f" ELSE {otherwise}::DOUBLE"
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + end + " END"


def days_sql(at: str) -> str:
    return f"((epoch_us({TS}) - epoch_us({at})) / 86400e6)"


KIND_SQL = "CASE " + " ".join(f"WHEN {has(p)} THEN '{t}'" for t, p in enrichment.TYPE_PHRASES.items()) + " ELSE 'note' END"
IMPORTANCE_SQL = (
    "greatest(0.1::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + " + cases("type", enrichment.TYPE_BOOST, 0)
    + "".join(f" + CASE WHEN {has(w)} THEN {v}::DOUBLE ELSE 0 END" for w, v in enrichment.WORD_BOOST)
    + " + CASE WHEN strlen(content) < 20 THEN -0.1::DOUBLE WHEN strlen(content) > 200 THEN 0.05::DOUBLE ELSE 0 END))"
)
MEMORIES_SQL = f"""
raw AS (
  SELECT d.doc_id, 'm' || lpad(d.doc_id::VARCHAR, 8, '0') AS id, CASE WHEN source = 'src0' THEN 'global' ELSE source END AS project_id,
    CASE d.doc_id % 12 {" ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(MARKERS))} ELSE '' END || coalesce(d.text, '') AS content,
    CASE WHEN d.doc_id % 7 <> 0 THEN 0.3::DOUBLE + 0.6::DOUBLE * coalesce(l.quality::DOUBLE, 0.5) END AS confidence,
    TIMESTAMP '2023-11-01 00:00:00' + to_days((d.doc_id % 90)::INTEGER) + to_seconds(d.doc_id) AS created_at,
    l.toxic, e.embedding, e.label AS concept
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), typed AS (SELECT *, {KIND_SQL} AS type FROM raw
), memories AS (
  SELECT *, created_at + to_days((doc_id % 5)::INTEGER) AS last_accessed, CASE WHEN doc_id % 11 <> 0 THEN created_at END AS valid_from,
    CASE WHEN doc_id % 6 = 0 THEN created_at + INTERVAL 20 DAY END AS valid_to, CASE WHEN doc_id % 17 = 0 THEN {TS} END AS deleted_at,
    CASE WHEN doc_id % 13 = 0 THEN 'm' || lpad((doc_id + 1)::VARCHAR, 8, '0') END AS superseded_by,
    CASE doc_id % 3 WHEN 1 THEN 'system' WHEN 2 THEN 'agent-a' END AS agent_id, ['ephemeral', 'relevant', 'established', 'core'][doc_id % 4 + 1] AS tier,
    doc_id % 12 AS access_count, doc_id % 9 AS search_hit_count, coalesce(toxic, 0) * (doc_id % 5) AS contradiction_count, 1 + doc_id % 3 AS source_count,
    1.0::DOUBLE AS strength, CASE WHEN doc_id % 10 <> 0 THEN (doc_id % 5) / 5.0::DOUBLE END AS processing_depth, {IMPORTANCE_SQL} AS importance
  FROM typed
)"""
ASKED_SQL = """
asked AS (SELECT * FROM (SELECT doc_id AS query_id, array_to_string(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: length(w) > 1)[3:4], ' ') AS text,
  CASE WHEN source = 'src0' THEN 'global' ELSE source END AS project, TIMESTAMP '2024-01-15 00:00:00' AS as_of FROM documents WHERE doc_id % 20 = 0) WHERE text <> '')"""
EDGES_SQL = """
folded AS (SELECT *, event_id % (SELECT count(*) FROM documents) AS x FROM events),
steps AS (SELECT x, lag(x) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS y FROM folded),
edges AS (SELECT least(x, y) AS memory_a, greatest(x, y) AS memory_b, count(*) AS n, least(0.1::DOUBLE * count(*), 1.0) AS weight FROM steps
  WHERE y IS NOT NULL AND x <> y GROUP BY 1, 2),
ways AS (SELECT memory_a AS src, memory_b AS dst, weight FROM edges UNION ALL SELECT memory_b, memory_a, weight FROM edges),
strong AS (SELECT * FROM ways WHERE weight >= 0.05 QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 10)"""
QUALITY_SQL = f"""greatest(0, least(1, CASE WHEN access_count > 0 THEN least(log10(access_count + 1.0::DOUBLE) / 2, 1) * 0.25 ELSE 0 END
  + CASE WHEN search_hit_count > 0 THEN least(log10(search_hit_count + 1.0::DOUBLE) / 2, 1) * 0.2 ELSE 0 END
  - CASE WHEN {days_sql("last_accessed")} > 30 AND access_count <= 1 THEN least(log10({days_sql("last_accessed")} / 30 + 1), 1) * 0.15 ELSE 0 END
  + CASE tier WHEN 'core' THEN 0.15 WHEN 'established' THEN 0.1 WHEN 'relevant' THEN 0.05 ELSE 0 END
  + coalesce(confidence, 0.5) * 0.15 - least(least(contradiction_count, 10) * 0.05, 1) * 0.05))"""
CONFIDENCE_SQL = f"""greatest(CASE WHEN importance >= 0.8 THEN 0.4 WHEN importance >= 0.5 THEN 0.2 ELSE 0.1 END,
  least(1.0, coalesce(confidence, 0.5) - greatest({days_sql("last_accessed")}, 0) * 0.001
  + CASE WHEN source_count > 1 THEN (source_count - 1) * 0.15 ELSE 0 END - least(contradiction_count, 3) * 0.05 + CASE WHEN importance > 0.7 THEN 0.1 ELSE 0 END
  - CASE WHEN superseded_by IS NOT NULL THEN 0.15 ELSE 0 END - CASE WHEN valid_to < {TS} THEN 0.25 ELSE 0 END))"""
ACT_R_SQL = f"pow(1 + {cases('tier', {t: p[0] for t, p in scoring.TIERS.items()})} * greatest({days_sql('last_accessed')}, 0), -{cases('tier', {t: p[1] for t, p in scoring.TIERS.items()})})"
