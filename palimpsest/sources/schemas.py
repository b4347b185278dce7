"""The tables of a store as explicit schemas, with their keys and defaults, and an empty or seeded store of them.

id and project_id come first and created_at last in every table that has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The columns of each table.
TABLES = {
    "memories": "id string, project_id string, content string, type string, tags array<string>, importance double, strength double, access_count long, last_accessed timestamp_ntz, "
    "deleted_at timestamp_ntz, confidence double, source_count long, contradiction_count long, confirmation_count long, embedding array<float>, embedding_model string, updated_at timestamp_ntz, "
    "sentiment string, emotion_intensity double, emotion_labels array<string>, user_mood string, valid_from timestamp_ntz, valid_to timestamp_ntz, superseded_by string, tier string, "
    "reconsolidation_count long, last_reconsolidated timestamp_ntz, emotional_salience double, processing_depth double, maturity_score double, maturity_updated_at timestamp_ntz, "
    "tier_changed_at timestamp_ntz, demotion_count long, content_original string, compressed_at timestamp_ntz, search_hit_count long, sparse_tokens array<string>, agent_id string, "
    "content_hash string, created_at timestamp_ntz",
    "postings": "term string, id string, project_id string, len long, tf long",
    "edges": "id string, project_id string, from_id string, to_id string, relation_type string, valid_from timestamp_ntz, valid_to timestamp_ntz, confidence double, metadata string, created_at timestamp_ntz",
    "co_retrieval_edges": "id string, project_id string, memory_a string, memory_b string, co_retrieval_count long, weight double, last_co_retrieved timestamp_ntz, created_at timestamp_ntz",
    "scratchpad": "key string, project_id string, value string, expires_at timestamp_ntz, created_at timestamp_ntz",
    "entities": "id string, project_id string, name string, entity_type string, observations array<string>, updated_at timestamp_ntz, created_at timestamp_ntz",
    "entity_observations": "id string, entity_id string, content string, created_at timestamp_ntz",
    "entity_relations": "id string, project_id string, from_entity string, to_entity string, relation_type string, created_at timestamp_ntz",
    "entity_types": "name string, parent_type string, description string, created_at timestamp_ntz",
    "concept_nodes": "id string, project_id string, name string, description string, centroid array<float>, member_ids array<string>, cluster_size long, cohesion double, hebbian_strength double, "
    "stability long, tension double, tension_last_restructured long, last_consolidated timestamp_ntz, created_at timestamp_ntz",
    "concept_memberships": "concept_id string, memory_id string, probability double, joined_at timestamp_ntz",
    "concept_snapshots": "id string, project_id string, concept_id string, cycle_number long, centroid array<float>, member_ids array<string>, cluster_size long, cohesion double, hebbian_strength double, "
    "stability long, name string, centroid_drift double, member_churn double, cohesion_delta double, event_type string, event_metadata string, created_at timestamp_ntz",
    "concept_drift_alerts": "id string, project_id string, concept_id string, alert_type string, severity double, cycle_number long, metric_value double, threshold double, description string, "
    "acknowledged boolean, created_at timestamp_ntz",
    "restructuring_events": "id string, project_id string, concept_id string, cycle_number long, tension_score double, action_type string, details string, created_at timestamp_ntz",
    "cortex_state": "key string, value string, updated_at timestamp_ntz",
    "tool_calls": "id string, project_id string, tool_name string, arguments string, output string, success boolean, error string, duration_ms long, timestamp timestamp_ntz",
    "sessions": "id string, project_id string, client_id string, started_at timestamp_ntz, ended_at timestamp_ntz, tool_call_count long, memory_store_count long, memory_search_count long, "
    "last_activity_at timestamp_ntz, crash_detected boolean, summary string, metadata string",
    "temporal_events": "id string, project_id string, memory_id string, event_type string, old_value string, new_value string, session_id string, created_at timestamp_ntz",
    "processing_events": "id string, project_id string, memory_id string, event_type string, depth_before double, depth_after double, context string, created_at timestamp_ntz",
    "tasks": "id string, project_id string, description string, total_steps long, current_step long, step_description string, status string, updated_at timestamp_ntz, created_at timestamp_ntz",
    "scheduled_tasks": "id string, project_id string, title string, description string, cron_expression string, next_run timestamp_ntz, last_run timestamp_ntz, status string, recurring boolean, "
    "memory_id string, action_type string, action_data string, updated_at timestamp_ntz, created_at timestamp_ntz",
    "contradiction_resolutions": "id string, project_id string, memory_id_1 string, memory_id_2 string, resolution_type string, chosen_memory string, resolution_note string, resolved_by string, "
    "resolved_at timestamp_ntz, created_at timestamp_ntz",
    "resolution_audit_log": "id string, project_id string, resolution_id string, action string, actor string, rationale string, previous_state string, new_state string, created_at timestamp_ntz",
    "source_credibility": "source_id string, project_id string, correct_count long, incorrect_count long, credibility_score double, last_updated timestamp_ntz",
    "memory_schemas": "id string, project_id string, schema_pattern string, examples array<string>, frequency long, updated_at timestamp_ntz, created_at timestamp_ntz",
    "ingestion_queue": "id string, project_id string, source string, content string, metadata string, priority long, status string, attempts long, max_attempts long, processed_at timestamp_ntz, "
    "error string, created_at timestamp_ntz",
    "behavior_queue": "id string, event_type string, payload string, status string, updated_at timestamp_ntz, created_at timestamp_ntz",
    "consolidation_profile_runs": "id string, project_id string, level string, phase_timings string, total_duration_ms long, memory_count long, edge_count long, concept_count long, created_at timestamp_ntz",
    "health_snapshots": "id string, project_id string, overall_score long, dimension_scores string, memory_count long, created_at timestamp_ntz",
    "code_entities": "id long, project_id string, file_path string, entity_type string, name string, qualified_name string, signature string, start_line long, end_line long, docstring string, "
    "complexity long, language string, hash string, embedding_id string, bridge_entity_id string, updated_at timestamp_ntz, created_at timestamp_ntz",
    "code_relations": "id long, project_id string, from_entity_id long, to_entity_id long, relation_type string, confidence double, metadata string, created_at timestamp_ntz",
    "code_snapshots": "id long, project_id string, file_path string, file_hash string, entity_count long, relation_count long, created_at timestamp_ntz",
    "code_architecture_insights": "id long, project_id string, pattern string, severity string, entities array<string>, description string, suggestion string, file_path string, updated_at timestamp_ntz, created_at timestamp_ntz",
}
# Keys of the tables whose key is not id.
KEYS = {
    "postings": ("term", "id"), "scratchpad": ("key", "project_id"), "entity_types": ("name",), "concept_memberships": ("concept_id", "memory_id"), "cortex_state": ("key",),
    "source_credibility": ("source_id", "project_id"),
}
# What a record has that doesn't say otherwise.
MEMORY_DEFAULTS = {
    "project_id": "global", "type": "note", "importance": 0.5, "strength": 1.0, "access_count": 0, "confidence": 0.5, "source_count": 1, "contradiction_count": 0, "confirmation_count": 0,
    "sentiment": "neutral", "emotion_intensity": 0.0, "tier": "ephemeral", "reconsolidation_count": 0, "emotional_salience": 0.0, "processing_depth": 0.0, "maturity_score": 0.0,
    "demotion_count": 0, "search_hit_count": 0, "agent_id": "system",
}
# The entity types that every store has.
ENTITY_TYPES = {
    "concept": "Abstract idea or notion", "person": "Human individual", "organization": "Company, team, or group", "project": "Work initiative or codebase",
    "technology": "Tool, framework, or language", "location": "Physical or virtual place", "event": "Occurrence in time", "document": "File, specification, or record",
    "agent": "Autonomous entity or AI",
}


def schema(name: str) -> StructType:
    """The schema of a table."""
    return StructType.fromDDL(TABLES[name])


def key_of(name: str) -> tuple[str, ...]:
    return KEYS.get(name, ("id",))


def seeds(spark: SparkSession, now) -> dict[str, DataFrame]:
    """Tables that a new store has rows of."""
    types = spark.createDataFrame([(n, None, d) for n, d in ENTITY_TYPES.items()], "name string, parent_type string, description string").withColumn("created_at", now)
    state = spark.createDataFrame([("cycle_number", "0")], "key string, value string").withColumn("updated_at", now)
    return {"entity_types": types, "cortex_state": state}


def empty_store(spark: SparkSession, now=None) -> dict[str, DataFrame]:
    """Every table, empty but for the seeds: a store in memory, for tests and as a start."""
    at = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") if now is None else now
    return {**{name: spark.createDataFrame([], schema(name)) for name in TABLES}, **seeds(spark, at)}


def upgraded(df: DataFrame, name: str) -> DataFrame:
    """An older table with the columns of today's: missing ones are null or have their default, others are left out."""
    columns = []
    for f in schema(name).fields:
        default = F.lit(MEMORY_DEFAULTS.get(f.name)) if name == "memories" else F.lit(None)
        columns.append((F.col(f"`{f.name}`") if f.name in df.columns else default).cast(f.dataType).alias(f.name))
    return df.select(*columns)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Write tables as Parquet; records by project, so that a project's scan reads its own files."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("project_id") if name == "memories" else writer).parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names=None) -> dict[str, DataFrame]:
    """Read tables with their schemas; nothing is inferred."""
    return {name: spark.read.schema(schema(name)).parquet(f"{folder}/{name}") for name in (names or TABLES)}
