"""One object for a store's tables: search, list, recall, suggest, answer, store, update, delete, entities, code, status, ingest, reset, export.

Reading gives DataFrames; writing gives a new Engine with the tables that replace the old ones. Questions are tables
too (query_id, text, project), so that thousands are asked at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.models import Scorer, hashed_embedder, lexical_scorer
from palimpsest.operators import analysis, clusters, entities, ingest, predicates, retrieval, store, understanding
from palimpsest.operators.enrichment import tags
from palimpsest.sources import schemas


class Engine:
    """A store's tables by name, the time that counts as now (a Column), and its models."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, now=None, embedder=None, scorer: Scorer = lexical_scorer):
        self.spark, self.scorer = spark, scorer
        self.now = F.localtimestamp() if now is None else now
        self.tables = {**schemas.empty_store(spark, self.now), **(tables or {})}
        self.embedder = embedder or hashed_embedder()

    def with_tables(self, **tables: DataFrame) -> Engine:
        """The same engine with some tables replaced."""
        return Engine(self.spark, {**self.tables, **tables}, self.now, self.embedder, self.scorer)

    @property
    def memories(self) -> DataFrame:
        return self.tables["memories"]

    def asked(self, questions: DataFrame) -> DataFrame:
        """Questions with all that a search needs: intent, clean text, date, vector."""
        rows = questions if "project" in questions.columns else questions.withColumn("project", F.lit("global"))
        made = understanding.prepared(rows, self.now, as_of="as_of" if "as_of" in rows.columns else None)
        made = made.withColumn("as_of", F.coalesce(F.expr("try_cast(as_of AS timestamp_ntz)"), self.now)).withColumn("text", F.col("effective"))
        bounds = [F.expr(f"try_cast({c} AS timestamp_ntz)").alias(c) for c in ("after", "before")]
        return made.select("query_id", "text", "project", "as_of", *bounds, "intent", "keywords", self.embedder(F.col("effective")).alias("vector"))

    def search(self, questions: DataFrame, k: int = 10, rerank: bool = False) -> DataFrame:
        """(query_id, id, score): six paths, fused and scored; with rerank, three times as many are judged by the scorer and the k most diverse are taken."""
        queries, records = self.asked(questions), self.memories
        edges = self.tables["co_retrieval_edges"].select("memory_a", "memory_b", "weight")
        shared = analysis.shared_targets(self.tables["edges"].where("valid_to IS NULL").select("from_id", "to_id"))
        nodes = (
            self.tables["concept_nodes"].where("cluster_size > 0")
            .selectExpr("id AS concept", "cast(centroid as array<double>) AS centroid", "cluster_size AS size", "concat_ws(' ', name, description) AS label")
        )
        members = self.tables["concept_memberships"].selectExpr("concept_id AS concept", "memory_id AS id", "probability")
        fused = retrieval.hybrid(records, queries, edges, shared, nodes, members, self.now, k, 2 * max(k, 10))
        found = retrieval.ranked(fused, records, queries, edges, self.now, 3 * k if rerank else k)
        if not rerank:
            return found
        rows = found.join(records.select("id", "content", "embedding"), "id").join(queries.select("query_id", "text"), "query_id")
        judged = retrieval.reranked(rows, self.scorer).join(records.select("id", "content", "embedding"), "id")
        chosen = retrieval.diverse(judged, k)
        return chosen.join(judged.select("query_id", "id", "score"), ["query_id", "id"]).select("query_id", "id", "score", "place")

    def fallback(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, id, score) by words alone: all of them, else the text as it is."""
        rows = questions if "project" in questions.columns else questions.withColumn("project", F.lit("global"))
        return retrieval.fallback(self.memories, rows, k)

    def suggest(self, contexts: DataFrame, k: int = 5) -> DataFrame:
        """What fits a context: a search on its most frequent words."""
        words = (
            tags(contexts.selectExpr("query_id", "text AS content"), 5, "query_id").groupBy("query_id")
            .agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("text"))
        )
        rest = contexts.drop("text")
        return self.search(rest.join(words, "query_id"), k)

    def answer(self, questions: DataFrame) -> DataFrame:
        """(query_id, answer, confidence, sources) of the best five results."""
        return retrieval.answers(self.search(questions, 5), self.memories)

    def list(self, project: str | None = None, k: int = 50, offset: int = 0, part: str | None = None) -> DataFrame:
        """The newest active records, those that hold a text if given, page by page, without vectors."""
        rows = self.memories.where(predicates.active()).drop("embedding")
        rows = rows if project is None else rows.where(predicates.in_project(project))
        rows = rows if part is None else rows.where(F.contains(F.lower("content"), F.lit(part.lower())))
        return rows.orderBy(F.desc("created_at"), "id").offset(offset).limit(k)

    def recall(self, ids: DataFrame) -> tuple[DataFrame, Engine]:
        """The records of the ids, and the engine in which they have been read once more."""
        rows = store.recalled(self.memories, ids, self.now)
        return rows, self.with_tables(memories=store.patched(self.memories, rows.select("id", "access_count", "last_accessed")))

    def store(self, new: DataFrame) -> Engine:
        """The engine with new records (id, project_id, content) that it doesn't have yet, enriched and with vectors."""
        made = store.stored(new, self.memories, self.now).withColumn("embedding", self.embedder(F.col("content"))).withColumn("valid_from", F.col("created_at"))
        words = tags(made, 5).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda s: s["tag"]).alias("tags"))
        return self.with_tables(memories=self.memories.unionByName(schemas.upgraded(made.join(words, "id", "left"), "memories")))

    def update(self, patch: DataFrame) -> Engine:
        """The engine with the non-null columns of patch (id, ...) in the records."""
        return self.with_tables(memories=store.patched(self.memories, patch))

    def vote(self, votes: DataFrame) -> Engine:
        """The engine after confirmations and contradictions (id, confirm)."""
        judged = store.judged(self.memories, votes).select("id", "confidence")
        return self.with_tables(memories=store.patched(self.memories, judged))

    def delete(self, ids: DataFrame) -> Engine:
        """The engine in which the records are marked as deleted."""
        return self.with_tables(memories=store.soft_deleted(self.memories, ids, self.now))

    def reset(self, project: str) -> Engine:
        """The engine without a project's records."""
        return self.with_tables(memories=store.hard_deleted(self.memories, F.col("project_id") == project))

    def export(self, path: str, lines: bool = True) -> None:
        store.write_export(self.memories, path, lines)

    def learn(self, found: DataFrame) -> Engine:
        """The engine after a search: links between results that were found together grow, and so do hit counters."""
        new = (
            retrieval.co_retrieved(found)
            .selectExpr("concat(memory_a, '-', memory_b) AS id", "'global' AS project_id", "memory_a", "memory_b", "n AS co_retrieval_count", "weight")
        )
        old = self.tables["co_retrieval_edges"]
        both = old.unionByName(new.withColumn("last_co_retrieved", self.now).withColumn("created_at", self.now))
        edges = both.groupBy("project_id", "memory_a", "memory_b").agg(
            F.min("id").alias("id"), F.sum("co_retrieval_count").alias("co_retrieval_count"), F.least(F.sum("weight"), F.lit(1.0)).alias("weight"),
            F.max("last_co_retrieved").alias("last_co_retrieved"), F.min("created_at").alias("created_at"),
        )
        hits = retrieval.search_hits(found, self.memories)
        return self.with_tables(co_retrieval_edges=edges.select(*old.columns), memories=store.patched(self.memories, hits))

    def cluster(self, least: float = clusters.LINK, members: int = clusters.LEAST_MEMBERS) -> Engine:
        """The engine with concepts made of all vectors."""
        rows = self.memories.where(predicates.active()).select("id", "embedding")
        made = clusters.clusters(rows, least, members)
        nodes = analysis.centroids(made.join(rows, "id").withColumnRenamed("cluster", "concept"))
        nodes = nodes.selectExpr("concept AS id", "'global' AS project_id", "cast(centroid as array<float>) AS centroid", "size AS cluster_size").withColumn("created_at", self.now)
        links = made.selectExpr("cluster AS concept_id", "id AS memory_id", "1.0D AS probability").withColumn("joined_at", self.now)
        return self.with_tables(concept_nodes=schemas.upgraded(nodes, "concept_nodes"), concept_memberships=links)

    def status(self) -> DataFrame:
        """Active, deleted and all records by project, with the totals (project null)."""
        return (
            self.memories.rollup("project_id")
            .agg(F.count_if(predicates.active()).alias("n_active"), F.count_if(~predicates.active()).alias("n_deleted"), F.count("*").alias("n"))
        )

    def briefing(self, tokens: int = 500) -> DataFrame:
        return entities.briefing(self.memories, tokens)

    def ingest(self, texts: DataFrame) -> Engine:
        """The engine with the transcript texts (id, project_id, content, created_at) that say something new."""
        known = self.memories.select(F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
        made = ingest.ingested(texts, known).withColumn("embedding", self.embedder(F.col("content")))
        return self.with_tables(memories=self.memories.unionByName(schemas.upgraded(made, "memories")))
