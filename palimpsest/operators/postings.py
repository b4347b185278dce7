"""An inverted index that is kept and maintained: tables of versions in the shared folder, read by full-text search.

docs: (id, project_id, len, alive), terms: (term, id, tf) in buckets of terms, stats: (docs, words), each a folder for a version.
A write adds a version and changes none: a record's newest version counts, a deleted record has a tombstone. The
statistics of a version are what it adds to those before, so totals are sums over versions, not over records. A version
that is written again (a repeated micro-batch, a lost driver) replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.predicates import active
from palimpsest.operators.retrieval import asked_terms, counted, ranked_postings, terms
from palimpsest.sources.staging import delete, staged

BUCKETS = 32
DOCS, TERMS, STATS = "id string, project_id string, len long, alive boolean, version long", "term string, id string, tf long, version long, bucket int", "docs long, words long, version long"


def _bucket(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Postings:
    """The index in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        for name, schema in (("docs", DOCS), ("terms", TERMS), ("stats", STATS)):  # so that an empty index can be read
            self._add(name, spark.createDataFrame([], schema).drop("version"), -1)

    def _read(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if before is None else rows.where(F.col("version") < before)

    def _add(self, name: str, rows: DataFrame, version: int) -> None:
        """Rows as the version of a table, in place of what an earlier try has written."""
        to = f"{self.path}/{name}/version={version}"
        (rows.write.mode("overwrite").partitionBy("bucket") if "bucket" in rows.columns else rows.write.mode("overwrite")).parquet(to)

    def current(self, before: int | None = None) -> DataFrame:
        """(id, project_id, len, version) of the records that are there (or were before a version), each in its newest version."""
        newest = self._read("docs", DOCS, before).groupBy("id").agg(F.max_by(F.struct("project_id", "len", "alive", "version"), "version").alias("d"))
        return newest.where("d.alive").select("id", "d.project_id", "d.len", "d.version")

    def write(self, records: DataFrame, version: int) -> None:
        """Records (id, project_id, content, deleted_at) as new or changed ones; those with deleted_at go. Of rows that repeat an id one counts."""
        once = records.dropDuplicates(["id"])
        docs = once.select(F.col("id").cast("string").alias("id"), "project_id", terms(F.col("content")).alias("words"), active().alias("alive"))
        docs = staged(docs.withColumn("len", F.when(F.col("alive"), F.size("words")).otherwise(0).cast("long")), "index_docs")
        before = self.current(version).join(docs.select("id"), "id", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("w"))
        now = docs.where("alive").agg(F.count("*").alias("n_now"), F.coalesce(F.sum("len"), F.lit(0)).alias("w_now"))
        change = now.crossJoin(F.broadcast(before))  # one row each
        self._add("stats", change.select((F.col("n_now") - F.col("n")).alias("docs"), (F.col("w_now") - F.col("w")).alias("words")), version)
        found = docs.where("alive").select("id", F.explode(counted(F.col("words"))).alias("f")).select("f.term", "id", "f.tf")  # ids are there once
        self._add("terms", found.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket"), version)
        self._add("docs", docs.select("id", "project_id", "len", "alive"), version)  # last: only now the version counts
        delete(self.spark, docs.staged_path)

    def remove(self, ids: DataFrame, version: int) -> None:
        """Tombstones for the records whose id is in ids."""
        gone = ids.select("id", F.lit(None).cast("string").alias("project_id"), F.lit("").alias("content"), F.lit(True).alias("deleted_at"))
        self.write(gone, version)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A streaming query that writes each micro-batch of changed records as a version; versions are one more than the batch's number."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.write(rows, batch + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def postings(self, words: DataFrame) -> DataFrame:
        """(term, id, project_id, len, tf) of the terms in `words`; only their buckets are read."""
        buckets = [r.b for r in words.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
        some = self._read("terms", TERMS).where(F.col("bucket").isin(buckets)).join(words.select("term").distinct(), "term", "left_semi")
        return some.join(self.current(), ["id", "version"]).select("term", "id", "project_id", "len", "tf")

    def search(self, queries: DataFrame, k: int, monotone: bool = True, any_term: bool = False, sparse: str | None = None) -> DataFrame:
        """(query_id, id, score) as `retrieval.bm25` gives it for the records that are there; no text is read."""
        asked = asked_terms(queries, sparse)
        total = self._read("stats", STATS).agg(F.sum("docs").alias("n"), F.try_divide(F.sum("words"), F.sum("docs")).alias("avg_len"))
        return ranked_postings(staged(self.postings(asked), "found"), staged(total, "total"), asked, k, monotone, any_term)

    def compacted(self, path: str) -> Postings:
        """The index in a new folder, as one version without what is replaced or deleted."""
        new, now = Postings(self.spark, path), staged(self.current(), "index_docs")
        new._add("stats", now.agg(F.count("*").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("words")), 0)
        new._add("terms", self._read("terms", TERMS).join(now.select("id", "version"), ["id", "version"], "left_semi").select("term", "id", "tf", "bucket").repartition("bucket"), 0)
        new._add("docs", now.select("id", "project_id", "len", F.lit(True).alias("alive")), 0)
        delete(self.spark, now.staged_path)
        return new

