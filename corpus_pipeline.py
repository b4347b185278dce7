"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, minhash_dedup, pii, sentencepiece_bpe, toxicity
from palimpsest.llm.common import staged, table
from palimpsest.llm.queries import model_path

#: Rows that go to Python at once: texts are long, and Spark holds a batch of them several times in each task.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

#: No SQL: a trained model decides in the first stage. tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def in_small_batches(spark: SparkSession) -> None:
    """From now on at most BATCH_ROWS rows of the session's plans go to Python at once; no result depends on it."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject (predicted 0).

    Null and empty texts count as empty ones; repeated rows are judged alike. Without labels nothing is rejected.
    """
    in_small_batches(spark)
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.tag(docs, model).where("predicted = 0").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Null and empty texts are like no other. Rows that repeat key and text stay once; rows without a key all stay.
    """
    in_small_batches(spark)
    return minhash_dedup.dedup(docs, words=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows that share a key go together."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars is that of the new text, null for a null one."""
    in_small_batches(spark)
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, their number and digest, and the digest of the decoded text; a null text counts as empty."""
    in_small_batches(spark)
    return sentencepiece_bpe.digest(docs, model_path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("toxicity", without_toxic),
    ("minhash_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("sentencepiece", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs, given = table(spark, sf_dir, "documents"), spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    finally:
        spark.conf.set(BATCH, given)
    return docs
