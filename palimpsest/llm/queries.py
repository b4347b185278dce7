"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re
import uuid

from palimpsest.llm import decontamination, fingerprints, hard_negatives, html_text, minhash_dedup, oracles, pii, sentencepiece_bpe, sharding, substring_dedup, token_files, toxicity
from palimpsest.llm import vector_codes, vector_dedup
from palimpsest.llm.common import own_dir, table


def model_path(name: str) -> str:
    """Where a public tokenizer's file is; the package is installed on every executor."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.digest(docs, model_path("piece_bpe_32k.model"), keep=["doc_id"])


def op2_sharding(spark, sf_dir):
    return sharding.stratified_shards(table(spark, sf_dir, "documents"), 16)


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(table(spark, sf_dir, "documents"), 20, with_text=False)


def op4_vector_dedup(spark, sf_dir):
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op5_html_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op6_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_token_files(spark, sf_dir):
    path = f"{own_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), path, model_path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_digest(spark, path)


def op9_pii(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    made = toxicity.tag(docs, model, keep=["doc_id"])
    return made.withColumn("held_out", toxicity.held_out("doc_id")).select("doc_id", "held_out", "score", "predicted", "n_toxic_tokens", "toxic_spans")


def op11_hard_negatives(spark, sf_dir):
    return hard_negatives.negatives(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {name: f for name, f in dict(globals()).items() if re.match(r"op\d+_", name)}
SQL = {"op2_sharding": sharding.SHARDING_SQL, "op3_substring_dedup": oracles.SUBSTRING_SQL, "op4_vector_dedup": oracles.VECTOR_SQL, "op7_minhash_dedup": oracles.NEAR_SQL}
SQL |= {"op11_hard_negatives": hard_negatives.NEGATIVES_SQL, "op12_vector_codes": vector_codes.CODES_SQL}
