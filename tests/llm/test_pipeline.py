"""Each stage of the pipeline on its own input, against brute force."""

import hashlib
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P  # noqa: E402
from palimpsest.llm import pii, sentencepiece_bpe, toxicity  # noqa: E402
from palimpsest.llm.queries import model_path  # noqa: E402
from test_exactness import brute_components, brute_found  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of each stage, in order."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    for name, stage in P.STAGES:
        rows, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
        made = stage(spark, docs, DATA)
        if name != P.STAGES[-1][0]:
            assert made.columns == columns
        docs = spark.createDataFrame(made.collect(), made.schema)
        out[name] = (rows, {r.doc_id: r for r in docs.collect()})
    return out


def test_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_dedup", "decontamination", "pii", "sentencepiece"]


def test_toxic_ones_go(spark, stages):
    before, after = stages["toxicity"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = {i: toxicity.score_of(model, toxicity.marginals(model, [r.text or ""])[0]) for i, r in before.items()}
    assert set(after) == {i for i, s in scores.items() if s < 0.5}


def test_one_of_each_group_stays(stages):
    before, after = stages["minhash_dedup"]
    want = brute_components([(i, r.text) for i, r in before.items()], 5, 80)
    assert set(after) == {i for i, (_, c) in want.items() if c == i}


def test_benchmark_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {i for i, r in before.items() if any(2 * m >= n > 0 and m for n, m in (brute_found(r.text, t) for t in items))}
    assert set(after) == set(before) - bad


def test_personal_data_goes(stages):
    before, after = stages["pii"]
    assert set(after) == set(before)
    for i, r in before.items():
        assert after[i].text == pii.masked(r.text, pii.spans_of(r.text)[1]) and after[i].n_chars == len(after[i].text)
        assert not pii.find_base(after[i].text)


def test_ids(stages):
    before, after = stages["sentencepiece"]
    library = sentencepiece_bpe.encoder(model_path("piece_bpe_32k.model")).library
    for i, r in before.items():
        ids = library.encode(r.text)
        assert after[i].n_tokens == len(ids) and after[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_nulls_and_repeats(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", "en", "s", 3), (3, "mail a@b.co", "en", "s", 11), (3, "mail a@b.co", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in P.STAGES:
        docs = stage(spark, docs, DATA)
    got = docs.orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.doc_id for r in got] == [None, 1, 2, 3] and [r.n_tokens == 0 for r in got] == [False, True, True, False]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    docs = spark.range(2500).selectExpr("id AS doc_id", "'some text' AS text", "'en' AS lang", "'src0' AS source")
    given = spark.conf.get(P.BATCH)
    seen = lambda df: max(r.n for r in df.select("doc_id").repartition(1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect())
    try:
        for name, rows in (("pii", "10000"), ("sentencepiece", "0"), ("pii", "300")):
            spark.conf.set(P.BATCH, rows)
            made = dict(P.STAGES)[name](spark, docs, DATA)
            assert made.count() == 2500 and seen(docs) == min(1000, int(rows) or 1000)
        spark.conf.set(P.BATCH, "5000")
        monkeypatch.setattr(P, "STAGES", [("pii", P.without_personal_data)])
        monkeypatch.setattr(P, "table", lambda *_: docs)
        assert P.run(spark, DATA).count() == 2500 and spark.conf.get(P.BATCH) == "5000"
    finally:
        spark.conf.set(P.BATCH, given)


def test_long_runs_of_names_pass_decontamination(spark):
    """Java's stack didn't hold them: the executor was lost."""
    docs = spark.createDataFrame([(1, "so " + "Von " * 20_000, "de", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in P.without_benchmark(spark, docs, DATA).collect()] == [1]
