"""The engine on a small store: what is stored is found, changed, deleted, exported, clustered."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.engine import Engine
from palimpsest.functions.models import hashed_embedder
from palimpsest.operators import entities, ingest
from palimpsest.sources import config, schemas

def now():
    return F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")



TEXTS = [
    ("a", "p", "We decided to use columnar files for the event store of the project"), ("b", "p", "How to install the parser: run the installer and configure the path"),
    ("c", "global", "I noticed that the parser fails on empty files"), ("d", "q", "The river flows through the old town"), ("e", "p", "We decided to use columnar files for the event store of the project"), ("f", "p", "  "),
]


@pytest.fixture(scope="module")
def engine(spark):
    new = spark.createDataFrame(TEXTS, "id string, project_id string, content string")
    made = Engine(spark, now=now()).store(new)
    return made.with_tables(memories=spark.createDataFrame(made.memories.collect(), made.memories.schema))


def ids(df):
    return [r.id for r in df.collect()]


def test_stored_once_and_enriched(engine):
    rows = {r.id: r for r in engine.memories.collect()}
    assert set(rows) == {"a", "b", "c", "d"}
    assert rows["a"].type == "decision" and rows["b"].type == "procedure" and rows["c"].tier == "ephemeral"
    assert len(rows["a"].embedding) == 64 and "columnar" in rows["a"].tags
    assert engine.store(engine.memories.select("id", "project_id", "content")).memories.count() == 4


def test_search_answer_and_learn(spark, engine):
    asked = spark.createDataFrame([(1, "columnar files", "p"), (2, "parser files", "p"), (3, "old town river", "q"), (4, "parser before:2020-01-01", "p")], "query_id long, text string, project string")
    found = engine.search(asked, 3)
    found = spark.createDataFrame(found.collect(), found.schema)
    best = {r.query_id: r.id for r in found.orderBy("score").collect()}
    assert best[1] == "a" and best[3] == "d" and "c" in [r.id for r in found.where("query_id = 2").collect()]
    assert "d" not in [r.id for r in found.where("query_id = 1").collect()]
    answers = {r.query_id: r for r in engine.answer(asked.where("query_id = 1")).collect()}
    assert answers[1].answer.startswith("We decided") and answers[1].sources[0] == "a"
    learnt = engine.learn(found)
    assert learnt.tables["co_retrieval_edges"].count() > 0
    assert learnt.memories.agg(F.sum("search_hit_count")).first()[0] == found.count()
    reranked = engine.search(asked.where("query_id = 1"), 2, rerank=True).orderBy("place").collect()
    assert reranked[0].id == "a"
    assert ids(engine.fallback(asked.where("query_id = 1"))) == ["a"]
    assert "c" in ids(engine.suggest(asked.where("query_id = 2")))


def test_changes(spark, engine, tmp_path):
    one = spark.createDataFrame([("a",)], "id string")
    rows, read = engine.recall(one)
    assert ids(rows) == ["a"] and read.memories.where("id = 'a'").first().access_count == 1
    assert engine.update(spark.createDataFrame([("a", "core", None)], "id string, tier string, agent_id string")).memories.where("id = 'a'").first()["tier"] == "core"
    votes = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "id string, confirm boolean")
    assert {r.id: r.confidence for r in engine.vote(votes).memories.collect()} == {"a": 0.7, "b": 0.4, "c": 0.5, "d": 0.5}
    gone = engine.delete(one)
    assert set(ids(gone.list())) == {"b", "c", "d"} and ids(gone.list(part="RIVER")) == ["d"] and len(ids(gone.list(offset=2))) == 1
    assert set(ids(engine.reset("p").memories)) == {"c", "d"}
    assert {r.project_id: (r.n_active, r.n_deleted) for r in gone.status().collect()} == {None: (3, 1), "p": (1, 1), "q": (1, 0), "global": (1, 0)}
    gone.export(f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    engine.export(f"{tmp_path}/json", lines=False)
    assert spark.read.json(f"{tmp_path}/json").count() == 4


def test_clusters_and_ingest(spark, engine):
    same = spark.createDataFrame([(f"x{i}", "p", f"the parser of files number {i} reads the files of the parser") for i in range(6)], "id string, project_id string, content string")
    made = engine.store(same).cluster(0.7, 5)
    assert made.tables["concept_nodes"].first().cluster_size == 6
    lines = [("t1", "p", "a text that says something new about the store and its many files", dt.datetime(2024, 1, 1)), ("t2", "p", "short", dt.datetime(2024, 1, 1))]
    more = engine.ingest(spark.createDataFrame(lines, "id string, project_id string, content string, created_at timestamp_ntz"))
    assert set(ids(more.memories)) == {"a", "b", "c", "d", "t1"}
    assert len(ids(engine.briefing(100))) == 2


def test_store_of_tables(spark, tmp_path):
    store = schemas.empty_store(spark)
    assert set(store) == set(schemas.TABLES) and store["entity_types"].count() == 9
    schemas.save({"memories": store["memories"], "edges": store["edges"]}, str(tmp_path))
    assert schemas.load(spark, str(tmp_path), ["edges"])["edges"].columns == schemas.schema("edges").names
    old = spark.createDataFrame([("a", "text", 1)], "id string, content string, odd int")
    row = schemas.upgraded(old, "memories").first()
    assert row.tier == "ephemeral" and row.embedding is None and "odd" not in row


def test_config(tmp_path):
    path = tmp_path / "c.json"
    assert config.load(path) == ({}, [])
    path.write_text('{"max_concurrent": 500, "alert_error_rate": -1, "x": 1, "heap_warning_mb": "a", "memory_sampling_enabled": true, "memory_limit_mb": true}')
    made, complaints = config.load(path)
    assert made == {"max_concurrent": 100.0, "memory_sampling_enabled": True} and len(complaints) == 4
    path.write_text("{")
    assert config.load(path)[0] == {} and len(config.load(path)[1]) == 1


def test_files(spark, tmp_path):
    (tmp_path / "d" / ".git").mkdir(parents=True)
    (tmp_path / "d" / "a.py").write_text("x\ny\n")
    (tmp_path / "d" / ".git" / "b.py").write_text("x")
    (tmp_path / "d" / "t.jsonl").write_text('{"content": "' + "long enough to be kept, as it says something at last" + '"}\n{bad\n\n')
    files = entities.read_sources(spark, str(tmp_path / "d")).withColumn("path", F.regexp_extract("path", r"(d/.*)$", 1))
    assert [(r.path, r.language, r.n_lines) for r in entities.code_files(files).collect() if r.language == "py"] == [("d/a.py", "py", 3)]
    assert ingest.list_files(spark, str(tmp_path)).count() == 1
    lines = ingest.read_lines(spark, str(tmp_path)).select("line_id.file", "line", "line_id")
    assert [(r.n_lines, r.n_bad) for r in ingest.bad_lines(lines).collect()] == [(3, 1)]
    assert ingest.transcript_texts(lines).count() == 1


def test_briefing_size():
    assert entities.briefing_size(500) == (10, 120) and entities.briefing_size(0) == (1, 50) and entities.briefing_size(10_000) == (10, 500)


def test_embedder(spark):
    embed = hashed_embedder(8)
    rows = spark.createDataFrame([("abc abc",), ("ab",), (None,)], "t string").select(embed(F.col("t")).alias("v")).collect()
    assert abs(sum(x * x for x in rows[0].v) - 1) < 1e-6 and sum(rows[1].v) == 0 and len(rows[2].v) == 8
