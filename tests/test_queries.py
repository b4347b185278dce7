"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import search
from palimpsest.sources import tables

DATA = "/root/testdata/sf0.001"
NAMES = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(str, r)) for r in df.where(df.notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, duck, name):
    made = entry.queries()[name](spark, DATA).toPandas()
    wanted = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(made.columns) == sorted(wanted.columns)
    assert rows(made) == rows(wanted)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["mmr_select", "concept_path"])
def test_searches_ask_every_twentieth_vector(spark, name):
    wanted = {r.vec_id for r in spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").select("vec_id").collect()}
    asked = {r.query_id for r in entry.queries()[name](spark, DATA).select("query_id").distinct().collect()}
    assert asked <= wanted and any(i % 100 for i in asked)
    assert len(asked) >= len(wanted) - 1  # a query may have nothing over the least score


def test_neighbours_where_parts_have_the_numbers_of_suppliers(spark, tmp_path):
    rows = [(1000020, 1), (1000020, 2), (40, 20), (1000040, 40), (60, 1), (80, None), (None, 3), (7, 20)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    made = [tuple(r) for r in entry.queries()["code_neighbours"](spark, str(tmp_path)).select("seed", "id", "steps").collect()]
    assert sorted(map(str, made)) == sorted(map(str, con.sql(entry.oracle_sql()["code_neighbours"]).fetchall()))


def test_hybrid_searches_join_no_texts(spark):
    records = tables.memories(spark, DATA, "confidence", "type", "importance").drop("content")
    above, *below = records._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")
    assert below and "text#" not in above and "content#" not in above and "kinds#" in above
    assert not {"content", "embedding"} & set(search.fused(spark, DATA)[0].columns)
