"""Vector and probability functions, and the rules of questions, against plain Python."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V
from palimpsest.operators import clusters, understanding
from palimpsest.operators.components import components
from palimpsest.streaming import state


def now():
    return F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'")




def test_blob(spark):
    values = [0.0, -0.0, 1.5, -2.75, 3.4e38, 1e-40, 0.1]
    rows = spark.createDataFrame([(bytearray(struct.pack("<7f", *values)),), (bytearray(b"abc"),), (bytearray(),), (None,)], "b binary").select(V.from_blob("b").alias("v")).collect()
    assert rows[0].v == list(struct.unpack("<7f", struct.pack("<7f", *values)))
    assert rows[1].v is None and rows[2].v == [] and rows[3].v is None


def test_softmax_and_spans(spark):
    row = spark.createDataFrame([([1000.0, 1001.0, 999.0], [0.0, 3.0, 1.0], [2.0, 0.5, 1.0])], "x array<double>, s array<double>, e array<double>").select(
        V.softmax("x").alias("p"), V.best_span("s", "e").alias("b"), V.best_span("s", "e", 1).alias("one"), V.jaccard(F.col("s"), F.col("e")).alias("j")).first()
    e = [math.exp(v) for v in (-1, 0, -2)]
    assert np.allclose(row.p, [x / sum(e) for x in e])
    assert (row.b.first, row.b.last, row.b.score) == (1, 2, 4.0) and (row.one.first, row.one.last) == (1, 1) and row.j == 0.2


@pytest.mark.parametrize(("text", "intent"), [("what is a parser", "factual"), ("when did it stop", "temporal"), ("where is the file", "navigational"), ("how to fix this error", "exploratory"),
                                              ("the build error E1234", "error_debug"), ("what does she believe in, her opinion", "social_reasoning"), ("", "factual"), (None, "factual")])
def test_intent(spark, text, intent):
    row = understanding.detected(spark.createDataFrame([(text,)], "text string")).first()
    assert row.intent == intent and (row.confidence > 0) == bool(text)


def test_time_operators(spark):
    rows = [("notes during:2023-12 x",), ("a last:2w  b",), ("between:2024-01-02..2024-01-05 before:2020-01-01",), ("as_of:2024-01-01",), ("last:0d",)]
    got = understanding.prepared(spark.createDataFrame(rows, "text string"), now()).select("text", "effective", "after", "before", "as_of").collect()
    assert [tuple(r)[1:] for r in got] == [("notes x", "2023-12-01", "2024-01-01", None), ("a b", "2024-01-18", None, None), (rows[2][0], "2024-01-02", "2024-01-05", None),
                                           ("as_of:2024-01-01", None, None, "2024-01-01"), ("last:0d", None, None, None)]


def test_expansion(spark):
    got = spark.createDataFrame([("Fix the DB config",)], "t string").select(understanding.expanded(F.col("t")).alias("w")).first().w
    assert got == sorted({"fix", "bug", "patch", "the", "db", "database", "config", "configuration", "settings"})


def test_phases():
    assert [clusters.phase(*a) for a in ((None, 0, 1), (25, 0, 1), (1, 0.05, 1), (1, 0, 3), (1, 0, 4))] == ["deep", "deep", "deep", "medium", "light"]


def test_components(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2040)]
    root = {v: v for e in edges for v in e}

    def end(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = end(a), end(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: end(v) for v in root if any(v in e and e[0] != e[1] for e in edges)}


def test_folds():
    run = 0
    assert [run := state.empty_step(run, e) for e in (True, True, False, True)] == [1, 2, 0, 1]
    mean = state.average_step(state.average_step(None, [2.0, 0.0]), [0.0, 1.0])
    assert np.allclose(mean, np.array([0.7, 0.3]) / np.hypot(0.7, 0.3)) and len(state.average_step(mean, [1.0])) == 1
    now = ("closed", 0, 0.0)
    names = []
    for at, ok in [(1, False)] * 4 + [(2, True)] + [(3, False)] * 5 + [(10, True), (40, False), (50, True), (71, True)]:
        now = state.breaker_step(now, at, ok)
        names.append(now[0])
    assert names == ["closed"] * 9 + ["open", "open", "open", "open", "closed"]
    assert state.bucket_step(0.5, 0, 0.1, 1, 2) == (0.6, False) and state.bucket_step(0.0, 0, 9, 1, 2) == (1.0, True)


def test_averages_batch_as_the_fold(spark):
    import datetime as dt

    rng = np.random.Generator(np.random.PCG64(1))
    rows = [(int(u), i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=int(rng.integers(0, 50))), rng.normal(size=3).tolist(), 1.0) for i, u in enumerate(rng.integers(0, 4, 40))]
    got = {r.user_id: r for r in state.averages(spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp_ntz, vector array<double>, weight double")).collect()}
    for user in got:
        mean = None
        for r in sorted((r for r in rows if r[0] == user), key=lambda r: (r[2], r[1])):
            mean = state.average_step(mean, r[3], r[4])
        assert np.allclose(got[user].mean, mean) and got[user].n == sum(r[0] == user for r in rows)


def test_weights_sum_to_one():
    from palimpsest.operators.extensions import HEALTH, RESOLUTION
    from palimpsest.operators.scoring import RERANK_TO, RRF_WEIGHTS, SIGNAL_WEIGHTS

    for weights in (*RRF_WEIGHTS.values(), *SIGNAL_WEIGHTS.values(), HEALTH.values(), RESOLUTION.values(), RERANK_TO.values()):
        assert abs(sum(weights) - 1) < 1e-9
