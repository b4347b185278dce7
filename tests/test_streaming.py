"""Stateful streams over batches of files give what the folds give over all rows in order."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.plans.streams import events, ran
from palimpsest.sources.tables import table
from palimpsest.streaming import pipelines, state

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return table(spark, DATA, "events").toPandas().sort_values(["ts", "event_id"])


def test_breakers(spark, rows):
    calls = events(spark, DATA).selectExpr("event_type AS tool_name", "event_id", "ts", "value > 40 AS success")
    got = {r.event_id: r.state for r in ran(state.breakers_stream(calls)).collect()}
    now, want = {}, {}
    for r in rows.itertuples():
        now[r.event_type] = state.breaker_step(now.get(r.event_type, ("closed", 0, 0.0)), pd.Timestamp(r.ts).timestamp(), r.value > 40)
        want[r.event_id] = now[r.event_type][0]
    assert got == want and len(set(want.values())) > 1


def test_limits(spark, rows):
    calls = events(spark, DATA).selectExpr("event_type AS tool_name", "event_id", "ts")
    got = {r.event_id: r.allowed for r in ran(state.limited_stream(calls, 1 / 20_000, 3.0)).collect()}
    now, want = {}, {}
    for r in rows.itertuples():
        at = pd.Timestamp(r.ts).timestamp()
        tokens, last = now.get(r.event_type, (3.0, at))
        tokens, want[r.event_id] = state.bucket_step(tokens, last, at, 1 / 20_000, 3.0)
        now[r.event_type] = (tokens, at)
    assert got == want and set(want.values()) == {True, False}


def test_averages(spark, rows):
    stream = events(spark, DATA).selectExpr("user_id", "event_id", "ts", "array(value, 1D) AS vector", "1D AS weight")
    got = {}
    for r in ran(state.averages_stream(stream), "update").orderBy("n").collect():
        got[r.user_id] = (r.n, r["mean"])
    table_ = table(spark, DATA, "events").selectExpr("user_id", "event_id", "ts", "array(value, 1D) AS vector", "1D AS weight")
    for r in state.averages(table_).collect():
        assert got[r.user_id][0] == r.n and got[r.user_id][1] == pytest.approx(r["mean"])


def test_bursts_and_store(spark, tmp_path):
    made = ran(pipelines.bursts(events(spark, DATA), "6 hours"))
    assert 0 < made.count() <= 102
    seen = []
    pipelines.store(events(spark, DATA), lambda batch, number: seen.append((number, batch.count())), str(tmp_path / "state")).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2] and sum(n for _, n in seen) == 1000


def test_expiry(spark):
    rows = events(spark, DATA).selectExpr("user_id AS key", "ts", "event_id AS value")
    made = ran(pipelines.unexpired(rows, "10 days"))
    last = table(spark, DATA, "events").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "10 days")).agg(F.count("*"))
    assert 0 < made.count() <= last.count()


def test_cycle(spark):
    from palimpsest.plans.base import now
    from palimpsest.sources.tables import memories

    m = memories(spark, DATA, "confidence", "type", "importance")
    scratch = spark.createDataFrame([(1, None)], "key long, expires_at timestamp_ntz")
    log, e = table(spark, DATA, "events"), table(spark, DATA, "embeddings").selectExpr("vec_id AS id", "embedding")
    assert set(pipelines.cycle(m, scratch, log, now(), "light")) == {"strength", "confidence", "scratch"}
    assert set(pipelines.cycle(m, scratch, log, now(), "deep", e)) == {"strength", "confidence", "scratch", "log", "clusters"}


def _in_batches(spark, folder, batches, schema, made, mode="append"):
    """The rows of each batch that `made` gives for a stream of the batches, and the most rows of state."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
    got = {}
    stream = made(pipelines.read_events(spark, f"{folder}/in/*", spark.createDataFrame([], schema).schema, 1))
    writer = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, n: got.update({n: batch.collect()})).option("checkpointLocation", f"{folder}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    assert set(range(len(batches))) <= set(got)
    return got, max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)


def _user_events():
    """Three batches of events of 400 users, one of them null and one beyond 2^53."""
    users = [None, 2**53 + 1, *range(398)]
    rows = [(users[(7 * i) % 400], i, datetime(2024, 1, 1) + timedelta(minutes=(i * 37) % 500 + 500 * (i // 1000)), i % 3 > 0) for i in range(3000)]
    return [rows[a : a + 1000] for a in (0, 1000, 2000)]


def test_empty_runs_of_many_users_in_few_states(spark, tmp_path):
    batches = _user_events()
    got, states = _in_batches(spark, tmp_path, batches, "user_id long, event_id long, ts timestamp, empty boolean", lambda e: state.empty_runs_stream(e, 16))
    now, want = {}, set()
    for rows in batches:
        for user, event, _, empty in sorted(rows, key=lambda r: (r[2], r[1])):
            now[user] = state.empty_step(now.get(user, 0), empty)
            want.add((user, event, now[user]))
    assert {tuple(r) for rows in got.values() for r in rows} == want and states <= 17


def test_averages_of_many_users_in_few_states(spark, tmp_path):
    batches = [[(u, e, t, [1.0, e % 5.0] if e % 11 else [2.0], 1.0) for u, e, t, _ in rows] for rows in _user_events()]
    schema = "user_id long, event_id long, ts timestamp, vector array<double>, weight double"
    got, states = _in_batches(spark, tmp_path, batches, schema, lambda e: state.averages_stream(e, 16), "update")
    now = {}
    for n, rows in enumerate(batches):
        for user, _, _, vector, weight in sorted(rows, key=lambda r: (r[2], r[1])):
            count, mean = now.get(user, (0, None))
            now[user] = count + 1, state.average_step(mean, vector, weight)
        assert {r.user_id for r in got[n]} == {r[0] for r in rows} and len(got[n]) == len({r[0] for r in rows})
        for r in got[n]:
            assert r.n == now[r.user_id][0] and r["mean"] == pytest.approx(now[r.user_id][1].tolist())
    assert states <= 17


def test_first_arrivals_of_many_texts_in_few_states(spark, tmp_path):
    at = lambda hours: datetime(2024, 1, 1) + timedelta(hours=hours)
    batches = [[(f"h{(i * k) % 301}" if i % 50 else None, at(30 * n + i % 28)) for i in range(400)] for n, k in enumerate((1, 3, 7, 2, 5))]
    got, states = _in_batches(spark, tmp_path, batches, "content_hash string, ts timestamp", lambda t: state.first_arrivals(t, "1 hour", 2, 16))
    seen, passed = {}, at(-1000)
    for n, rows in enumerate(batches):
        new = {}
        for text, ts in rows:
            if text not in seen:
                new[text] = min(ts, new.get(text, ts))
        assert {(r.content_hash, r.ts) for r in got[n]} == set(new.items()) and len(got[n]) == len(new)
        seen = {text: ts for text, ts in (seen | new).items() if ts + timedelta(days=2) > passed}
        passed = max(ts for _, ts in rows) - timedelta(hours=1)
    assert states <= 3 * 17  # a state, a timer and its index
