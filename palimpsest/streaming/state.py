"""State over streams of events, and the same in batch: searches that find nothing, moving averages of vectors, breakers, limits.

Each operator has a fold, a plain function of a state and a row, that the stream and the batch version share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Share of a new vector of weight 1, failures that open a breaker, seconds until it tries again.
ALPHA, FAILURES, RETRY_SECONDS = 0.3, 5, 30.0


def empty_step(run: int, empty: bool) -> int:
    """Empty searches in a row after one more search."""
    return run + 1 if empty else 0


def average_step(mean: np.ndarray | None, vector: np.ndarray, weight: float = 1.0) -> np.ndarray:
    """The moving average at length 1 after one more vector; another length of vector begins anew."""
    vector = np.asarray(vector, float)
    if mean is None or len(mean) != len(vector):
        made = vector
    else:
        share = ALPHA * weight
        made = (1 - share) * mean + share * vector
    size = np.linalg.norm(made)
    return made / size if size > 0 else made


def breaker_step(state: tuple[str, int, float], at: float, success: bool) -> tuple[str, int, float]:
    """(closed, open or half-open; failures in a row; time of opening) after one more call.

    FAILURES failures in a row open it; after RETRY_SECONDS one call is let through, which closes or opens it again.
    """
    name, failures, opened = state
    if name == "open" and at - opened >= RETRY_SECONDS:
        name = "half-open"
    if name == "open":
        return name, failures, opened
    if success:
        return "closed", 0, opened
    failures += 1
    return ("open", failures, at) if name == "half-open" or failures >= FAILURES else ("closed", failures, opened)


def bucket_step(tokens: float, last: float, at: float, rate: float, most: float) -> tuple[float, bool]:
    """(tokens left, whether the call is let through) of a bucket that gains `rate` tokens a second up to `most`."""
    tokens = min(most, tokens + max(0.0, at - last) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(["ts", "event_id"], kind="stable")


#: Buckets of keys, each one state, so that Python and the store are called for each bucket of a batch, not for each key.
BUCKETS = 512


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """rows with their bucket by key; null keys have bucket -1. A stream keeps its number of buckets for life."""
    return rows.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int"))


def _numbered(events: DataFrame, buckets: int) -> DataFrame:
    """events in buckets by user_id, 0 for null so that the others stay whole numbers."""
    return _bucketed(events, "user_id", buckets).withColumn("user_id", F.coalesce("user_id", F.lit(0)).cast("long"))


def empty_runs_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, event_id, empty_run) for each event of a stream (user_id, event_id, ts, empty); the run goes on over batches."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows, runs = _in_order(parts), []
        users = rows["user_id"].tolist()
        for user, empty in zip(users, rows["empty"].tolist(), strict=True):
            now[user] = empty_step(now.get(user, 0), bool(empty))
            runs.append(now[user])
        state.update((list(now), list(now.values())))
        yield pd.DataFrame({"user_id": users if key[0] >= 0 else None, "event_id": rows["event_id"], "empty_run": runs})

    rows = _numbered(events.select("user_id", "event_id", "ts", "empty"), buckets)
    return rows.groupBy("bucket").applyInPandasWithState(
        update, "user_id long, event_id long, empty_run long", "users array<long>, runs array<long>", "append", GroupStateTimeout.NoTimeout
    )


class Averages(StatefulProcessor):
    """The moving averages of a bucket's users: for each the number of vectors and their average; no vectors are kept."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("averages", "users array<long>, n array<long>, means array<array<double>>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, new = {}, {}
        if self.state.exists():
            now = {user: (n, np.array(mean)) for user, n, mean in zip(*self.state.get(), strict=True)}
        ordered = _in_order(rows)
        for user, vector, weight in zip(*(ordered[c].tolist() for c in ("user_id", "vector", "weight")), strict=True):
            n, mean = now.get(user, (0, None))
            now[user] = new[user] = n + 1, average_step(mean, vector, weight)
        self.state.update((list(now), [n for n, _ in now.values()], [mean.tolist() for _, mean in now.values()]))
        users = list(new) if key[0] >= 0 else None
        yield pd.DataFrame({"user_id": users, "n": [n for n, _ in new.values()], "mean": [mean.tolist() for _, mean in new.values()]})

    def close(self) -> None:
        pass


class FirstArrival(StatefulProcessor):
    """The times of first arrival of a bucket's texts, each given once; forgotten `days` after the watermark has passed it, by a timer."""

    def __init__(self, days: float):
        self.milliseconds = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.seen = handle, handle.getValueState("seen", "hashes array<string>, micros array<long>")

    def _until(self, micros: int) -> int:
        return micros // 1000 + self.milliseconds

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = dict(zip(*self.seen.get(), strict=True)) if self.seen.exists() else {}
        new: dict[str, int] = {}
        for part in rows:
            for text, micros in part.groupby("content_hash")["micros"].min().items():
                if text not in now:
                    new[text] = min(int(micros), new.get(text, int(micros)))
        if new:
            if not now or min(new.values()) < min(now.values()):  # the timer is that of the first to be forgotten
                self.handle.registerTimer(self._until(min(new.values())))
            now |= new
            self.seen.update((list(now), list(now.values())))
            yield pd.DataFrame({"content_hash": list(new) if key[0] >= 0 else None, "micros": list(new.values())})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        now = dict(zip(*self.seen.get(), strict=True)) if self.seen.exists() else {}
        left = {text: micros for text, micros in now.items() if self._until(micros) > at}
        if left:
            self.seen.update((list(left), list(left.values())))
            self.handle.registerTimer(self._until(min(left.values())))
        else:
            self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def _with_store(events: DataFrame) -> None:
    """State of several kinds, timers and expiry need the store that keeps it on disk."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def averages_stream(events: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(user_id, n, mean) of each user with new rows of a stream (user_id, event_id, ts, vector, weight)."""
    _with_store(events)
    rows = _numbered(events.select("user_id", "event_id", "ts", "vector", "weight"), buckets)
    return rows.groupBy("bucket").transformWithStateInPandas(Averages(), "user_id long, n long, mean array<double>", "Update", "None")


def first_arrivals(texts: DataFrame, late: str = "1 hour", days: float = 60, buckets: int = BUCKETS) -> DataFrame:
    """(content_hash, ts) of each text of a stream (content_hash, ts) when it first arrives; what is `days` old is new again."""
    _with_store(texts)
    rows = texts.select("content_hash", "ts", F.unix_micros("ts").alias("micros")).withWatermark("ts", late)
    rows = _bucketed(rows, "content_hash", buckets).withColumn("content_hash", F.coalesce("content_hash", F.lit("")))
    made = rows.groupBy("bucket").transformWithStateInPandas(FirstArrival(days), "content_hash string, micros long", "Append", "EventTime")
    return made.select("content_hash", F.timestamp_micros("micros").alias("ts"))


def averages(events: DataFrame) -> DataFrame:
    """(user_id, n, mean) of a table (user_id, event_id, ts, vector, weight): the fold in order of time, as one expression.

    A user's vectors are gathered in one row: use it where a user's events fit a task.
    """
    lists = (
        events.groupBy("user_id")
        .agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", F.col("vector").cast("array<double>").alias("v"), F.col("weight").cast("double").alias("w")))).alias("rows"))
    )
    unit = "transform(array(sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))), n -> transform({0}, x -> if(n > 0, x / n, x)))[0]"
    mixed = f"zip_with(m, r.v, (a, b) -> (1 - {ALPHA}D * r.w) * a + {ALPHA}D * r.w * b)"
    step = f"transform(array(if(size(m) = size(r.v), {mixed}, r.v)), y -> {unit.format('y')})[0]"
    return lists.select("user_id", F.size("rows").cast("long").alias("n"), F.expr(f"aggregate(rows, cast(array() as array<double>), (m, r) -> {step})").alias("mean"))


def breakers_stream(calls: DataFrame) -> DataFrame:
    """(tool_name, event_id, state) after each call of a stream (tool_name, event_id, ts, success)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("closed", 0, 0.0)
        rows, names = _in_order(parts), []
        for row in rows.itertuples():
            now = breaker_step(now, pd.Timestamp(row.ts).timestamp(), bool(row.success))
            names.append(now[0])
        state.update(now)
        yield pd.DataFrame({"tool_name": key[0], "event_id": rows["event_id"], "state": names})

    return (
        calls.groupBy("tool_name")
        .applyInPandasWithState(update, "tool_name string, event_id long, state string", "name string, failures long, opened double", "append", GroupStateTimeout.NoTimeout)
    )


def limited_stream(calls: DataFrame, rate: float, most: float) -> DataFrame:
    """(tool_name, event_id, allowed) of each call of a stream: a bucket of tokens for each tool."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (most, None)
        rows, allowed = _in_order(parts), []
        for ts in rows["ts"]:
            at = pd.Timestamp(ts).timestamp()
            tokens, yes = bucket_step(tokens, at if last is None else last, at, rate, most)
            last = at
            allowed.append(yes)
        state.update((tokens, last))
        yield pd.DataFrame({"tool_name": key[0], "event_id": rows["event_id"], "allowed": allowed})

    return (
        calls.groupBy("tool_name")
        .applyInPandasWithState(update, "tool_name string, event_id long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
    )
