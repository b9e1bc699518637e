"""A store with a cap and a time to live as one stream: state that spans keys, in two levels.

Events are puts and deletes with event times. Keys are dealt to shards by hash. A shard keeps its own ``cap`` latest puts, which is all of
the store that can be in it, and passes on what may change the store: puts that it didn't push out itself, and deletes. One store operator
applies those in the order of time and keeps ``cap`` entries. So the one task that sees all keys gets, for each micro-batch, at most ``shards * cap`` puts, and
those that were deleted in the same batch, whatever the number of events.

A put of a full store pushes out the entry that expires first; what was pushed out doesn't come back when another is deleted. A put of a known key
replaces it. An entry is alive while its expiry lies after the time of what happens; timers remove expired entries when the watermark passes. Ties in time are
ordered by key, a delete before a put. Events later than ``delay`` behind the watermark are dropped, and so are events without key or time.

Needs Spark's RocksDB state store: set ``STATE_STORE`` in the session before the query starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreloom.streaming.ttl import CAP, TTL_SECONDS

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
SHARDS = 16
EVENTS = "key string, value string, at timestamp, deleted boolean"
CHANGES = "key string, value string, at timestamp, expires_at timestamp, happened string"


class Entries:
    """Alive entries by key, as (at in microseconds, value), with the store's rules."""

    def __init__(self, state, cap: int, ttl: int):
        self.state, self.cap, self.ttl = state, cap, ttl * 1_000_000
        self.known = {k[0]: (v[0], v[1]) for k, v in state.iterator()} if state.exists() else {}
        self.before = dict(self.known)

    def expire(self, now: int) -> list[tuple[str, int, str | None]]:
        gone = [(k, at, v) for k, (at, v) in self.known.items() if at + self.ttl <= now]
        for k, _, _ in gone:
            del self.known[k]
        return sorted(gone, key=lambda e: (e[1], e[0]))

    def put(self, key: str, at: int, value: str | None) -> list[tuple[str, int, str | None]]:
        """Adds an entry; those that it pushed out, or itself if it is older than all of a full store."""
        self.known.pop(key, None)
        self.known[key] = (at, value)
        out = []
        while len(self.known) > self.cap:
            k = min(self.known, key=lambda k: (self.known[k][0], k))
            out.append((k, *self.known.pop(k)))
        return out

    def delete(self, key: str, at: int) -> tuple[str, int, str | None] | None:
        if key in self.known and self.known[key][0] <= at:
            return (key, *self.known.pop(key))
        return None

    def save(self) -> None:
        for k in self.before.keys() - self.known.keys():
            self.state.removeKey((k,))
        for k, v in self.known.items():
            if self.before.get(k) != v:
                self.state.updateValue((k,), v)


def _events(frames: Iterator[pd.DataFrame]) -> list[tuple[int, str, bool, str | None]]:
    """(at, key, is a put, value), in order."""
    out = []
    for f in frames:
        at = f["at"].astype("datetime64[us]").astype("int64")
        out += zip(at.tolist(), f["key"].tolist(), (~f["deleted"].astype(bool)).tolist(), f["value"].tolist(), strict=True)
    return sorted(out, key=lambda e: e[:3])


def _time(micros: list[int]) -> pd.Series:
    return pd.to_datetime(pd.Series(micros, dtype="int64"), unit="us")


class _Processor(StatefulProcessor):
    def __init__(self, cap: int, ttl: int):
        self.cap, self.ttl = cap, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getMapState("alive", "key string", "at long, value string")

    def timer(self, entries: Entries, watermark: int) -> None:
        """One timer at a time, for the entry that expires first."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if entries.known:
            self.handle.registerTimer(max(min(at for at, _ in entries.known.values()) // 1000 + self.ttl * 1000, watermark + 1))

    def close(self) -> None:
        pass


class Shard(_Processor):
    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = Entries(self.state, self.cap, self.ttl)
        passed: list[tuple[int, str, bool, str | None]] = []
        for at, name, put, value in _events(rows):
            entries.expire(at)
            if put:
                pushed = {(a, k) for k, a, _ in entries.put(name, at, value)}
                passed.append((at, name, True, value))
                passed = [e for e in passed if not e[2] or (e[0], e[1]) not in pushed] if pushed else passed
            elif entries.delete(name, at):
                passed.append((at, name, False, None))
        entries.save()
        self.timer(entries, timerValues.getCurrentWatermarkInMs())
        if passed:
            yield pd.DataFrame({"key": [e[1] for e in passed], "value": [e[3] for e in passed], "at": _time([e[0] for e in passed]), "deleted": [not e[2] for e in passed]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = Entries(self.state, self.cap, self.ttl)
        entries.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        entries.save()
        self.timer(entries, timerValues.getCurrentWatermarkInMs())
        return iter([])


class Store(_Processor):
    def rows(self, changes: list[tuple[str, str, int, str | None]]) -> pd.DataFrame:
        at = [c[2] for c in changes]
        return pd.DataFrame({"key": [c[1] for c in changes], "value": [c[3] for c in changes], "at": _time(at), "expires_at": _time([a + self.ttl * 1_000_000 for a in at]), "happened": [c[0] for c in changes]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = Entries(self.state, self.cap, self.ttl)
        changes: list[tuple[str, str, int, str | None]] = []
        for at, name, put, value in _events(rows):
            changes += [("expired", *e) for e in entries.expire(at)]
            if put:
                changes.append(("put", name, at, value))
                changes += [("evicted", *e) for e in entries.put(name, at, value)]
            elif gone := entries.delete(name, at):
                changes.append(("deleted", *gone))
        entries.save()
        self.timer(entries, timerValues.getCurrentWatermarkInMs())
        if changes:
            yield self.rows(changes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        entries = Entries(self.state, self.cap, self.ttl)
        gone = entries.expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        entries.save()
        self.timer(entries, timerValues.getCurrentWatermarkInMs())
        if gone:
            yield self.rows([("expired", *e) for e in gone])


def capped_store(events: DataFrame, cap: int = CAP, ttl: int = TTL_SECONDS, delay: str = "1 hour", shards: int = SHARDS) -> DataFrame:
    """(key, value, at, expires_at, happened) of a stream (key, value, at, deleted): what changes in the store, in append mode.

    ``happened`` is put, evicted, deleted or expired; of the others ``at`` is when the entry was put.
    """
    t = events.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), F.col("at").cast("timestamp").alias("at"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    t = t.where("key is not null and at is not null").withWatermark("at", delay).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    passed = t.groupBy("shard").transformWithStateInPandas(Shard(cap, ttl), EVENTS, "Append", "EventTime", eventTimeColumnName="at")
    return passed.withColumn("all", F.lit(0)).groupBy("all").transformWithStateInPandas(Store(cap, ttl), CHANGES, "Append", "EventTime", eventTimeColumnName="at")
