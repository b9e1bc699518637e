"""A store whose entries expire, as a batch query and as a stream.

Batch: what is alive at a moment, given puts and deletes with event times. Stream: the same rule kept as state per key, which goes when the
watermark passes an entry's expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TTL_SECONDS, CAP = 3600, 200


def alive(puts: DataFrame, key: str, at: str, now: Column, ttl: int = TTL_SECONDS, deleted: str | None = None) -> DataFrame:
    """Latest put per key that hasn't expired by ``now`` (alive while the expiry lies after it) and wasn't deleted since; adds expires_in (seconds)."""
    latest = puts.where(F.col(at) <= now).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(at).desc(), *[c for c in puts.columns if c not in (key, at)]))).where("_r = 1").drop("_r")
    left = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    out = latest.withColumn("expires_in", ttl - left).where("expires_in > 0")
    return out.where(F.col(deleted).isNull() | (F.col(deleted) > now)) if deleted else out


def capped(entries: DataFrame, at: str, ties: list[str], cap: int = CAP) -> DataFrame:
    """The ``cap`` entries that expire last (all have the same time to live). A top-k, not a global window."""
    return entries.orderBy(F.col(at).desc(), *ties).limit(cap)


def streamed(puts: DataFrame, key: str, at: str, value: str, ttl: int = TTL_SECONDS, delay: str = "1 hour") -> DataFrame:
    """(key, value, at, expires_at): an update of a key's entry for every micro-batch that puts a later one; use output mode ``update``.

    State per key is its latest put; one that isn't later is ignored. It is dropped when the watermark, ``delay`` behind the latest put of all, passes the expiry.
    The store's cap is for whoever reads the updates: ``capped``.
    """
    kinds = {f.name: f.dataType for f in puts.schema.fields}
    out = T.StructType([T.StructField(key, kinds[key]), T.StructField(value, kinds[value]), T.StructField(at, T.TimestampType()), T.StructField("expires_at", T.TimestampType())])

    def update(own: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        last = None
        for f in frames:
            row = f.sort_values(at, kind="stable").iloc[-1]
            if last is None or row[at] >= last[at]:
                last = row
        micros = last[at].value // 1000
        if known is None or micros > known:
            state.update((micros,))
            expires = last[at] + pd.Timedelta(seconds=ttl)
            state.setTimeoutTimestamp(max(expires.value // 1_000_000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({key: [own[0]], value: [last[value]], at: [last[at]], "expires_at": [expires]})
        else:
            state.setTimeoutTimestamp(max(known // 1000 + ttl * 1000, state.getCurrentWatermarkMs() + 1))

    return puts.select(key, value, at).withWatermark(at, delay).groupBy(key).applyInPandasWithState(update, out, "last long", "update", "EventTimeTimeout")


def deduplicated(stream: DataFrame, key: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each key once per watermark delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, sink, checkpoint: str, mode: str = "append"):
    """Processes what is there and stops: ``sink(batch, batch_id)`` gets every micro-batch. The checkpoint folder must be shared."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
