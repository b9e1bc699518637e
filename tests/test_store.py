import random
from datetime import datetime, timedelta

import pytest

from scoreloom.streaming import store

START = datetime(2026, 1, 1)
TTL = 600


@pytest.fixture
def rocks(spark):
    before = {k: spark.conf.get(k, None) for k in store.STATE_STORE}
    for k, v in store.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def brute(batches, cap):
    """The store as one dictionary: (what happened, what is left)."""
    known, log = {}, []
    for rows in batches:
        for at, key, put, value in sorted((a, k, not gone, v) for k, v, a, gone in rows):
            for k in [k for k, (t, _) in known.items() if t + timedelta(seconds=TTL) <= at]:
                log.append(("expired", k, known.pop(k)[0]))
            if put:
                known.pop(key, None)
                while len(known) >= cap:
                    k = min(known, key=lambda k: (known[k][0], k))
                    log.append(("evicted", k, known.pop(k)[0]))
                known[key] = (at, value)
                log.append(("put", key, at))
            elif key in known:
                log.append(("deleted", key, known.pop(key)[0]))
    return log, known


def run(spark, folder, batches, cap, shards):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, store.EVENTS.replace("deleted boolean", "deleted boolean")).selectExpr("key", "value", "at", "deleted").coalesce(1).write.parquet(f"{folder}/in/b{n:03d}")
    stream = spark.readStream.schema("key string, value string, at timestamp, deleted boolean").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    seen = []
    changes = store.capped_store(stream, cap, TTL, "2 hours", shards)
    q = changes.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(lambda b, _: seen.extend(b.collect())).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return seen


def made(seed, n_batches, per_batch):
    rnd, at, out = random.Random(seed), START, []
    for _ in range(n_batches):
        rows = []
        for _ in range(per_batch):
            at += timedelta(seconds=rnd.choice([1, 1, 5, 40]))
            key = f"k{rnd.randrange(25)}"
            gone = rnd.random() < 0.2
            rows.append((key, None if gone else f"v{rnd.randrange(99)}", at, gone))
        out.append(rows)
    return out


@pytest.mark.parametrize(("cap", "shards"), [(4, 3), (1, 2)])
def test_the_cap_evicts_across_keys(rocks, tmp_path, cap, shards):
    batches = made(cap, 4, 30)
    got = run(rocks, str(tmp_path), batches, cap, shards)
    log, known = brute(batches, cap)
    left = {}
    for r in got:
        if r.happened == "put":
            left[r.key] = (r.at, r.value)
            assert r.expires_at == r.at + timedelta(seconds=TTL)
        elif r.key in left and left[r.key][0] == r.at:
            del left[r.key]
    assert left == known and len(known) <= cap
    assert sum(r.happened == "evicted" for r in got) > 5 and any(x[0] == "deleted" for x in log)
    # What the store says that happened did happen; the shards only left out puts that other puts had pushed out in the same batch.
    assert {(r.happened, r.key, r.at) for r in got if r.happened in ("deleted", "expired")} <= {x for x in log if x[0] in ("deleted", "expired")}


def test_timers_expire_entries_and_events_without_key_go(rocks, tmp_path):
    day = timedelta(days=1)
    batches = [[("a", "1", START, False), (None, "x", START, False), ("b", "2", START, None)], [("late", "3", START + day, False)], [("late2", "4", START + 2 * day, False)]]
    got = run(rocks, str(tmp_path), batches, 5, 2)
    gone = {r.key for r in got if r.happened == "expired"}
    assert {"a", "b"} <= gone and {r.key for r in got if r.happened == "put"} == {"a", "b", "late", "late2"}
