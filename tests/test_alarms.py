import random
import tempfile
from datetime import datetime, timedelta

import pytest

from fenestra.streaming import counters
from fenestra.streaming.alarms import alarms

DAY = timedelta(days=1)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def brute(events, in_a_row, silent, last):
    """Failures in a row by key, and silences that the watermark, the last event of all, has passed."""
    out, by_key = [], {}
    for e in sorted(events, key=lambda e: (e[1], e[2])):
        by_key.setdefault(e[0], []).append(e)
    for key, own in by_key.items():
        streak = 0
        for (_, at, _, bad), after in zip(own, [*own[1:], None], strict=True):
            streak = streak + 1 if bad else 0
            if streak == in_a_row:
                out.append((key, "failures", at, streak))
            if after[1] > at + silent if after else at + silent <= last:
                out.append((key, "silence", at + silent, streak))
    return sorted(out)


@pytest.fixture
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_stream_equals_brute_force_after_a_restart(spark, store):
    """A day a batch; the stream is broken off in the middle and goes on from its checkpoint."""
    rng, begin = random.Random(1), datetime(2024, 1, 1)
    events = [(k, begin + d * DAY + timedelta(minutes=m), 100 * d + m, rng.random() < 0.6) for d in range(8) for m, k in enumerate(rng.choices(range(6), k=9)) if not (k == 5 and 2 <= d <= 5)]
    inbox, home, got = tempfile.mkdtemp(dir="/tmp"), tempfile.mkdtemp(dir="/tmp"), {}
    schema = "key bigint, at timestamp, id bigint, bad boolean"
    stream = lambda: alarms(counters.stream_parquet(spark, f"{inbox}/*", schema, 1), in_a_row=3, silent="2 days")

    def each(batch, number):
        got[number] = [tuple(r) for r in batch.collect()]

    for half in (range(4), range(4, 8)):  # the query ends and starts again between the halves
        for d in half:
            spark.createDataFrame([e for e in events if (e[1] - begin).days == d], schema).coalesce(1).write.parquet(f"{inbox}/{d}")
            counters.run_available(stream(), f"{home}/checkpoint", each, mode="append")
    rows = sorted(r for batch in got.values() for r in batch)
    assert rows == brute(events, 3, 2 * DAY, max(e[1] for e in events))
    assert {r[1] for r in rows} == {"failures", "silence"}
