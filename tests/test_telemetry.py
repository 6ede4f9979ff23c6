"""Streams with state against the batch operators, and bursts by hand."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import monitor as M
from tidewell.streaming import telemetry as T

SCHEMA = "host long, ts timestamp, seq long, total long, idle long, disk long, temp double"
STORE = "spark.sql.streaming.stateStore.providerClass"
NOON = dt.datetime(2024, 3, 1, 12)


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(STORE)


def streamed(spark, tmp_path, batches, make, schema=SCHEMA):
    """Rows of a file stream that gets ``batches`` one by one, a run each."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(120) and k < len(batches)
    return spark.read.parquet(f"{tmp_path}/out")


def readings(seed=3):
    rng = random.Random(seed)
    rows, total, idle = [], {1: 0, 2: 50}, {1: 0, 2: 7}
    for seq in range(60):
        host = rng.choice((1, 2))
        total[host] += rng.randrange(0, 90)
        idle[host] += rng.randrange(0, 40)
        known = rng.random() > 0.15
        rows.append((host, NOON + dt.timedelta(seconds=40 * seq), seq, total[host] if known else None, idle[host] if known else None, rng.choice([None, rng.randrange(10**13)]), rng.choice([None, 40.0, 60.0, 70.0])))
    return rows


def test_two_batches_equal_the_batch_operators(rocks, tmp_path):
    rows = readings()
    found = streamed(rocks, tmp_path, [rows[:31], rows[31:]], lambda s: T.readings(s, 60.0, 2, 300))
    got = {r["seq"]: (r["cpu_pct"], r["disk_delta"]) for r in found.collect()}
    samples = rocks.createDataFrame(rows, SCHEMA)
    want = {r["seq"]: (r["cpu_pct"], r["d"]) for r in M.delta(M.cpu_percent(samples), "disk", "d").collect()}
    assert got == {k: (None if c is None else float(c), d) for k, (c, d) in want.items()}
    assert sum(c is not None for c, _ in got.values()) > 20 and sum(d is not None for _, d in got.values()) > 10
    hot = {r["seq"]: (r["hot"], r["stop"]) for r in found.collect()}
    runs = {r["seq"]: (r["consecutive"], r["fired"]) for r in M.breach_runs(samples, "temp", 60.0, 2).collect()}
    assert {k: hot[k] for k in runs} == runs and any(s for _, s in runs.values()) and not any(s for k, (_, s) in hot.items() if k not in runs)
    cleaned = {1: None, 2: None}
    for host, ts, seq, *_ in rows:
        due = cleaned[host] is None or ts - cleaned[host] >= dt.timedelta(seconds=300)
        assert next(r["hygiene"] for r in found.where(F.col("seq") == seq).collect()) == due if seq % 9 == 0 else True
        cleaned[host] = ts if due else cleaned[host]


def at(host, second, seq, value):
    return (host, NOON + dt.timedelta(seconds=second), seq, None, None, None, value)


def seconds(df):
    return sorted((r["host"], (r["ts"] - NOON).total_seconds(), r["kind"], r["reasons"]) for r in df.collect())


PLAN = M.Sampling(interval=60, burst=10, every=3)


def test_expected_sample_times(spark):
    """A reading each second; the one at 60 sets off a burst to 70."""
    rows = [at(1, s, s, 95.0 if s in (60, 65, 30) else 20.0) for s in range(150)] + [at(2, 0, 0, 99.0), (None, NOON, 1, None, None, None, 99.0), (2, None, 3, None, None, None, 99.0)]
    found = seconds(M.burst_samples(spark.createDataFrame(rows, SCHEMA), {"temp": 90.0}, PLAN))
    why = "temp>=90"
    one = [(1, 0.0, "sample", None), (1, 60.0, "burst", why), (1, 60.0, "sample", why), *[(1, s, "burst", why) for s in (63.0, 66.0, 69.0)], (1, 70.0, "closed", why), (1, 130.0, "sample", None)]
    assert found == sorted([*one, (2, 0.0, "sample", why), (2, 0.0, "burst", why), (2, 10.0, "closed", why)], key=lambda r: r[:3])


def test_bursts_in_two_batches(rocks, tmp_path):
    """A burst that spans the batches; host 3 falls silent and a timer closes its burst."""
    rows = [at(1, s, s, 95.0 if s == 60 else 20.0) for s in range(150)] + [at(3, s, s, 91.0) for s in range(60, 66)]
    rows.sort(key=lambda r: r[1])
    cut = next(k for k, r in enumerate(rows) if (r[1] - NOON).total_seconds() == 65)
    found = streamed(rocks, tmp_path, [rows[:cut], rows[cut:]], lambda s: T.burst_samples(s, {"temp": 90.0}, PLAN))
    assert seconds(found) == seconds(M.burst_samples(rocks.createDataFrame(rows, SCHEMA), {"temp": 90.0}, PLAN))
    assert (3, 70.0, "closed", "temp>=90") in seconds(found)


def test_container_percent(spark):
    rows = [(250, 50, 2000, 1000, 4), (250, 50, 2000, 1000, None), (9, 0, 5, 5, 2), (1, 0, 3, 0, 1)]
    made = M.container_percent(spark.createDataFrame(rows, "used long, used_before long, system long, system_before long, cpus int"))
    assert [r["cpu_pct"] for r in made.collect()] == [80.0, 20.0, 0.0, 33.33]
