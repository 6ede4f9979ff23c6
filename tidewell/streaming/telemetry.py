"""Telemetry with several readings a host as state, and bursts by timers.

These need the state store of RocksDB:
``spark.sql.streaming.stateStore.providerClass`` =
``org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidewell.operators.monitor import SamplerState, Sampling, alert_reasons, sample

READINGS = "host long, ts timestamp, seq long, cpu_pct double, disk_delta long, hot int, stop boolean, hygiene boolean"
SAMPLES = "host long, ts timestamp, kind string, reasons string"


def _whole(x: Any) -> int | None:
    return None if pd.isna(x) else int(x)


class _Readings(StatefulProcessor):
    def __init__(self, limit: float, needed: int, hygiene_seconds: float) -> None:
        self.limit, self.needed, self.hygiene = limit, needed, round(hygiene_seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "total long, idle long, disk long, hot int, cleaned long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        total, idle, disk, hot, cleaned = self.last.get() if self.last.exists() else (None, None, None, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            now_total, now_idle, now_disk, at = _whole(r.total), _whole(r.idle), _whole(r.disk), r.ts.value // 1000
            cpu = None
            if total is not None and now_total is not None:
                passed = max(now_total - total, 1)
                rested = 0 if idle is None or now_idle is None else max(now_idle - idle, 0)
                cpu = ((passed - rested) * 20000 + passed) // (2 * passed) / 100
            change = None if disk is None or now_disk is None else now_disk - disk
            stop = False
            if not pd.isna(r.temp):
                hot = hot + 1 if r.temp >= self.limit else 0
                stop = hot >= self.needed
            clean = cleaned is None or at - cleaned >= self.hygiene
            out.append((key[0], r.ts, r.seq, cpu, change, hot, stop, clean))
            total, idle, disk = now_total, now_idle, disk if now_disk is None else now_disk
            hot, cleaned = 0 if stop else hot, at if clean else cleaned
        self.last.update((total, idle, disk, hot, cleaned))
        made = pd.DataFrame(out, columns=["host", "ts", "seq", "cpu_pct", "disk_delta", "hot", "stop", "hygiene"])
        yield made.astype({"disk_delta": "Int64", "cpu_pct": float})

    def close(self) -> None:
        pass


def readings(samples: DataFrame, limit: float, needed: int, hygiene_seconds: float = 21600) -> DataFrame:
    """A row a sample (``host, ts, seq, total, idle, disk, temp``) with what
    follows from those before it: the CPU percentage since the last totals, the
    change of the disk since its last known use, the number of temperatures in
    a row that reached ``limit``, ``stop`` at each ``needed``-th of them (the
    count then begins anew; a missing temperature changes nothing), and
    ``hygiene`` on the first sample and once ``hygiene_seconds`` have passed.

    The state is five numbers a host. Samples of a micro-batch are taken in the
    order of time; those that come after newer ones count when they come.
    """
    return samples.groupBy("host").transformWithStateInPandas(_Readings(limit, needed, hygiene_seconds), READINGS, "append", "none")


class _Bursts(StatefulProcessor):
    def __init__(self, plan: Sampling) -> None:
        self.plan = plan

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sampler", "due long, until long, next long, reasons string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = state = SamplerState(*self.state.get()) if self.state.exists() else SamplerState()
        out = []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            state, taken = sample(state, r.ts.value // 1000, r.reasons, self.plan)
            out += taken
        if before.until != state.until:
            if before.until is not None:
                self.handle.deleteTimer(-(-before.until // 1000))
            if state.until is not None:
                self.handle.registerTimer(-(-state.until // 1000))
        self.state.update(tuple(state))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = SamplerState(*self.state.get())
        self.state.update(tuple(SamplerState(state.due)))
        yield self._frame(key, [(state.until, "closed", state.reasons)])

    @staticmethod
    def _frame(key: tuple, taken: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame([(key[0], *x) for x in taken], columns=["host", "ts", "kind", "reasons"])
        return made.assign(ts=pd.to_datetime(made["ts"].astype("int64"), unit="us"))

    def close(self) -> None:
        pass


def burst_samples(samples: DataFrame, limits: dict[str, float], plan: Sampling = Sampling(), late: str = "0 seconds") -> DataFrame:
    """``host, ts, kind, reasons`` as ``operators.monitor.burst_samples``: an
    alert opens a window of denser samples. A reading after its end closes the
    window; where none comes, a timer does once the watermark passes."""
    rows = samples.select("host", "ts", "seq", F.array_join(alert_reasons(limits), ";").alias("reasons")).withWatermark("ts", late)
    return rows.groupBy("host").transformWithStateInPandas(_Bursts(plan), SAMPLES, "append", "eventTime")
