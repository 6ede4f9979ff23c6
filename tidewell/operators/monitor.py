"""Telemetry: deltas, alerts with reasons, runs of breaches, log pairing.

Samples have ``host, ts, seq`` and readings; ``seq`` breaks ties of ``ts``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_host() -> WindowSpec:
    return Window.partitionBy("host").orderBy("ts", "seq")


def cpu_percent(samples: DataFrame, total: str = "total", idle: str = "idle") -> DataFrame:
    """``cpu_pct`` from running totals (whole numbers): 100 (1 - idle / total)
    of the deltas, the total's at least 1, idle's at least 0; null for a host's
    first. Two places, halves up, worked out in whole numbers."""
    d_total = F.greatest(F.col(total) - F.lag(total).over(by_host()), F.lit(1))
    d_idle = F.greatest(F.col(idle) - F.lag(idle).over(by_host()), F.lit(0))
    d_total, d_idle = d_total.cast("decimal(20,0)"), d_idle.cast("decimal(20,0)")
    known = F.lag(total).over(by_host()).isNotNull() & F.col(total).isNotNull()
    return samples.withColumn("cpu_pct", F.when(known, F.floor(((d_total - d_idle) * 20000 + d_total) / (2 * d_total)) / 100))


def delta(samples: DataFrame, reading: str, name: str) -> DataFrame:
    """Difference to the last known reading of the host."""
    before = F.last(reading, ignorenulls=True).over(by_host().rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn(name, F.col(reading) - before)


def alert_reasons(limits: dict[str, float]) -> Column:
    """Array of ``reading>=limit``, in the order given, of what is reached."""
    return F.array_compact(F.array(*[F.when(F.col(k) >= v, F.lit(f"{k}>={v:g}")) for k, v in limits.items()]))


def alerts(samples: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Rows that reach any limit, with ``reasons``; works on streams too."""
    return samples.withColumn("reasons", alert_reasons(limits)).where(F.size("reasons") > 0)


def breach_runs(samples: DataFrame, reading: str, limit: float, needed: int) -> DataFrame:
    """Readings with their place in the running breach, and ``fired`` at each
    ``needed``-th, after which the count begins anew. Rows without a reading
    are left out, so they change no count."""
    rows = samples.where(F.col(reading).isNotNull()).withColumn("breach", F.col(reading) >= limit)
    run = F.sum((~F.col("breach")).cast("int")).over(by_host().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("run", run)
    place = F.sum(F.col("breach").cast("int")).over(Window.partitionBy("host", "run").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("place", place).drop("run")
    return rows.withColumn("consecutive", F.when(F.col("breach"), (F.col("place") - 1) % needed + 1).otherwise(0)).withColumn("fired", F.col("consecutive") == needed).drop("place")


def container_percent(stats: DataFrame) -> DataFrame:
    """``cpu_pct`` of containers from their own readings and those before
    (``used, used_before, system, system_before, cpus``): the container's share
    of the system's time, times its CPUs (1 where unknown), to two places; 0
    where the system's time did not move."""
    used, system = F.col("used") - F.col("used_before"), F.col("system") - F.col("system_before")
    cpus = F.greatest(F.coalesce("cpus", F.lit(0)), F.lit(1))
    return stats.withColumn("cpu_pct", F.when(system > 0, F.round(used.cast("double") / system * cpus * 100, 2)).otherwise(0.0))


class Sampling(NamedTuple):
    """Seconds: between samples, length of a burst, between its samples."""

    interval: float = 900
    burst: float = 20
    every: float = 2


class SamplerState(NamedTuple):
    """Microseconds: when the next sample is due, until when a burst lasts,
    when its next sample is due; and what set it off."""

    due: int | None = None
    until: int | None = None
    next: int | None = None
    reasons: str | None = None


Taken = list[tuple[int, str, str | None]]  # time, kind, reasons


def sample(state: SamplerState, at: int, reasons: str | None, plan: Sampling) -> tuple[SamplerState, Taken]:
    """What a reading at ``at`` (microseconds) with ``reasons`` (none: "") adds.

    Outside a burst one reading an interval is a ``sample``. One with reasons
    opens a burst, of which it is the first reading; until the burst is over,
    one reading each ``every`` seconds is a ``burst``. Then it is ``closed``,
    at its end, and the next sample is due an interval later.
    """
    step = lambda seconds: round(seconds * 1e6)
    taken: Taken = []
    if state.until is not None and at < state.until:
        if at >= state.next:
            state, taken = state._replace(next=at + step(plan.every)), [(at, "burst", state.reasons)]
        return state, taken
    if state.until is not None:
        taken.append((state.until, "closed", state.reasons))
        state = SamplerState(state.due)
    if state.due is None or at >= state.due:
        taken.append((at, "sample", reasons or None))
        if reasons:
            taken.append((at, "burst", reasons))
            return SamplerState(at + step(plan.burst) + step(plan.interval), at + step(plan.burst), at + step(plan.every), reasons), taken
        state = SamplerState(at + step(plan.interval))
    return state, taken


def burst_samples(samples: DataFrame, limits: dict[str, float], plan: Sampling = Sampling()) -> DataFrame:
    """``host, ts, kind, reasons`` of the readings that are kept (``sample``,
    ``burst``) and the ends of bursts (``closed``). Readings without a time are
    left out. Hosts are read in the order of time with constant memory; the
    stream of the same name gives the same rows."""
    rows = samples.where("ts IS NOT NULL").select("host", F.expr("unix_micros(CAST(ts AS TIMESTAMP))").alias("at"), "seq", F.array_join(alert_reasons(limits), ";").alias("reasons"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, state = None, SamplerState()
        for part in parts:
            out = []
            for own, at, reasons in zip(part["host"].tolist(), part["at"].tolist(), part["reasons"], strict=True):
                if own != host:
                    out += [(host, state.until, "closed", state.reasons)] * (state.until is not None)
                    host, state = own, SamplerState()
                state, taken = sample(state, at, reasons, plan)
                out += [(host, *x) for x in taken]
            yield pd.DataFrame(out, columns=["host", "at", "kind", "reasons"])
        if state.until is not None:
            yield pd.DataFrame([(host, state.until, "closed", state.reasons)], columns=["host", "at", "kind", "reasons"])

    kind = samples.schema["host"].dataType.simpleString()
    ordered = rows.where("host IS NOT NULL").repartition("host").sortWithinPartitions("host", "at", "seq")
    return ordered.mapInPandas(run, f"host {kind}, at long, kind string, reasons string").select("host", F.timestamp_micros("at").alias("ts"), "kind", "reasons")


def pair_starts(log: DataFrame) -> DataFrame:
    """``log, start, end`` of ``log, ts (double), kind`` (start or end): each
    start takes the next end at or after it that no earlier start took.

    An end that finds no start waiting is lost; these are where the running
    sum of starts less ends falls to a new least below zero. Of the others the
    n-th belongs to the n-th start.
    """
    order = Window.partitionBy("log").orderBy("ts", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)  # starts before ends
    is_start = (F.col("kind") == "start").cast("long")
    rows = log.where("kind IN ('start', 'end')").select("log", "ts", "kind", F.sum(is_start).over(order).alias("starts"), F.sum(1 - is_start).over(order).alias("ends"))
    rows = rows.withColumn("waiting", F.col("starts") - F.col("ends")).withColumn("lost", -F.least(F.min("waiting").over(order), F.lit(0)))
    before = F.coalesce(F.lag("lost").over(Window.partitionBy("log").orderBy("ts", F.desc("kind"), "ends")), F.lit(0))
    ends = rows.withColumn("before", before).where("kind = 'end' AND lost = before").select("log", (F.col("ends") - F.col("lost")).alias("n"), F.col("ts").alias("end"))
    starts = rows.where("kind = 'start'").select("log", F.col("starts").alias("n"), F.col("ts").alias("start"))
    return starts.join(ends, ["log", "n"], "left").select("log", "start", "end")


def wait_summary(waits: DataFrame, by: str, seconds: str = "seconds") -> DataFrame:
    """Count, sum, mean, bounds, median and 95th percentile of waits."""
    x = F.col(seconds)
    return waits.groupBy(by).agg(F.count(x).alias("n"), F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"), F.max(x).alias("most"), F.percentile(x, F.lit(0.5)).alias("p50"), F.percentile(x, F.lit(0.95)).alias("p95"))
