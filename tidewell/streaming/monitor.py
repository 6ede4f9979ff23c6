"""Streams of telemetry: alerts, consecutive breaches, event-time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.operators.monitor import alerts

__all__ = ["alerts", "consecutive_breaches", "windowed_counts", "sessions"]


def consecutive_breaches(samples: DataFrame, limit: float, needed: int) -> DataFrame:
    """``host, ts, value, consecutive`` each time a host's ``value`` has
    reached ``limit`` in ``needed`` readings in a row; the count then begins
    anew. Null readings change nothing. The state is one number a host.

    Rows of a micro-batch count in order of ``ts``; readings that come later
    than a newer one of their host count when they come.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts)).dropna(subset=["value"]).sort_values(["ts", "seq"])
        fired = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            count = count + 1 if value >= limit else 0
            if count >= needed:
                fired.append((key[0], ts, value, count))
                count = 0
        state.update((count,))
        yield pd.DataFrame(fired, columns=["host", "ts", "value", "consecutive"])

    return samples.groupBy("host").applyInPandasWithState(step, "host long, ts timestamp, value double, consecutive int", "count int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Extra: counts and sums by event-time window and key, late rows up to
    ``late``."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "key", "n", "total")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Extra: sessions of a key that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "key", "n")
