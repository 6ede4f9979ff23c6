"""Streams into tables: batches written once each, rows routed by status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.records import retry_route


def write_summaries(stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, name: str = "summaries") -> StreamingQuery:
    """Run ``make`` on each micro-batch and write its rows below ``path``, one
    folder a batch, so a batch that runs again replaces its own rows. Rows
    have a ``status``; what follows from it is the column ``route``. A query
    name runs once a session, so one sync of a topic runs at a time."""

    def write(batch: DataFrame, number: int) -> None:
        made = make(batch)
        made.withColumn("route", retry_route(F.col("status"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
