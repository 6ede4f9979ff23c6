"""Arrow batches that Python holds: their size, and what is made of them."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while."""
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def arrow_batches(spark: SparkSession, size: str = "8m", rows: int = 2000) -> contextlib.AbstractContextManager[None]:
    """Smaller Arrow batches while tables are written: an executor holds
    several copies of a batch for each of its tasks."""
    return settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": size, "spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def slices(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``size`` bytes, one row at least:
    only a slice is ever held as Python objects."""
    rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
