"""What SQL does not say: streams into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.streaming.summaries import write_summaries


def test_batches_are_written_once_with_their_route(spark, tmp_path):
    rows = [(k, s) for k, s in enumerate(["success", "no_transcript", "blocked", "error"])]
    spark.createDataFrame(rows, "video long, status string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("video long, status string").parquet(str(tmp_path / "in"))
        write_summaries(stream, lambda b: b.withColumn("text", F.concat(F.lit("v"), "video")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    found = sorted((r["video"], r["text"], r["route"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(0, "v0", "done"), (1, "v1", "never"), (2, "v2", "abort"), (3, "v3", "retry")]
