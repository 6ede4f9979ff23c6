"""Readers, writers and streams over files of this run."""

import datetime as dt
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files
from tidewell.streaming import monitor as W


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_json_lines(spark, tmp_path):
    put(tmp_path, "a.jsonl", '{"a": 1}\n\n{"a": 2}\nnot json\n{"a": 3}\n')
    put(tmp_path, "good.jsonl", '{"a": 1}\n\n{"a": 2}\n')
    rows = files.read_jsonl_lenient(spark, str(tmp_path / "a.jsonl"), "a long")
    assert sorted(r["a"] for r in rows.collect()) == [1, 2, 3]
    assert [tuple(r) for r in files.page(rows, ["a"], 1, 1).collect()] == [(2, 3)]
    assert [r["a"] for r in files.tail(rows, "a", 2).collect()] == [2, 3]
    assert files.read_jsonl_strict(spark, str(tmp_path / "good.jsonl"), "a long").count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl_strict(spark, str(tmp_path / "a.jsonl"), "a long").collect()


def test_series_files(spark, tmp_path):
    put(tmp_path, "s.csv", "DATE,VALUE\n2020-01-02,2.5\n2020-01-01,.\n2020-01-03,\n2020-01-04,inf\n2020-01-05,1\n")
    found = files.read_csv_series(spark, str(tmp_path / "s.csv"), "DATE").orderBy("ts").collect()
    assert [(r["ts"].day, r["value"]) for r in found] == [(2, 2.5), (5, 1.0)]
    body = {"chart": {"result": [{"timestamp": [0, 86400, 172800], "indicators": {"quote": [{"close": [1.0, None, 3.0]}]}}]}}
    chart = files.chart_series(spark.createDataFrame([(json.dumps(body),)], "body string")).orderBy("ts").collect()
    assert [tuple(r) for r in chart] == [(dt.date(1970, 1, 1), 1.0), (dt.date(1970, 1, 3), 3.0)]


def test_folders(spark, tmp_path):
    put(tmp_path, "d/a.md", "# a")
    put(tmp_path, "d/sub/b.md", "# b")
    put(tmp_path, "d/sub/skip.md", "x")
    put(tmp_path, "d/c.txt", "c")
    put(tmp_path, "d/large.md", "y" * 100)
    found = files.read_documents(spark, str(tmp_path / "d"), ["*.md"], ["*skip*"], 50).collect()
    assert sorted((r["path"], r["text"]) for r in found) == [("a.md", "# a"), ("sub/b.md", "# b")]
    put(tmp_path, "t/chan/1_transcripts/2025-01-01_v1.txt", "text")
    put(tmp_path, "t/chan/1_transcripts/meta/v1.json", '{"published_at": "2025-01-01T00:00:00Z"}')
    put(tmp_path, "t/chan/1_transcripts/notes.md", "no")
    (row,) = files.read_transcripts(spark, str(tmp_path / "t")).collect()
    assert (row["channel"], row["video"], row["published"]) == ("chan", "v1", dt.date(2025, 1, 1))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    for _ in range(2):
        files.write_jsonl(df, str(tmp_path / "j"), append=True)
    files.write_csv(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).collect()[0]["v"] == "a"


def run_stream(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_alert_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    values = [[9.0, 9.0, None, 9.0], [9.0, 1.0, 9.0], [9.0, 9.0]]
    at = 0
    for k, part in enumerate(values):  # a file is a micro-batch
        rows = [(1, t0 + dt.timedelta(minutes=at + i), at + i, v) for i, v in enumerate(part)]
        at += len(part)
        spark.createDataFrame(rows, "host long, ts timestamp, seq long, value double").coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        name = next(x for x in os.listdir(tmp_path / f"p{k}") if x.endswith(".parquet"))
        shutil.move(tmp_path / f"p{k}" / name, tmp_path / "in" / f"{k}.parquet")
    source = spark.readStream.schema("host long, ts timestamp, seq long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    fired = run_stream(W.consecutive_breaches(source, 5.0, 3), "fired")
    assert sorted((r["ts"].minute, r["consecutive"]) for r in fired) == [(3, 3), (8, 3)]
    found = run_stream(W.alerts(source, {"value": 9.0}).select("seq", "reasons"), "alerted")
    assert {tuple(r["reasons"]) for r in found} == {("value>=9",)} and len(found) == 7
    keyed = source.select("ts", F.lit("k").alias("key"), "value")
    counts = run_stream(W.windowed_counts(keyed, "5 minutes", "1 minute"), "counts")
    assert [(r["n"], r["total"]) for r in counts] == [(5, 36.0)]
    assert run_stream(W.sessions(keyed, "1 minute", "1 minute"), "sessions") == []
