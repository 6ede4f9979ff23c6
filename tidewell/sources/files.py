"""Readers and writers: JSON lines, CSV and chart series, text folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.text import channel_of, glob_match, video_id

BAD = "_corrupt_record"


def read_jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a bad one fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and those that are no JSON objects are left
    out. Lines are read as text, so that counts need no special care."""
    made = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    rows = spark.read.text(path).where(F.trim("value") != "").select(made.alias("x"))
    return rows.where(F.col("x").isNotNull() & F.col(f"x.{BAD}").isNull()).select("x.*").drop(BAD)


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, with ``total`` rows."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows in order."""
    return df.orderBy(F.desc(order)).limit(n).orderBy(order)


def read_csv_series(spark: SparkSession, path: str, date_column: str, value_column: str | None = None) -> DataFrame:
    """``ts, value`` of a CSV with a header; without a value column given, the
    second is taken. ``.``, blanks and numbers that aren't finite are dropped."""
    rows = spark.read.option("header", True).csv(path)
    name = value_column or next(c for c in rows.columns if c != date_column)
    value = F.expr(f"try_cast(nullif(trim(`{name}`), '.') AS double)")
    rows = rows.select(F.expr(f"try_cast(`{date_column}` AS date)").alias("ts"), value.alias("value"))
    return rows.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


CHART = "struct<chart:struct<result:array<struct<timestamp:array<long>,indicators:struct<quote:array<struct<close:array<double>>>>>>>>"


def chart_series(df: DataFrame, body: str = "body") -> DataFrame:
    """``ts, value`` of chart documents: times and closes stand side by side;
    closes that are null are dropped."""
    rows = df.select(F.from_json(body, CHART).alias("c")).select(F.explode("c.chart.result").alias("r"))
    both = F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.quote")[0]["close"].alias("x"))
    rows = rows.select(F.explode(both).alias("p")).select(F.timestamp_seconds("p.t").cast("date").alias("ts"), F.col("p.x").alias("value"))
    return rows.where("ts IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < double('infinity')")


def read_documents(spark: SparkSession, path: str, include: list[str], exclude: list[str], most_bytes: int = 1_000_000) -> DataFrame:
    """``path, text, modified`` of files below a folder that the shell
    patterns include and that hold at most ``most_bytes``."""
    root = F.lit(path.rstrip("/") + "/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    local = F.regexp_replace(F.col("path"), "^file:/*", "/")
    rows = rows.where(F.col("length") <= most_bytes).withColumn("rel", F.substr(local, F.length(root) + 1))
    return rows.where(glob_match(F.col("rel"), include, exclude)).select(F.col("rel").alias("path"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """``channel, video, path, published`` of transcript files, in the layout
    ``channel/1_transcripts/[date_]id.txt``; sidecars ``id.json`` may give
    ``published_at``. Files without an id are left out; of one video in one
    channel the smallest path counts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    name = F.substring_index("path", "/", -1)
    folder = F.regexp_extract("path", r"/([^/]+)/1_transcripts/", 1)
    texts = files.where(F.col("path").endswith(".txt")).select(channel_of(folder).alias("channel"), video_id(name).alias("video"), "path")
    texts = texts.where("video IS NOT NULL").groupBy("channel", "video").agg(F.min("path").alias("path"))
    day = F.get_json_object(F.col("content").cast("string"), "$.published_at")
    side = files.where(F.col("path").endswith(".json")).select(F.regexp_replace(name, r"\.json$", "").alias("video"), F.to_date(F.substring(day, 1, 10)).alias("published"))
    return texts.join(side.groupBy("video").agg(F.max("published").alias("published")), "video", "left").select("channel", "video", "path", "published")


def last_bytes(df: DataFrame, order: str, most: int) -> DataFrame:
    """The last rows in order that fit into ``most`` bytes as JSON lines; a row
    that fits only in part is left out with all before it. Few rows are looked
    at: a line has three bytes at least."""
    line = F.to_json(F.struct("*"))
    near = df.withColumn("line", line).orderBy(F.desc(order)).limit(max(1, most // 3))
    held = F.sum(F.octet_length("line") + 1).over(Window.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("held", held).where(F.col("held") <= most).drop("line", "held")


def append_ring(df: DataFrame, path: str, order: str, most: int) -> None:
    """JSON lines below ``path`` of at most ``most`` bytes: the last of those
    there and of ``df``. The new file is written beside the old one and then
    takes its place."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = files.exists(at(path))
    every = spark.read.schema(df.schema).json(path).unionByName(df) if there else df
    last_bytes(every, order, most).coalesce(1).write.mode("overwrite").json(f"{path}.next")
    if there:
        files.delete(at(path), True)
    if not files.rename(at(f"{path}.next"), at(path)):
        raise OSError(f"{path} could not be replaced")


def newest_first(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, newest first."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("n") <= most).drop("n")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; readers see all of a write or nothing."""
    df.write.mode("append" if append else "overwrite").json(path)
