"""Driver tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.dates import day_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded and dates as text, so that results compare exactly."""
    cols = {c: F.round(c, places) for c, kind in df.dtypes if kind == "double"}
    return df.withColumns(cols | {c: day_text(F.col(c)) for c, kind in df.dtypes if kind == "date"})


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals per day and priority, as series."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("value"))


DAILY = "s AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL)"


def symbol(props: Column) -> Column:
    return F.get_json_object(props, "$.k")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mentions; every seventh has no symbol."""
    s = F.when(F.col("event_id") % 7 != 0, symbol(F.col("props")))
    label = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("Name ("), s, F.lit(")"))).otherwise(F.concat(F.lit("Alias "), s))
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), F.col("user_id").alias("video"), s.alias("symbol"), label.alias("label"), F.to_date("ts").alias("published"))


MENTIONS = """m AS (SELECT event_type AS channel, user_id AS video, CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END AS symbol,
  CASE WHEN user_id % 2 = 0 THEN 'Name (' || CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END || ')' ELSE 'Alias ' || CASE WHEN event_id % 7 <> 0 THEN json_extract_string(props, '$.k') END END AS label,
  CAST(ts AS DATE) AS published FROM events)"""
