"""Dates and times, all in UTC; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted forms besides ISO.
FORMATS = ("yyyy-MM-dd HH:mm 'UTC'", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def parse_utc(text: Column) -> Column:
    """ISO with ``Z``, offset or none (UTC), or one of four forms; else null."""
    t = F.trim(text)
    iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d{2}-\d{2}T")), F.try_to_timestamp(t))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])


def published_date(text: Column) -> Column:
    """The part before ``T``, else the first ten characters."""
    return F.when(F.contains(text, F.lit("T")), F.substring_index(text, "T", 1)).otherwise(F.substring(text, 1, 10))


def age_days(now: Column, day: Column) -> Column:
    return F.datediff(now, day)


def minutes_seconds(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def epoch_date(seconds: Column) -> Column:
    return F.to_date(F.timestamp_seconds(seconds))


def day_text(day: Column) -> Column:
    """``yyyy-MM-dd``; years of five digits and more without Spark's sign."""
    return F.ltrim(day.cast("string"), F.lit("+"))


def utc_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm 'UTC'")


def zone_label(ts: Column, zone: str = "Europe/Vienna") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")
