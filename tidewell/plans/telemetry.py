"""Telemetry queries beyond single readings: bursts and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import monitor as M
from tidewell.plans.tables import table

PLAN = M.Sampling(interval=864000, burst=432000, every=86400)  # ten days, five days, a day
LIMIT = 60.0


def monitor_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings of their user: samples, and bursts after alerts."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("seq"), "value")
    found = M.burst_samples(rows, {"value": LIMIT}, PLAN)
    return found.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def monitor_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as container readings, two numbers each for time before and now."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") + F.col("l_suppkey")).alias("used"), F.col("l_suppkey").alias("used_before"),
        F.floor("l_extendedprice").alias("system"), (F.floor("l_quantity") * 1000).alias("system_before"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")).alias("cpus"),
    )
    return M.container_percent(rows).select("l_orderkey", "l_linenumber", "cpu_pct")


QUERIES = {"monitor_bursts": monitor_bursts, "monitor_containers": monitor_containers}

_STEP = {k: round(x * 1e6) for k, x in PLAN._asdict().items()}
ORACLES = {
    "monitor_bursts": f"""WITH RECURSIVE r AS (SELECT user_id AS host, epoch_us(ts) AS tm, CASE WHEN value >= {LIMIT} THEN 'value>={LIMIT:g}' END AS why, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
m AS (SELECT host, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS tm, CAST(NULL AS BIGINT) AS due, CAST(NULL AS BIGINT) AS till, CAST(NULL AS BIGINT) AS nxt, CAST(NULL AS VARCHAR) AS why, false AS taken, false AS burst, CAST(NULL AS BIGINT) AS shut, CAST(NULL AS VARCHAR) AS shut_why FROM (SELECT DISTINCT host FROM r) UNION ALL
  SELECT host, rn, tm, CASE WHEN opens THEN tm + {_STEP["burst"] + _STEP["interval"]} WHEN taken THEN tm + {_STEP["interval"]} ELSE due END, CASE WHEN opens THEN tm + {_STEP["burst"]} WHEN inside THEN till END, CASE WHEN opens OR again THEN tm + {_STEP["every"]} WHEN inside THEN nxt END,
    CASE WHEN opens THEN new WHEN inside THEN old END, taken, opens OR again, CASE WHEN NOT inside THEN till END, old
  FROM (SELECT *, taken AND new IS NOT NULL AS opens FROM (SELECT *, NOT inside AND (due IS NULL OR tm >= due) AS taken, inside AND tm >= nxt AS again FROM (SELECT m.host, r.rn, r.tm, m.due, m.till, m.nxt, r.why AS new, m.why AS old, coalesce(r.tm < m.till, false) AS inside FROM m JOIN r ON r.host = m.host AND r.rn = m.rn + 1)))),
x AS (SELECT m.host, m.tm, 'sample' AS kind, r.why AS reasons FROM m JOIN r ON r.host = m.host AND r.rn = m.rn WHERE taken UNION ALL SELECT host, tm, 'burst', why FROM m WHERE burst UNION ALL SELECT host, shut, 'closed', shut_why FROM m WHERE shut IS NOT NULL
  UNION ALL SELECT host, till, 'closed', why FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rn DESC) AS back FROM m) WHERE back = 1 AND till IS NOT NULL)
SELECT host, strftime(make_timestamp(tm), '%Y-%m-%d %H:%M:%S') AS ts, kind, reasons FROM x""",
    "monitor_containers": """SELECT l_orderkey, l_linenumber, CASE WHEN floor(l_extendedprice) - floor(l_quantity) * 1000 > 0 THEN round(CAST(l_partkey AS DOUBLE) / (floor(l_extendedprice) - floor(l_quantity) * 1000) * l_linenumber * 100, 2) ELSE 0 END AS cpu_pct FROM lineitem""",
}
