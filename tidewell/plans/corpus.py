"""Corpus analytics: mentions from events, coverage from documents, routing
from orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import stats
from tidewell.operators import corpus as C
from tidewell.plans.tables import MENTIONS, mentions, rounded, table

NOW, LATER, EARLIER = "2024-02-20", "2001-08-02", "2001-07-28"


def _date(day: str) -> Column:
    return F.to_date(F.lit(day))


def mention_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_by_channel(mentions(spark, sf_dir))


def mention_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_by_symbol(mentions(spark, sf_dir))


def mention_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_by_symbol(mentions(spark, sf_dir), unresolved=True)


def mention_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_global(mentions(spark, sf_dir))


def mention_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_grouped(mentions(spark, sf_dir)).withColumn("level", F.col("level").cast("int"))


def mention_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preferred_labels(mentions(spark, sf_dir)).withColumn("labels", F.array_join("labels", "|"))


def mention_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions_by_symbol(mentions(spark, sf_dir)).orderBy(F.desc("mention_count"), "symbol").limit(20)


def mention_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.recent_windows(mentions(spark, sf_dir), _date(NOW)))


def mention_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent windows of mentions whose dates come from the index: of each
    video the last event's day, none for every fifth."""
    found = mentions(spark, sf_dir)
    day = F.when(F.col("event_id") % 5 != 0, F.to_date("ts"))
    index = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), day.alias("published"), F.col("event_id").alias("seq"))
    return rounded(C.recent_windows(C.with_dates(found, index), _date(NOW)))


def mention_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mentions(spark, sf_dir).where("symbol IS NOT NULL")
    return C.fingerprint(rows, "channel", F.concat_ws(":", F.col("video").cast("string"), "symbol"))


def payload_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions out of JSON payloads: strings, objects and stocks."""
    rows = mentions(spark, sf_dir).where("symbol IS NOT NULL")
    body = F.concat(F.lit('{"knowledge_items":[{"text":"t","entities":["'), "symbol", F.lit('",{"symbol":"O'), "symbol", F.lit('"}]}],"stocks_covered":[{"canonical":"S'), "symbol", F.lit('"}]}'))
    made = C.explode_mentions(rows.select("channel", "video", body.alias("payload")))
    return made.groupBy("channel", "symbol").agg(F.count(F.lit(1)).alias("n"))


def _documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("channel"), F.col("doc_id").alias("video"))
    done = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video")), "video", "left_semi")
    return docs, done.select("channel", "video")


def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.coverage_gaps(*_documents(spark, sf_dir))
    return found.select("channel", F.size("missing").alias("n"), F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


def channel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = _documents(spark, sf_dir)
    return C.channel_report(docs, done, mentions(spark, sf_dir))


def quality_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, _ = _documents(spark, sf_dir)
    grade = F.when(F.col("quality") == 1, "ok").otherwise("low")
    return C.quality_breakdown(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video"), grade.alias("grade")))


def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = mentions(spark, sf_dir).select("channel", "video", "published")
    return rounded(C.freshness(index, _date(NOW)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("video"), when.alias("published"))


def lifecycle_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route(_items(spark, sf_dir), F.to_timestamp(F.lit(LATER))).select("channel", "video", "tier")


def lifecycle_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, before = (C.route(_items(spark, sf_dir), F.to_timestamp(F.lit(t))).where("tier IN ('new', 'archive')") for t in (LATER, EARLIER))
    return C.reconcile(now, before).groupBy("action", "want", "have").agg(F.count(F.lit(1)).alias("n"))


def newest_per_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.top_n(_items(spark, sf_dir).where("published IS NOT NULL"), ["channel"], [F.desc("published"), F.desc("video")], 3).select("channel", "video", "place")


def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.keep_newest(_items(spark, sf_dir), "channel", "published", "video").select("channel", "video")


def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.first_seen(mentions(spark, sf_dir).where("symbol IS NOT NULL"), "symbol", "video").select("symbol", "video")


def progress_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = _documents(spark, sf_dir)
    files = docs.where("video % 10 <> 3")
    progress = docs.where("video % 10 <> 5")
    return C.progress_sync(files, progress, done.where("video % 2 = 0"))


def upload_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("name"), F.sha2("text", 256).alias("sha256"))
    known = docs.where("doc_id % 9 = 0").select(F.sha2("text", 256).alias("sha256"), F.concat(F.lit("k"), F.col("doc_id")).alias("name"))
    return C.upload_plan(files, known)


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source, documents until the running token count passes a budget."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.floor(F.length("text") / 4).alias("tokens"))
    return C.within_budget(docs, "source", [F.col("doc_id")], F.col("tokens"), 20_000).select("source", "doc_id", "running")


def freshness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video"))
    text = F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_orderkey") % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    meta = table(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("video"), text.alias("published_at"))
    return C.freshness_check(docs, meta, F.to_date(F.lit("1998-01-01")))


def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").cast("string").alias("name"))
    return C.collisions(docs, "sha256", "name").withColumn("names", F.array_join("names", ","))


def timing_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rounded(rows.agg(stats.quantile(F.col("value"), 0.5).alias("p50"), stats.quantile(F.col("value"), 0.95).alias("p95"), stats.nearest_rank(F.collect_list("value"), 95).alias("rank95"), stats.circular_length(F.col("value")).alias("locking"), stats.share(F.col("value") > 50).alias("over")))


_COUNTS = "count(*) AS mention_count, count(DISTINCT (channel, video)) AS video_count, count(DISTINCT channel) AS creator_count"
_DOCS = "t AS (SELECT source AS channel, doc_id AS video FROM documents), u AS (SELECT * FROM t WHERE video IN (SELECT doc_id FROM labels))"
_ITEMS = "i AS (SELECT o_custkey AS channel, o_orderkey AS video, CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS published FROM orders)"


def _routed(name: str, now: str) -> str:
    return f"""{name} AS (SELECT channel, video, CASE WHEN published IS NULL THEN 'none' WHEN row_number() OVER (PARTITION BY channel ORDER BY published DESC NULLS LAST, video DESC) <= 2 THEN 'new'
  WHEN (epoch(TIMESTAMP '{now}') - epoch(published)) / 86400 <= 15 THEN 'archive' ELSE 'drop' END AS tier FROM i)"""


QUERIES = {
    f.__name__: f
    for f in (mention_channels, mention_symbols, mention_unresolved, mention_total, mention_grouping_sets, mention_labels, mention_top, mention_recent, mention_dated, mention_fingerprint, payload_mentions, coverage_gaps, channel_report, quality_breakdown, index_freshness, lifecycle_route, lifecycle_reconcile, newest_per_channel, keep_newest, first_seen, progress_sync, upload_plan, token_budget, freshness_check, name_collisions, timing_quantiles)
}
ORACLES = {
    "mention_channels": f"WITH {MENTIONS} SELECT channel, {_COUNTS} FROM m GROUP BY channel",
    "mention_symbols": f"WITH {MENTIONS} SELECT symbol, {_COUNTS} FROM m WHERE symbol IS NOT NULL GROUP BY symbol",
    "mention_unresolved": f"WITH {MENTIONS}, n AS (SELECT channel, video, coalesce(nullif(symbol, ''), '__UNRESOLVED__') AS symbol FROM m) SELECT symbol, {_COUNTS} FROM n GROUP BY symbol",
    "mention_total": f"WITH {MENTIONS} SELECT {_COUNTS} FROM m WHERE symbol IS NOT NULL",
    "mention_grouping_sets": f"WITH {MENTIONS} SELECT symbol, channel, CAST(grouping(symbol, channel) AS INTEGER) AS level, {_COUNTS} FROM m GROUP BY GROUPING SETS ((symbol), (channel), ())",
    "mention_labels": f"""WITH {MENTIONS}, l AS (SELECT symbol, list_sort(list(DISTINCT label)) AS ls FROM m WHERE symbol IS NOT NULL AND label IS NOT NULL GROUP BY symbol)
SELECT symbol, array_to_string(ls, '|') AS labels, coalesce(list_filter(ls, lambda x: ends_with(x, '(' || symbol || ')'))[1], ls[1]) AS preferred FROM l""",
    "mention_top": f"WITH {MENTIONS} SELECT symbol, {_COUNTS} FROM m WHERE symbol IS NOT NULL GROUP BY symbol ORDER BY mention_count DESC, symbol LIMIT 20",
    "mention_recent": f"WITH {MENTIONS}, a AS (SELECT *, date_diff('day', published, DATE '2024-02-20') AS age FROM m) SELECT symbol, "
    + ", ".join(f"count(*) FILTER (WHERE age <= {d}) AS mentions_{d}, count(DISTINCT CASE WHEN age <= {d} THEN video END) AS videos_{d}, count(DISTINCT CASE WHEN age <= {d} THEN channel END) AS channels_{d}" for d in (30, 60, 90))
    + ", CAST(max(published) AS VARCHAR) AS last_date, CAST(min(age) AS INTEGER) AS days_since, min(age) > 90 AS stale FROM a GROUP BY symbol",
    "mention_dated": f"""WITH {MENTIONS}, x AS (SELECT user_id AS video, CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS published, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
a AS (SELECT m.symbol, m.video, m.channel, x.published, date_diff('day', x.published, DATE '2024-02-20') AS age FROM m JOIN x ON x.video = m.video AND back = 1 AND x.published IS NOT NULL) SELECT symbol, """
    + ", ".join(f"count(*) FILTER (WHERE age <= {d}) AS mentions_{d}, count(DISTINCT CASE WHEN age <= {d} THEN video END) AS videos_{d}, count(DISTINCT CASE WHEN age <= {d} THEN channel END) AS channels_{d}" for d in (30, 60, 90))
    + ", CAST(max(published) AS VARCHAR) AS last_date, CAST(min(age) AS INTEGER) AS days_since, min(age) > 90 AS stale FROM a GROUP BY symbol",
    "mention_fingerprint": f"WITH {MENTIONS} SELECT channel, sha256(string_agg(video || ':' || symbol, chr(10) ORDER BY video || ':' || symbol)) AS fingerprint FROM m WHERE symbol IS NOT NULL GROUP BY channel",
    "payload_mentions": f"WITH {MENTIONS}, e AS (SELECT channel, unnest([symbol, 'O' || symbol, 'S' || symbol]) AS symbol FROM m WHERE symbol IS NOT NULL) SELECT channel, symbol, count(*) AS n FROM e GROUP BY ALL",
    "coverage_gaps": f"WITH {_DOCS}, g AS (SELECT * FROM t EXCEPT SELECT * FROM u) SELECT channel, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(video AS VARCHAR), ',' ORDER BY video) AS missing FROM g GROUP BY channel",
    "channel_report": f"""WITH {MENTIONS}, {_DOCS}, a AS (SELECT channel, count(DISTINCT video) AS x FROM t GROUP BY 1), b AS (SELECT channel, count(DISTINCT video) AS y FROM u GROUP BY 1), c AS (SELECT channel, {_COUNTS} FROM m GROUP BY 1)
SELECT channel, coalesce(x, 0) AS transcript_count, coalesce(y, 0) AS summary_count, coalesce(mention_count, 0) AS mention_count, coalesce(video_count, 0) AS video_count, coalesce(creator_count, 1) AS creator_count FROM a FULL JOIN b USING (channel) FULL JOIN c USING (channel)""",
    "quality_breakdown": "SELECT source AS channel, CASE WHEN quality = 1 THEN 'ok' WHEN l.doc_id IS NOT NULL THEN 'low' ELSE 'unknown' END AS grade, count(DISTINCT d.doc_id) AS videos FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY ALL",
    "index_freshness": f"WITH {MENTIONS}, a AS (SELECT *, date_diff('day', published, DATE '2024-02-20') AS age FROM m) SELECT channel, CAST(median(age) AS DOUBLE) AS median_age, " + ", ".join(f"round(100 * avg(CASE WHEN age < {d} THEN 1.0 ELSE 0.0 END), 2) AS pct_under_{d}" for d in (30, 60, 90)) + ", CAST(min(published) AS VARCHAR) AS first_date, CAST(max(published) AS VARCHAR) AS last_date FROM a GROUP BY channel",
    "lifecycle_route": f"WITH {_ITEMS}, {_routed('r', '2001-08-02')} SELECT * FROM r",
    "lifecycle_reconcile": f"""WITH {_ITEMS}, {_routed("r", "2001-08-02")}, {_routed("p", "2001-07-28")}, j AS (SELECT a.tier AS want, b.tier AS have FROM (SELECT * FROM r WHERE tier IN ('new', 'archive')) a FULL JOIN (SELECT * FROM p WHERE tier IN ('new', 'archive')) b ON a.video = b.video)
SELECT CASE WHEN want IS NULL THEN 'remove' WHEN have IS NULL THEN 'add' WHEN want <> have THEN 'move' ELSE 'keep' END AS action, want, have, count(*) AS n FROM j GROUP BY ALL""",
    "newest_per_channel": f"WITH {_ITEMS}, r AS (SELECT channel, video, row_number() OVER (PARTITION BY channel ORDER BY published DESC, video DESC) AS place FROM i WHERE published IS NOT NULL) SELECT * FROM r WHERE place <= 3",
    "keep_newest": f"WITH {_ITEMS}, r AS (SELECT channel, video, row_number() OVER (PARTITION BY channel ORDER BY published DESC NULLS LAST, video) AS n FROM i) SELECT channel, video FROM r WHERE n = 1",
    "first_seen": f"WITH {MENTIONS} SELECT symbol, min(video) AS video FROM m WHERE symbol IS NOT NULL GROUP BY symbol",
    "progress_sync": f"""WITH {_DOCS}, j AS (SELECT video, video % 10 <> 3 AS f, video % 10 <> 5 AS p, video % 2 = 0 AND video IN (SELECT video FROM u) AS s FROM (SELECT DISTINCT video FROM t))
SELECT video, CASE WHEN NOT p THEN 'add' ELSE 'remove' END AS change FROM j WHERE (f AND NOT p) OR (p AND NOT f AND NOT s)""",
    "upload_plan": """WITH f AS (SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, sha256(text) AS sha256, doc_id FROM documents), k AS (SELECT DISTINCT sha256 AS h FROM f WHERE doc_id % 9 = 0)
SELECT name, sha256, CASE WHEN row_number() OVER (PARTITION BY sha256 ORDER BY name) > 1 OR h IS NOT NULL THEN 'skip' ELSE 'upload' END AS action FROM f LEFT JOIN k ON h = sha256""",
    "token_budget": "WITH d AS (SELECT source, doc_id, CAST(sum(length(text) // 4) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) SELECT * FROM d WHERE running <= 20000",
    "freshness_check": """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders WHERE o_orderkey % 5 <> 0),
o AS (SELECT CASE WHEN k IS NULL THEN 'missing_meta' WHEN d = '' THEN 'missing_date' WHEN try_cast(d AS DATE) IS NULL THEN 'parse_error' WHEN try_cast(d AS DATE) < DATE '1998-01-01' THEN 'stale' ELSE 'fresh' END AS outcome FROM documents LEFT JOIN p ON k = doc_id)
SELECT outcome, count(*) AS videos FROM o GROUP BY outcome""",
    "name_collisions": "SELECT sha256(text) AS sha256, string_agg(DISTINCT CAST(doc_id AS VARCHAR), ',' ORDER BY CAST(doc_id AS VARCHAR)) AS names FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1",
    "timing_quantiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[CAST(round_even(0.95 * (count(value) - 1), 0) AS INTEGER) + 1], 6) AS rank95, round(sqrt(avg(cos(value)) ** 2 + avg(sin(value)) ** 2), 6) AS locking, round(100 * avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 2) AS over FROM events GROUP BY event_type",
}
