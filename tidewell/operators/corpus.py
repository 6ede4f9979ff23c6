"""Corpus analytics: mentions, coverage, freshness, lifecycle, reconciliation.

Mention tables have ``channel, video, symbol, label``; index tables
``channel, video, published`` (date).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNRESOLVED = "__UNRESOLVED__"


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("mention_count"), F.countDistinct("channel", "video").alias("video_count"), F.countDistinct("channel").alias("creator_count")]


def mentions_by_channel(mentions: DataFrame) -> DataFrame:
    """Counts of a channel; unresolved mentions are included."""
    return mentions.groupBy("channel").agg(*_counts())


def mentions_by_symbol(mentions: DataFrame, unresolved: bool = False) -> DataFrame:
    """Counts of a symbol. Without ``unresolved`` null symbols are left out;
    with it, null and empty ones are one key."""
    if not unresolved:
        return mentions.where("symbol IS NOT NULL").groupBy("symbol").agg(*_counts())
    return mentions.withColumn("symbol", F.coalesce(F.nullif("symbol", F.lit("")), F.lit(UNRESOLVED))).groupBy("symbol").agg(*_counts())


def mentions_global(mentions: DataFrame, unresolved: bool = False) -> DataFrame:
    """One row, of zeros for an empty table."""
    return (mentions if unresolved else mentions.where("symbol IS NOT NULL")).agg(*_counts())


def mentions_grouped(mentions: DataFrame) -> DataFrame:
    """The three aggregates in one pass, by grouping sets."""
    return mentions.groupingSets([["symbol"], ["channel"], []], "symbol", "channel").agg(F.grouping_id().alias("level"), *_counts())


def preferred_labels(mentions: DataFrame) -> DataFrame:
    """Sorted labels of a symbol; preferred is the first that ends in
    ``(SYMBOL)``, else the first."""
    rows = mentions.where("symbol IS NOT NULL AND label IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    named = F.filter("labels", lambda x: x.endswith(F.concat(F.lit("("), F.col("symbol"), F.lit(")"))))
    return rows.withColumn("preferred", F.coalesce(F.get(named, F.lit(0)), F.get("labels", F.lit(0))))


def explode_mentions(payloads: DataFrame) -> DataFrame:
    """Mentions of ``channel, video, payload`` (JSON): entities of knowledge
    items, strings or objects with ``symbol``, and covered stocks."""
    schema = "struct<knowledge_items:array<struct<text:string,entities:array<string>>>,stocks_covered:array<struct<canonical:string>>>"
    rows = payloads.select("channel", "video", F.from_json("payload", schema).alias("p"))
    entities = F.flatten(F.transform(F.coalesce("p.knowledge_items", F.array()), lambda x: F.coalesce(x["entities"], F.array())))
    stocks = F.transform(F.coalesce("p.stocks_covered", F.array()), lambda x: x["canonical"])
    found = rows.select("channel", "video", F.explode(F.concat(entities, stocks)).alias("e"))
    symbol = F.when(F.col("e").startswith("{"), F.get_json_object("e", "$.symbol")).otherwise(F.trim("e"))
    return found.select("channel", "video", symbol.alias("symbol")).where("symbol IS NULL OR symbol <> ''")


def coverage_gaps(transcripts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Videos of a channel without a summary, sorted."""
    gone = transcripts.select("channel", "video").distinct().join(summaries.select("channel", "video"), ["channel", "video"], "left_anti")
    return gone.groupBy("channel").agg(F.array_sort(F.collect_list("video")).alias("missing"))


def freshness(index: DataFrame, now: Column) -> DataFrame:
    """Per channel over index rows: median age, percent younger than 30, 60
    and 90 days, first and last date; undated rows are left out."""
    age = F.datediff(now, F.col("published"))
    pct = [F.round(100 * F.avg((age < d).cast("double")), 2).alias(f"pct_under_{d}") for d in (30, 60, 90)]
    return index.where("published IS NOT NULL").groupBy("channel").agg(F.median(age).alias("median_age"), *pct, F.min("published").alias("first_date"), F.max("published").alias("last_date"))


def recent_windows(mentions: DataFrame, now: Column, key: str = "symbol") -> DataFrame:
    """Per key and for ages up to 30, 60 and 90 days: mentions, videos and
    channels; days since the last date and whether that is over 90."""
    age = F.datediff(now, F.col("published"))
    aggs = []
    for d in (30, 60, 90):
        near = age <= d
        aggs += [F.count_if(near).alias(f"mentions_{d}"), F.countDistinct(F.when(near, F.col("video"))).alias(f"videos_{d}"), F.countDistinct(F.when(near, F.col("channel"))).alias(f"channels_{d}")]
    rows = mentions.where("published IS NOT NULL").groupBy(key).agg(*aggs, F.max("published").alias("last_date"))
    return rows.withColumn("days_since", F.datediff(now, F.col("last_date"))).withColumn("stale", F.col("days_since") > 90)


def with_dates(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """``mentions`` with ``published`` from ``index`` (``video, published,
    seq``): of a video's rows the last counts, dated or not; mentions of videos
    without a row have no date."""
    last = index.groupBy("video").agg(F.max_by(F.struct("published"), "seq").alias("last"))
    return mentions.drop("published").join(last, "video", "left").withColumn("published", F.col("last.published")).drop("last")


def quality_breakdown(videos: DataFrame, grades: DataFrame) -> DataFrame:
    """Distinct videos of a channel by grade; none is ``unknown``."""
    rows = videos.select("channel", "video").distinct().join(grades, ["video"], "left")
    return rows.groupBy("channel", F.coalesce("grade", F.lit("unknown")).alias("grade")).agg(F.countDistinct("video").alias("videos"))


def channel_report(transcripts: DataFrame, summaries: DataFrame, mentions: DataFrame) -> DataFrame:
    """All channels of the three tables, zero-filled; creators at least 1."""
    t = transcripts.groupBy("channel").agg(F.countDistinct("video").alias("transcript_count"))
    s = summaries.groupBy("channel").agg(F.countDistinct("video").alias("summary_count"))
    m = mentions_by_channel(mentions)
    rows = t.join(s, "channel", "full").join(m, "channel", "full")
    return rows.select("channel", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("transcript_count", "summary_count", "mention_count", "video_count")], F.coalesce("creator_count", F.lit(1)).alias("creator_count"))


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows of each group in ``order``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def keep_newest(df: DataFrame, key: str, published: str, seq: str) -> DataFrame:
    """Later published wins; of ties and undated rows the first stays."""
    return top_n(df, [key], [F.col(published).desc_nulls_last(), F.col(seq)], 1).drop("place")


def first_seen(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Ordered de-duplication: the first row of each key."""
    return top_n(df, [key], [F.col(seq)], 1).drop("place")


def route(items: DataFrame, now: Column, newest: int = 2, new_days: int = 0, archive_days: int = 15) -> DataFrame:
    """``tier`` of ``channel, video, published``: the newest of a channel are
    ``new`` (if not older than ``new_days``, 0: any age), other dated ones up
    to ``archive_days`` old ``archive``, the rest ``drop``; undated ``none``."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("published")) / 86400
    place = F.row_number().over(Window.partitionBy("channel").orderBy(F.col("published").desc_nulls_last(), F.col("video").desc()))
    young = F.lit(True) if new_days == 0 else age <= new_days
    tier = F.when(F.col("published").isNull(), "none").when((place <= newest) & young, "new").when(age <= archive_days, "archive").otherwise("drop")
    return items.select("*", tier.alias("tier"))


def reconcile(desired: DataFrame, current: DataFrame) -> DataFrame:
    """Actions that bring ``current`` (``video, tier``) to ``desired``."""
    rows = desired.select("video", F.col("tier").alias("want")).join(current.select("video", F.col("tier").alias("have")), "video", "full")
    action = F.when(F.col("want").isNull(), "remove").when(F.col("have").isNull(), "add").when(F.col("want") != F.col("have"), "move").otherwise("keep")
    return rows.select("video", "want", "have", action.alias("action"))


def progress_sync(files: DataFrame, progress: DataFrame, summaries: DataFrame) -> DataFrame:
    """Files without a progress row are added; progress rows with neither
    file nor summary are removed; sorted output has ``video, change``."""
    rows = files.select("video", F.lit(1).alias("f")).distinct().join(progress.select("video", F.lit(1).alias("p")).distinct(), "video", "full").join(summaries.select("video", F.lit(1).alias("s")).distinct(), "video", "left")
    change = F.when(F.col("p").isNull(), "add").when(F.col("f").isNull() & F.col("s").isNull(), "remove")
    return rows.select("video", change.alias("change")).where("change IS NOT NULL")


def upload_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """``upload`` for files whose content and name are both new to ``known``
    (``sha256, name``); of equal contents the first name goes, others and
    known ones ``skip``."""
    first = files.groupBy("sha256").agg(F.min("name").alias("first"))
    place = F.row_number().over(Window.partitionBy("sha256", "name").orderBy("name"))  # of rows with the same name and content
    rows = files.join(first, "sha256").withColumn("again", (F.col("name") != F.col("first")) | (place > 1))
    rows = rows.join(known.select("sha256", F.lit(1).alias("a")).distinct(), "sha256", "left").join(known.select("name", F.lit(1).alias("b")).distinct(), "name", "left")
    return rows.select("name", "sha256", F.when(F.col("again") | F.col("a").isNotNull() | F.col("b").isNotNull(), "skip").otherwise("upload").alias("action"))


def fingerprint(df: DataFrame, by: str, line: Column) -> DataFrame:
    """SHA-256 over a group's sorted lines."""
    return df.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("fingerprint"))


def within_budget(df: DataFrame, by: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows in order until the running cost first passes ``budget``."""
    total = F.sum(cost).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("running", total).where(F.col("running") <= budget)


def freshness_check(files: DataFrame, meta: DataFrame, cutoff: Column) -> DataFrame:
    """Counts of five exclusive outcomes of ``video``: missing_meta,
    missing_date, parse_error, stale, fresh."""
    rows = files.join(meta.select("video", F.col("published_at"), F.lit(1).alias("m")), "video", "left")
    day = F.try_to_timestamp(F.col("published_at")).cast("date")
    outcome = F.when(F.col("m").isNull(), "missing_meta").when(F.coalesce("published_at", F.lit("")) == "", "missing_date").when(day.isNull(), "parse_error").when(day < cutoff, "stale").otherwise("fresh")
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("videos"))


def skip_merge(mine: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which rows of ``mine`` win."""
    return mine.unionByName(other.join(mine, keys, "left_anti"))


def collisions(df: DataFrame, col: str, name: str) -> DataFrame:
    """Values that two different names share."""
    return df.groupBy(col).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)


def cold_plan(entries: DataFrame, active: DataFrame, cold: DataFrame) -> DataFrame:
    """What becomes of each ``video`` that is to go cold, blank ids left out:
    ``move`` (active, not cold), ``replace`` (both), ``done`` (cold only) or
    ``absent``."""
    wanted = entries.select(F.trim("video").alias("video")).where("video <> ''").distinct()
    here, there = active.select("video").distinct().withColumn("here", F.lit(True)), cold.select("video").distinct().withColumn("there", F.lit(True))
    rows = wanted.join(here, "video", "left").join(there, "video", "left")
    both = F.col("here").isNotNull() & F.col("there").isNotNull()
    step = F.when(both, "replace").when(F.col("here").isNotNull(), "move").when(F.col("there").isNotNull(), "done").otherwise("absent")
    return rows.select("video", step.alias("step"))


def cold_counts(plan: DataFrame) -> DataFrame:
    """One row: candidates, those that move (or would, in a dry run), those
    that are cold already and those that are nowhere."""
    n = lambda *steps: F.coalesce(F.sum(F.col("step").isin(*steps).cast("long")), F.lit(0))
    return plan.agg(F.count("*").alias("old_candidates"), n("move", "replace").alias("cold_moved"), n("done").alias("already_cold"), n("absent").alias("absent"))


def apply_cold(plan: DataFrame, active: DataFrame, cold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``active`` and ``cold`` after the plan: moved rows take the place of
    cold ones with their id. A plan of the result moves nothing more."""
    moved = plan.where(F.col("step").isin("move", "replace")).select("video")
    kept = cold.join(moved, "video", "left_anti").select(*cold.columns)
    arrived = active.join(moved, "video", "left_semi").select(*cold.columns)
    return active.join(moved, "video", "left_anti").select(*active.columns), kept.unionByName(arrived)
