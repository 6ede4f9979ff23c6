"""Upkeep of a corpus: regeneration policy, retention, caches, run states,
compact projections of summaries, crawling by depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Source keys without which a summary can't be routed.
HARD_KEYS = ("video_id", "channel_namespace")


def soft_reason(reason: Column) -> Column:
    """Whether a validity code is soft: any missing section, or a missing
    source key other than the routing keys."""
    key = F.lower(F.trim(F.regexp_replace(reason, "^[^:]*:", "")))
    return reason.startswith("missing_section:") | (reason.startswith("missing_source_key:") & ~key.isin(*HARD_KEYS))


def backfill(reason: Column, published: Column, now: Column, mode: str = "soft", days: int = 14) -> Column:
    """Struct ``allowed, why`` for an invalid summary: hard faults are always
    made anew; soft ones by mode, and in mode ``soft`` if they are not older
    than ``days`` (at least 1) or undated. Unknown modes count as ``soft``."""
    span = max(1, days)
    young = published >= now - F.expr(f"INTERVAL {span} DAY")
    rule = {
        "full": (F.lit(True), F.lit("mode_full")),
        "off": (F.lit(False), F.lit("mode_off")),
    }.get(
        mode.strip().lower(),
        (
            F.coalesce(young, F.lit(True)),
            F.when(published.isNull(), "soft_unknown_reference_time").when(young, "soft_within_window").otherwise(f"soft_outside_window:{span}d"),
        ),
    )
    soft = soft_reason(reason)
    return F.struct((~soft | rule[0]).alias("allowed"), F.when(~soft, "hard_invalid").otherwise(rule[1]).alias("why"))


def expired(files: DataFrame, now: Column, days: int | None = 30) -> DataFrame:
    """Files (``path, modified``) last changed more than ``days`` ago; none
    without a limit."""
    if days is None:
        return files.where("false")
    if days < 0:
        raise ValueError("days must be 0 or more")
    return files.where(F.col("modified") < now - F.expr(f"INTERVAL {days} DAY"))


def channel_input(text: Column) -> Column:
    """Struct ``kind, key`` of what a user gave for a channel: an id, the id
    in a channel URL, a video whose channel is to be found, or a handle."""
    t = F.trim(text)
    host, path = F.regexp_extract(t, "^[a-z]+://([^/?#]*)", 1), F.regexp_extract(t, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    long, short = host.contains("youtube.com"), host.contains("youtu.be")
    watched = F.regexp_extract(t, r"[?&]v=([^&#]+)", 1)
    is_id = t.startswith("UC") & (F.length(t) == 24)
    channel, is_short = long & path.startswith("/channel/"), short & (F.length(path) > 1)
    key = F.when(is_id, t).when(channel, F.substring_index(path, "/", -1)).when(long & (watched != ""), watched).when(is_short, F.ltrim(path, F.lit("/"))).otherwise(F.ltrim(F.lower(t), F.lit("@")))
    kind = F.when(is_id | channel, "channel").when((long & (watched != "")) | is_short, "video").otherwise("handle")
    return F.struct(kind.alias("kind"), key.alias("key"))


def cached_ids(asked: DataFrame, cache: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """``key, id`` for handles whose cached id was verified less than ``days``
    whole days ago, null for the others, which are to be looked up."""
    fresh = cache.where(F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_verified")) / 86400) < days)
    return asked.select("key").distinct().join(fresh.select("key", "id"), "key", "left")


def config_set_id(configs: DataFrame, order: str = "seq") -> DataFrame:
    """One row: names joined by ``+`` and twelve hex digits of the SHA-256 of
    the bodies, joined by NUL bytes, in order. A set has a handful of rows."""
    one = configs.agg(F.array_sort(F.collect_list(F.struct(order, "name", F.col("body").cast("binary").alias("body")))).alias("c"))
    names = F.array_join(F.transform("c", lambda x: x["name"]), "+")
    bodies = F.aggregate(F.slice("c", 2, 2**30), F.get("c", F.lit(0))["body"], lambda s, x: F.concat(s, F.lit(b"\0"), x["body"]))
    return one.select(F.concat(names, F.lit("__cs-"), F.substring(F.sha2(bodies, 256), 1, 12)).alias("id"))


def latest_run(folders: DataFrame) -> DataFrame:
    """Of ``name`` the last bundle (its name holds ``__``), else the last
    ``run_`` folder; one row, null without either."""
    bundle, run = F.col("name").contains("__"), F.col("name").startswith("run_")
    return folders.agg(F.coalesce(F.max(F.when(bundle, F.col("name"))), F.max(F.when(run, F.col("name")))).alias("name"))


def run_state(state: Column, exit_code: Column, alive: Column, log_tail: Column, blocked: list[str]) -> Column:
    """Struct ``state, alert``: a running run that has an exit code or no
    process is finished; the alert tells whether the log holds a block text."""
    ended = (state == "running") & (exit_code.isNotNull() | ~F.coalesce(alive, F.lit(False)))
    alert = F.greatest(*[F.coalesce(log_tail.contains(b), F.lit(False)) for b in blocked], F.lit(False))
    return F.struct(F.when(ended, "finished").otherwise(F.coalesce(state, F.lit("unknown"))).alias("state"), alert.alias("alert"))


def merge_files(legacy: DataFrame, target: DataFrame) -> DataFrame:
    """``name, action`` for files of an old layout (``name, content``): move
    where the target is missing, delete where size and digest agree, else
    keep both."""
    side = lambda df, p: df.select("name", F.length("content").alias(f"{p}_size"), F.sha2(F.col("content").cast("binary"), 256).alias(f"{p}_sha"))
    rows = side(legacy, "old").join(side(target, "new"), "name", "left")
    same = (F.col("old_size") == F.col("new_size")) & (F.col("old_sha") == F.col("new_sha"))
    return rows.select("name", F.when(F.col("new_sha").isNull(), "move").when(same, "delete").otherwise("keep").alias("action"))


SUMMARY = "struct<video_id:string,title:string,transcript_quality:string,source:struct<video_id:string,channel_namespace:string>,knowledge_items:array<struct<text:string>>,stocks_covered:array<struct<canonical:string,confidence:string,why_covered:string,evidence:array<struct<quote:string>>>>,macro_insights:array<struct<claim:string,confidence:string>>>"


def compact_summaries(payloads: DataFrame) -> DataFrame:
    """``video, channel, stocks, claims`` of JSON summaries: the first ten
    stocks that have a name, each with its first two quotes, and the first
    five claims."""
    p = payloads.select(F.from_json("payload", SUMMARY).alias("p"))
    quotes = lambda s: F.transform(F.filter(F.slice(F.coalesce(s["evidence"], F.array()), 1, 2), lambda e: e["quote"].isNotNull()), lambda e: e["quote"])
    stocks = F.filter(F.slice(F.coalesce("p.stocks_covered", F.array()), 1, 10), lambda s: F.coalesce(F.trim(s["canonical"]), F.lit("")) != "")
    claims = F.filter(F.slice(F.coalesce("p.macro_insights", F.array()), 1, 5), lambda m: m["claim"].isNotNull())
    return p.select(
        F.coalesce("p.source.video_id", "p.video_id", F.lit("")).alias("video"),
        F.coalesce("p.source.channel_namespace", F.lit("unknown")).alias("channel"),
        F.transform(stocks, lambda s: F.struct(s["canonical"].alias("canonical"), s["why_covered"].alias("why"), quotes(s).alias("quotes"))).alias("stocks"),
        F.transform(claims, lambda m: m["claim"]).alias("claims"),
    )


def highlights(payloads: DataFrame, most: int = 5) -> DataFrame:
    """``video, lines``: knowledge items, then stocks with a reason, then
    claims, as list lines; beyond ``most`` a line tells how many more."""
    p = payloads.select(F.from_json("payload", SUMMARY).alias("p"))
    full = lambda c: F.coalesce(c, F.lit("")) != ""
    items = F.transform(F.filter(F.coalesce("p.knowledge_items", F.array()), lambda x: full(x["text"])), lambda x: F.concat(F.lit("- "), x["text"]))
    stocks = F.transform(F.filter(F.coalesce("p.stocks_covered", F.array()), lambda s: full(s["canonical"]) & full(s["why_covered"])), lambda s: F.concat(F.lit("- **"), s["canonical"], F.lit("**: "), s["why_covered"]))
    claims = F.transform(F.filter(F.coalesce("p.macro_insights", F.array()), lambda m: full(m["claim"])), lambda m: F.concat(F.lit("- *Macro*: "), m["claim"]))
    rows = p.select(F.coalesce("p.video_id", "p.source.video_id").alias("video"), F.concat(items, stocks, claims).alias("all"))
    more = F.when(F.size("all") > most, F.array(F.format_string("- ... (%d more)", F.size("all") - most))).otherwise(F.array())
    return rows.where(F.size("all") > 0).select("video", F.concat(F.slice("all", 1, most), more).alias("lines"))


def over_limit(prompts: DataFrame, limits: DataFrame) -> DataFrame:
    """``over`` where the approximate tokens of ``text`` exceed the limit of
    its ``model``; unknown models have none."""
    rows = prompts.join(F.broadcast(limits.select("model", "max_tokens")), "model", "left")  # one row a model
    return rows.withColumn("tokens", F.floor(F.length("text") / 4)).withColumn("over", F.coalesce(F.col("tokens") > F.col("max_tokens"), F.lit(False)))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("n = 1").drop("n")


def robots_allowed(urls: DataFrame, rules: DataFrame, hosts: DataFrame, longest: bool = False) -> DataFrame:
    """The rows of ``urls`` (``url``) that their host's robots rules permit.

    ``rules`` (``host, seq, allow, prefix``): of those whose prefix begins the
    path and query, the first by ``seq`` decides, or with ``longest`` the one
    with the longest prefix (of equal ones an allowing one). An empty prefix
    that disallows says nothing. Without a rule that fits, pages of ``hosts``
    (``host``: their rules could be read) are permitted; all others are not.
    """
    host, path = F.lower(F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1)), F.regexp_extract("url", "^[^:]+://[^/?#]*([^#]*)", 1)
    rows = urls.select("url").distinct().select("url", host.alias("host"), F.when(path == "", "/").otherwise(path).alias("path"))
    rows = rows.join(hosts.select(F.lower("host").alias("host")).distinct(), "host", "left_semi")
    said = rules.where("allow OR prefix <> ''").select(F.lower("host").alias("host"), "seq", "allow", "prefix")
    fits = rows.join(said, "host").where(F.col("path").startswith(F.col("prefix")))
    first = F.struct(-F.length("prefix"), (~F.col("allow")).cast("int"), "seq") if longest else F.struct("seq")
    ruled = fits.groupBy("url").agg(F.min_by("allow", first).alias("allow"))
    permitted = rows.join(ruled, "url", "left").where("allow OR allow IS NULL").select("url")
    return urls.join(permitted, "url", "left_semi")


def crawl(links: DataFrame, seeds: DataFrame, depth: int, allowed: Callable[[str], Column] | None = None, most: int | None = None, permitted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``url, depth`` of pages reached from ``seeds`` (``url``) over ``links``
    (``src, dst``) in at most ``depth`` steps, each at its first step; only
    allowed targets, and of targets and seeds only what ``permitted`` leaves
    (see ``robots_allowed``). ``most`` keeps the first pages by (depth, url), as the
    feature of a page cap. Each step is one join and is checkpointed."""
    seen = seeds.select("url").distinct()
    seen = (seen if permitted is None else permitted(seen)).withColumn("depth", F.lit(0))
    frontier = seen
    for step in range(1, depth + 1):
        targets = links.join(frontier.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        if allowed is not None:
            targets = targets.where(allowed("url"))
        fresh = targets.join(seen.select("url"), "url", "left_anti")
        fresh = fresh if permitted is None else permitted(fresh)
        frontier = fresh.withColumn("depth", F.lit(step)).checkpoint()
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if most is None else seen.orderBy("depth", "url").limit(most)
