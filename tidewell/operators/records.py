"""Lookups, gaps, versions and counts of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allowed(df: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Rows whose value, in lower case, is one of ``names``; no names: all."""
    return df.where(F.lower(col).isin(*[n.lower() for n in names])) if names else df


def live_after_limit(items: DataFrame, by: str, order: list[Column], n: int, live: Column) -> DataFrame:
    """The first ``n`` of each group, then without live ones: a group may
    keep fewer than ``n``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return items.withColumn("place", place).where(F.col("place") <= n).where(~F.coalesce(live, F.lit(False)))


def newest_since(items: DataFrame, by: str, published: str, seq: str, cutoff: Column, n: int) -> DataFrame:
    """Items from ``cutoff`` on, newest first, at most ``n`` of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(published), F.desc(seq)))
    return items.where(F.col(published) >= cutoff).withColumn("place", place).where(F.col("place") <= n)


def missing_summaries(index: DataFrame, hot: DataFrame, cold: DataFrame, key: str = "video") -> DataFrame:
    """Index rows with neither a hot nor a cold file."""
    return index.join(hot.select(key), key, "left_anti").join(cold.select(key), key, "left_anti")


def orphans(files: DataFrame, index: DataFrame, published: str, cutoff: Column, key: str = "video") -> DataFrame:
    """Files older than ``cutoff`` (undated ones stay) that the index lacks."""
    return files.where(F.col(published) < cutoff).join(index.select(key), key, "left_anti")


def distinct_total(df: DataFrame, *keys: str) -> DataFrame:
    return df.agg(F.countDistinct(*keys).alias("videos"))


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with a named count for each condition."""
    return df.agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def joined_lines(df: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """The lines of a group (a conversation, a page) in order, as one text."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(by).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def sources_of(mentions: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Different sources of each key as rows, in order."""
    rows = mentions.select(key, *cols).distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*cols)))


def payload_counts(payloads: DataFrame) -> DataFrame:
    """Items, entity mentions and covered stocks of ``id, payload`` (JSON);
    payloads that don't parse count zero."""
    schema = "struct<knowledge_items:array<struct<text:string,entities:array<string>>>,stocks_covered:array<struct<canonical:string>>>"
    p = F.from_json("payload", schema)
    rows = payloads.select("id", F.coalesce(p["knowledge_items"], F.array()).alias("i"), F.coalesce(p["stocks_covered"], F.array()).alias("s"))
    entities = F.aggregate("i", F.lit(0), lambda n, x: n + F.coalesce(F.size(x["entities"]), F.lit(0)))
    return rows.select("id", F.size("i").alias("items"), entities.alias("mentions"), F.size("s").alias("stocks"))


def legacy_markdown(payloads: DataFrame, present: DataFrame) -> DataFrame:
    """``id, text``: JSON summaries (``id, title, payload``) as Markdown, but
    for those whose target is ``present`` already."""
    p = F.from_json("payload", "struct<summary:string,key_points:array<string>,stocks:array<struct<symbol:string,note:string>>>")
    rows = payloads.join(present.select("id"), "id", "left_anti").select("id", "title", p.alias("p"))

    def listed(items: Column) -> Column:
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- none")

    stocks = F.transform("p.stocks", lambda x: F.concat_ws(": ", x["symbol"], x["note"]))
    parts = [F.concat(F.lit("# "), F.coalesce("title", F.lit("unknown"))), F.lit("## Summary"), F.coalesce("p.summary", F.lit("none")), F.lit("## Key Points & Insights"), listed(F.col("p.key_points")), F.lit("## Stocks"), listed(stocks)]
    return rows.select("id", F.array_join(F.array(*parts), "\n").alias("text"))


def accounting(results: DataFrame, status: str = "status") -> DataFrame:
    """Results by status, with indexed and skipped both counted as indexed."""
    done = F.when(F.col(status).isin("indexed", "skipped"), "indexed").otherwise(F.col(status))
    return results.groupBy(done.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def retry_route(status: Column) -> Column:
    """What follows a status: ``done``, ``never`` (there is nothing to get),
    ``abort`` (blocked: the run ends) or ``retry``."""
    return F.when(status == "success", "done").when(status.isin("no_transcript", "disabled"), "never").when(status == "blocked", "abort").otherwise("retry")


def by_name(asked: DataFrame, table: DataFrame, name: str, order: str) -> DataFrame:
    """``asked`` (column ``asked``) with the first row of ``table`` whose name
    is equal, trimmed and in any case; without one the name is null."""
    first = Window.partitionBy("norm").orderBy(order)
    rows = table.withColumn("norm", F.lower(F.trim(name))).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
    return asked.withColumn("norm", F.lower(F.trim("asked"))).join(rows, "norm", "left").drop("norm")


def by_id_or_alias(asked: DataFrame, configs: DataFrame) -> DataFrame:
    """``asked, config``: the id asked for where it is one, else the first
    config (by id) with that display name or alias in any case. ``configs``:
    ``id, display, aliases`` (array)."""
    ids = configs.select(F.col("id").alias("exact"))
    names = configs.select("id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("display"))).alias("n")).groupBy(F.lower("n").alias("norm")).agg(F.min("id").alias("named"))
    rows = asked.withColumn("t", F.trim("asked")).where("t <> ''")
    rows = rows.join(ids, F.col("t") == F.col("exact"), "left").join(names, F.lower("t") == F.col("norm"), "left")
    return rows.select("asked", F.coalesce("exact", "named").alias("config"))


def name_contains(table: DataFrame, name: str, part: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows whose name holds ``part``, in any case."""
    return table.where(F.contains(F.lower(name), F.lit(part.lower()))).orderBy(order).limit(most)


def ordered_paths(paths: DataFrame, path: Column) -> DataFrame:
    """Different paths in order, without empty and ``.`` parts; ``..`` takes
    back the part before it, at the root nothing."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    back = lambda kept: F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
    parts = F.aggregate(parts, F.array().cast("array<string>"), lambda kept, x: F.when(x == "..", back(kept)).otherwise(F.concat(kept, F.array(x))))
    rows = paths.select(F.concat(F.lit("/"), F.array_join(parts, "/")).alias("path"))
    return rows.distinct().orderBy("path")


def write_version(versions: DataFrame, incoming: DataFrame, snapshot: str, started: int) -> DataFrame:
    """``versions`` (``doc_id, snapshot, started, title``) with a row for each
    incoming document; a missing title is taken over from its last version."""
    last = versions.groupBy("doc_id").agg(F.max_by("title", F.struct("started", "snapshot")).alias("old_title"))
    rows = incoming.join(last, "doc_id", "left").select("doc_id", F.lit(snapshot).alias("snapshot"), F.lit(started).alias("started"), F.coalesce("title", "old_title").alias("title"))
    return versions.select("doc_id", "snapshot", "started", "title").unionByName(rows)


def display_rows(results: DataFrame, versions: DataFrame) -> DataFrame:
    """``results`` (``doc_id, ...``) with the latest version's title, by start."""
    last = versions.groupBy("doc_id").agg(F.max_by(F.struct("snapshot", "title"), F.struct("started", "snapshot")).alias("v"))
    return results.join(last, "doc_id", "left").select(*results.columns, "v.snapshot", "v.title")


def replace_chunks(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Chunk rows (``doc_id, chunk_id``) after an upsert: documents that come
    in lose their old rows and get the new ones, each chunk once: of several
    the least by the other columns in order."""
    kept = current.join(incoming.select("doc_id").distinct(), "doc_id", "left_anti")
    others = [c for c in incoming.columns if c not in ("doc_id", "chunk_id")]
    if not others:
        return kept.unionByName(incoming.distinct())
    least = incoming.groupBy("doc_id", "chunk_id").agg(F.min(F.struct(*others)).alias("row"))
    return kept.unionByName(least.select("doc_id", "chunk_id", "row.*"))


def index_status(documents: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded chunks, skipped and failed
    documents of ``chunks, embedded, skipped, error``, and the run's status."""
    row = documents.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("embedded"), F.lit(0)).alias("embedded"), F.count_if("skipped").alias("skipped"), F.count("error").alias("failed"))
    return row.withColumn("status", F.when(F.col("failed") > 0, "success_with_errors").otherwise("success"))


def wait_budget(run_p90: Column, wait_sum: Column, report_ms: Column, wait_most: Column, report_timeout: Column) -> Column:
    """Seconds to allow for a run: the greatest of its 90th percentile, the
    waits and the last report's time with a fifth and a minute more, and what
    the settings can take at most; candidates that are null or zero don't count."""
    seen = (wait_sum + F.coalesce(report_ms / 1000, F.lit(0.0))) * 1.2 + 60
    return F.greatest(*[F.nullif(c, F.lit(0.0)) for c in (run_p90, seen, wait_most + report_timeout)])


def broken_links(files: DataFrame, links: DataFrame) -> DataFrame:
    """``path, target``: links (resolved targets) that no file has."""
    return links.join(files.select(F.col("path").alias("target")), "target", "left_anti").select("path", "target").distinct()


def top_processes(samples: DataFrame, by: str, cpu: str, rss: str, seq: str, n: int = 5) -> DataFrame:
    """The ``n`` busiest of each sample, by CPU, then memory."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(cpu), F.desc(rss), F.col(seq)))
    return samples.withColumn("place", place).where(F.col("place") <= n)


def best_configurations(results: DataFrame, most: int = 10) -> DataFrame:
    """Results by falling nDCG, then recall, then name, with their place."""
    top = results.orderBy(F.desc("ndcg"), F.desc("recall"), "name").limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ndcg"), F.desc("recall"), "name")))  # of ``most`` rows
