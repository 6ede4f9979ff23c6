"""Lookups, gaps, versions, summaries, logs and cycle tables over the driver
tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import dates as D
from tidewell.functions import text as T
from tidewell.operators import records as R
from tidewell.operators import series as S
from tidewell.plans.cycles import METRICS, SIGNAL, WEEKLY, spectrum, weekly
from tidewell.plans.tables import DAILY, MENTIONS, daily, mentions, rounded, table

CHANNELS = ["SRC0", "web", "Forum", "src3"]
NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def _numbered(text: str, *cols: Column) -> Column:
    """``text`` with ``%s`` in the places of columns."""
    parts = text.split("%s")
    made = [F.lit(parts[0])]
    for c, p in zip(cols, parts[1:], strict=True):
        made += [c.cast("string"), F.lit(p)]
    return F.concat(*made)


def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.allowed(_docs(spark, sf_dir, "source"), "source", CHANNELS)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").alias("video"), F.col("o_orderdate").alias("published"), (F.col("o_orderstatus") == "F").alias("live"))


def live_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.live_after_limit(_orders(spark, sf_dir), "channel", [F.desc("published"), F.desc("video")], 5, F.col("live")).select("channel", "video", "place")


def newest_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.newest_since(_orders(spark, sf_dir), "channel", "published", "video", F.to_timestamp(F.lit("1997-01-01")), 4).select("channel", "video", "place")


def missing_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with neither a label of good quality nor a toxic one."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "video")
    return R.missing_summaries(_docs(spark, sf_dir).withColumnRenamed("doc_id", "video"), labels.where("quality = 1"), labels.where("toxic = 1"))


def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("video"))
    return R.orphans(_orders(spark, sf_dir), index, "published", F.to_timestamp(F.lit("1996-01-01"))).select("video")


def mention_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_total(mentions(spark, sf_dir), "channel", "video")


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return R.counters(table(spark, sf_dir, "events"), {"purchases": F.col("event_type") == "purchase", "high": value > 50, "missing": value.isNull()})


def conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.joined_lines(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.concat_ws(": ", "role", "text"))


def symbol_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sources_of(mentions(spark, sf_dir).where("symbol IS NOT NULL"), "symbol", ["channel", "video"])


def extractor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with one entity for each unit of doc_id's last digit; every
    eleventh is no JSON."""
    d = F.col("doc_id")
    ents = F.array_join(F.transform(F.sequence(F.lit(0), (d % 10).cast("int")), lambda i: F.concat(F.lit('"E'), i.cast("string"), F.lit('"'))), ",")
    body = F.when(d % 11 == 0, "{broken").otherwise(_numbered('{"knowledge_items":[{"text":"a","entities":[%s]},{"text":"b"}],"stocks_covered":[{"canonical":"X"}]}', ents))
    return R.payload_counts(_docs(spark, sf_dir).select(d.alias("id"), body.alias("payload")))


def legacy_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    body = _numbered('{"summary":"S%s","key_points":["one %s","two"],"stocks":[{"symbol":"T%s","note":"n"}]}', d, d, d)
    rows = _docs(spark, sf_dir, "source").select(d.alias("id"), F.col("source").alias("title"), F.when(d % 5 != 0, body).otherwise("{}").alias("payload"))
    return R.legacy_markdown(rows, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


def result_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("indexed", "skipped", "failed"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return R.accounting(_docs(spark, sf_dir).select(status.alias("status")))


def retry_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by type, as statuses of a download."""
    names = {"purchase": "success", "click": "no_transcript", "view": "blocked", "signup": "disabled"}
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in names.items()], F.lit("error"))
    return table(spark, sf_dir, "events").groupBy(R.retry_route(status).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers asked for by their nation's name, in lower case with spaces."""
    nation = table(spark, sf_dir, "nation")
    asked = nation.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("asked")).unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("asked")))
    return R.by_name(asked, nation, "n_name", "n_nationkey").select("asked", "n_nationkey")


def config_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    configs = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("display"), F.array(F.concat(F.lit("alias "), "n_regionkey")).alias("aliases"))
    asked = n.select(F.explode(F.array(F.col("n_nationkey").cast("string"), F.lower("n_name"), F.concat(F.lit(" ALIAS "), "n_regionkey"), F.concat(F.lit("none "), "n_name"), F.lit(" "))).alias("asked")).distinct()
    return R.by_id_or_alias(asked, configs)


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.name_contains(table(spark, sf_dir, "part"), "p_name", "RE", "p_partkey", 25).select("p_partkey", "p_name")


def ordered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return R.ordered_paths(_docs(spark, sf_dir, "source"), _numbered("/../srv//%s/./old/../%s/", F.col("source"), d % 40))


def version_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "source", "lang")
    first = docs.where("lang = 'en'").select("doc_id", F.lit("a").alias("snapshot"), F.lit(1).alias("started"), F.col("source").alias("title"))
    incoming = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("title"))
    return R.write_version(first, incoming, "b", 2)


def result_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.display_rows(_docs(spark, sf_dir, "lang"), version_write(spark, sf_dir))


def chunk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold two lines or more come in anew."""
    lines = _docs(spark, sf_dir, "text").select("doc_id", F.split("text", "\n", -1).alias("l"))
    current = lines.select("doc_id", F.concat(F.lit("old-"), F.size("l")).alias("chunk_id"))
    incoming = lines.where(F.size("l") > 1).select("doc_id", F.explode("l").alias("line")).select("doc_id", F.md5(F.col("line").cast("binary")).alias("chunk_id"))
    return R.replace_chunks(current, incoming)


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", "\n", -1)).cast("long")
    rows = _docs(spark, sf_dir, "text").select(n.alias("chunks"), F.when(F.col("doc_id") % 2 == 0, n).otherwise(0).alias("embedded"), (F.col("doc_id") % 5 == 0).alias("skipped"), F.when(F.col("doc_id") % 13 == 0, "bad").alias("error"))
    return R.index_status(rows)


def wait_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    made = R.wait_budget(F.when(F.col("event_id") % 3 == 0, v), F.when(F.col("event_id") % 2 == 0, v / 2), v * 100, F.when(F.col("event_id") % 5 == 0, v * 3), F.lit(10.0))
    return rounded(table(spark, sf_dir, "events").select("event_id", made.alias("seconds")))


def link_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of made Markdown files: each to a neighbour, above and on the web."""
    d = F.col("doc_id")
    text = _numbered("[a](doc%s.md#top) and [b](../%s/./doc%s.md:12) [c](https://x.org/%s)", d + 1, F.col("source"), d, d)
    docs = _docs(spark, sf_dir, "source").select(F.concat_ws("/", F.col("source"), _numbered("doc%s.md", d)).alias("path"), F.col("source").alias("base"), text.alias("text"))
    links = docs.select("path", F.explode(F.transform(T.markdown_links(F.col("text")), lambda x: T.link_target(F.col("base"), x))).alias("target"))
    return R.broken_links(docs, links)


def top_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("pid"), F.floor("value").alias("cpu"), (F.col("user_id") % 7).alias("rss"))
    return R.top_processes(rows, "event_type", "cpu", "rss", "pid").select("event_type", "pid", "place")


def best_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", F.col("l_linenumber").cast("string"), "l_linestatus", "l_returnflag")
    rows = table(spark, sf_dir, "lineitem").groupBy(name.alias("name")).agg(F.round(F.avg("l_discount"), 3).alias("ndcg"), F.round(F.avg("l_tax"), 5).alias("recall"))
    return R.best_configurations(rows).select("name", "place")


def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.uuid5(F.concat(F.lit("doc-"), "doc_id"), NAMESPACE).alias("id"))


def source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    when = lambda k, c: F.when(d % 5 == k, c)
    made = T.source_id(when(0, _numbered(" direct:%s ", d)), when(1, _numbered("meta:%s", d)), when(2, _numbered('---\nsource_id: "front:%s"\n---\nbody', d)), when(3, _numbered("2024__video_%s.md", d + 1_000_000)))
    return _docs(spark, sf_dir).select("doc_id", made.alias("source_id"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a run log."""
    e, v = F.col("event_id"), F.round(F.col("value"), 2)
    kinds = [F.lit("Starting mining..."), _numbered("Rate limiting: waiting %ss", v), _numbered("LLM report call completed: x duration_ms=%s", v), F.lit("Aggregation completed."), _numbered("Starting to process %s channels", e), _numbered("Preparing LLM request: 3 transcripts, 9 chars, ~%s tokens", e), F.lit("something else")]
    text = F.coalesce(*[F.when(e % 7 == k, c) for k, c in enumerate(kinds)])
    stamp = F.when(e % 10 != 9, F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(",123 INFO "))).otherwise("no stamp ")
    return table(spark, sf_dir, "events").select("event_id", F.concat(stamp, text).alias("line"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).select("event_id", T.log_line(F.col("line")).alias("l")).where("l IS NOT NULL")
    return rounded(rows.select("event_id", F.date_format("l.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "l.kind", "l.amount"))


def _summary(d: Column, source: Column) -> tuple[dict[str, Column], Column]:
    values = {"topic": source, "video_id": _numbered("v%s", d), "url": _numbered("https://y/%s", d), "title": F.when(d % 4 != 0, _numbered("T%s", d)), "channel_namespace": source, "published_at": F.lit("2024-01-02"), "fetched_at": F.lit("2024-01-03 10:00 UTC"), "info_density": F.when(d % 3 == 0, " High ").otherwise("odd")}
    text = _numbered("## Executive Summary\nall %s\n## Numbers\n- one\n- two\n## Risks\nplain risk\n## Numbers\n- last", d)
    return values, text


def summary_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, text = _summary(F.col("doc_id"), F.col("source"))
    return _docs(spark, sf_dir, "source").select("doc_id", T.summary_markdown(values, T.sections(text)).alias("text"))


def summary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered summaries, whole, without a section, a key, or of another video."""
    d = F.col("doc_id")
    values, text = _summary(d, F.col("source"))
    made = T.summary_markdown(values, T.sections(text))
    made = F.when(d % 5 == 1, F.replace(made, F.lit("## Chances"), F.lit("## Chance"))).when(d % 5 == 2, F.regexp_replace(made, "- url: .*", "- url:")).otherwise(made)
    fault = T.summary_fault(made, F.when(d % 5 == 3, "other").otherwise(_numbered("v%s", d)), F.col("source"))
    return _docs(spark, sf_dir, "source").select("doc_id", fault.alias("fault"))


def sse_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of events with a broken line, usage and text after the end."""
    d = F.col("doc_id")
    body = _numbered(
        'data: {"choices":[{"delta":{"content":"a%s"%s}}]}\n\ndata: {broken\ndata: {"choices":[{"delta":{"tool_calls":[{"function":{"name":"f"}}]}}],"usage":{"total_tokens":%s}}\ndata: {"choices":[{"delta":{"content":"z"}}],"usage":{"total_tokens":%s}}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"late"}}]}',
        d, F.when(d % 2 == 0, ',"reasoning":"r"').otherwise(""), d, d + 7,
    )
    return _docs(spark, sf_dir).select("doc_id", T.sse_text(body).alias("text"), T.sse_tool_calls(body).alias("tool_calls"), T.sse_field(body, "$.usage.total_tokens").cast("long").alias("tokens"), T.sse_has_reasoning(body).alias("reasoning"))


def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, paths and labels made from doc_id and source."""
    d, s = F.col("doc_id"), F.col("source")
    return _docs(spark, sf_dir, "source").select(
        "doc_id",
        T.ticker(_numbered("Company %s (T%s)", d, d % 90)).alias("ticker"),
        T.ticker(_numbered(" plain %s ", d)).alias("plain"),
        T.channel_of(_numbered("/data/%s/1_transcripts", s)).alias("folder"),
        T.channel_of(_numbered("/data/1_transcripts/%s/x.txt", s)).alias("channel"),
        T.handle(_numbered("@@%s/%s", s, d)).alias("handle"),
        T.video_id(F.concat(F.lit("2024-01-02_"), F.lpad(F.concat(F.lit("_"), d.cast("string")), 11, "a"), F.lit(".txt"))).alias("video"),
        T.file_base(_numbered(" %s: a/b?? %s ", s, d)).alias("base"),
        T.repository(_numbered("https://git.example.org/%s/r%s.git/", s, d)).alias("repository"),
        T.glob_match(_numbered("%s/doc%s.md", s, d), ["*/doc[0-4]*.md", "src?/*7.md"], ["*9.md"]).alias("kept"),
        T.quality_bucket(F.when(d % 2 == 0, " OK "), F.array(F.when(d % 3 == 0, "Text cuts off").otherwise("fine"))).alias("bucket"),
        T.health(F.when(d % 7 != 0, F.when(d % 5 == 0, " ").otherwise("text")), d % 3 != 0, F.when(d % 2 == 0, "error")).alias("health"),
    )


def markdown_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    text = _numbered("---\ntitle: T%s\n---\n\n# head\n## A\n- k: v%s\n- only\n- k: w%s\n## B\nplain\n", d, d, d)
    return _docs(spark, sf_dir).select(
        "doc_id",
        T.without_frontmatter(text).alias("body"),
        T.frontmatter_value(text, "title").alias("title"),
        T.sections(text)["B"].alias("b"),
        F.array_join(T.bullets(text), "|").alias("bullets"),
        T.source_block(text)["k"].alias("k"),
        T.as_bullets(T.sections(text)["B"]).alias("as_bullets"),
        T.markdown_trim(text).alias("trimmed"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, e = F.col("ts").cast("timestamp"), F.col("event_id")
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm 'UTC'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "'no date' yyyy"]
    text = F.coalesce(*[F.when(e % 5 == k, F.date_format(ts, f)) for k, f in enumerate(forms)])
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format(D.parse_utc(text), "yyyy-MM-dd HH:mm:ss").alias("parsed"),
        D.published_date(text).alias("published"),
        D.minutes_seconds(F.col("value") * 40).alias("clock"),
        D.day_text(D.epoch_date(e * 86_400)).alias("day"),
        D.utc_label(ts).alias("label"),
    )


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spectrum(spark, sf_dir)
    peaks = S.local_peaks(bins)
    rows = S.band_metrics(peaks, bins).join(peaks.select("series", "k", "n", "amplitude", "power"), ["series", "k"])
    kept = [F.round(c, 9).alias(c) for c in ("band_ratio", "snr", "amplitude", "power")]
    return rows.select("series", "k", (F.col("n") * 7.0 / F.col("k")).alias("period_days"), *kept)


def cycle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cycle_table(_peaks(spark, sf_dir), "power", 12).select("series", "k", "place", "days")


def cycle_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _peaks(spark, sf_dir).withColumn("snr", F.when(F.col("k") % 3 != 0, F.round("snr", 1)))
    return S.sorted_cycles(rows, "snr").select("series", "k", "place")


def cycle_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _peaks(spark, sf_dir).select("series", "k", "period_days")
    selected = rows.where("k % 4 = 0").withColumn("period_days", F.col("period_days") + F.when(F.col("k") % 8 == 0, 5e-7).otherwise(1e-4))
    return S.matched_periods(rows, selected).select("series", "k", "selected")


def cycle_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals of each priority's Mondays on every day with orders."""
    rows = daily(spark, sf_dir)
    mondays = rows.where(F.dayofweek("ts") == 2)
    return rounded(S.filled_both(mondays, rows.select("ts").distinct()), 4)


def cycle_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.cumulative(S.build_signal(weekly(spark, sf_dir))).select("series", "ts", "total"))


def cycle_superposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly totals and their double, split at each series' day 2,000."""
    rows = weekly(spark, sf_dir)
    last = rows.groupBy("series").agg(F.date_add(F.min("ts"), 2000).alias("ts"))
    return rounded(S.superposed(rows.unionByName(rows.withColumn("value", F.col("value") * 2)), last), 4)


QUERIES = {
    f.__name__: f
    for f in (allow_list, live_after_limit, newest_since, missing_summaries, orphan_prune, mention_videos, status_counts, run_counters, conversation_text, symbol_sources, extractor_counts, legacy_flatten, result_accounting, retry_routes, name_lookup, config_lookup, name_search, ordered_paths, version_write, result_display, chunk_upsert, index_status, wait_budget, link_audit, top_processes, best_configurations, point_ids, source_ids, log_lines, summary_render, summary_faults, sse_fields, name_functions, markdown_functions, date_functions, cycle_table, cycle_sorted, cycle_matched, cycle_filled, cycle_cumulative, cycle_superposed)
}

_ORDERS = "o AS (SELECT o_custkey AS channel, o_orderkey AS video, o_orderdate AS published, o_orderstatus = 'F' AS live FROM orders)"
_VERSIONS = """v1 AS (SELECT doc_id, 'a' AS snapshot, 1 AS started, source AS title FROM documents WHERE lang = 'en'),
v AS (SELECT * FROM v1 UNION ALL SELECT d.doc_id, 'b', 2, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN d.lang END, v1.title) FROM documents d LEFT JOIN v1 ON v1.doc_id = d.doc_id)"""
_RENDERED = """'# ' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id END, 'unknown') || e'\\n\\n## Source\\n- topic: ' || source || e'\\n- video_id: v' || doc_id || e'\\n- url: https://y/' || doc_id || e'\\n- title: ' || coalesce(CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id END, 'unknown')
|| e'\\n- channel_namespace: ' || source || e'\\n- published_at: 2024-01-02\\n- fetched_at: 2024-01-03 10:00 UTC\\n- info_density: ' || CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'medium' END || e'\\n\\n## Summary\\nall ' || doc_id
|| e'\\n\\n## Key Points & Insights\\n- none\\n\\n## Numbers\\n- last\\n\\n## Chances\\n- none\\n\\n## Risks\\n- plain risk\\n\\n## Unknowns\\n- none\\n'"""
_PK = f"""{METRICS}, c AS (SELECT me.series, me.k, p.n * 7.0 / me.k AS period_days, round(band_ratio, 9) AS band_ratio, round(snr, 9) AS snr, round(p.amplitude, 9) AS amplitude, round(p.power, 9) AS power FROM me JOIN pk p ON p.series = me.series AND p.k = me.k)"""
_MD = "e'---\\ntitle: T' || doc_id || e'\\n---\\n\\n# head\\n## A\\n- k: v' || doc_id || e'\\n- only\\n- k: w' || doc_id || e'\\n## B\\nplain\\n'"

ORACLES = {
    "allow_list": "SELECT doc_id, source FROM documents WHERE lower(source) IN ('src0', 'web', 'forum', 'src3')",
    "live_after_limit": f"WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published DESC, video DESC) AS place FROM o) SELECT channel, video, place FROM r WHERE place <= 5 AND NOT live",
    "newest_since": f"WITH {_ORDERS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY published DESC, video DESC) AS place FROM o WHERE published >= TIMESTAMP '1997-01-01') SELECT channel, video, place FROM r WHERE place <= 4",
    "missing_summaries": "SELECT doc_id AS video FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1 OR toxic = 1)",
    "orphan_prune": "SELECT o_orderkey AS video FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')",
    "mention_videos": f"WITH {MENTIONS} SELECT count(DISTINCT (channel, video)) AS videos FROM m",
    "status_counts": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL",
    "run_counters": "SELECT count(*) FILTER (WHERE event_type = 'purchase') AS purchases, count(*) FILTER (WHERE value > 50) AS high, count(*) FILTER (WHERE value IS NULL) AS missing FROM events",
    "conversation_text": "SELECT conv_id, string_agg(concat_ws(': ', role, text), chr(10) ORDER BY turn, concat_ws(': ', role, text)) AS text FROM conversations GROUP BY conv_id",
    "symbol_sources": f"WITH {MENTIONS}, d AS (SELECT DISTINCT symbol, channel, video FROM m WHERE symbol IS NOT NULL) SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY channel, video) AS place FROM d",
    "extractor_counts": "SELECT doc_id AS id, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 2 END AS INTEGER) AS items, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 10 + 1 END AS INTEGER) AS mentions, CAST(CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS INTEGER) AS stocks FROM documents",
    "legacy_flatten": """SELECT doc_id AS id, '# ' || coalesce(source, 'unknown') || e'\\n## Summary\\n' || CASE WHEN doc_id % 5 <> 0 THEN 'S' || doc_id || e'\\n## Key Points & Insights\\n- one ' || doc_id || e'\\n- two\\n## Stocks\\n- T' || doc_id || ': n' ELSE e'none\\n## Key Points & Insights\\n- none\\n## Stocks\\n- none' END AS text
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "result_accounting": "SELECT CASE WHEN doc_id % 3 = 2 THEN 'failed' ELSE 'indexed' END AS outcome, count(*) AS n FROM documents GROUP BY 1",
    "retry_routes": "SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'click' THEN 'never' WHEN 'signup' THEN 'never' WHEN 'view' THEN 'abort' ELSE 'retry' END AS route, count(*) AS n FROM events GROUP BY 1",
    "name_lookup": "SELECT ' ' || lower(n_name) || ' ' AS asked, n_nationkey FROM nation UNION ALL SELECT r_name, n_nationkey FROM region LEFT JOIN nation ON lower(n_name) = lower(r_name)",
    "config_lookup": """WITH a AS (SELECT DISTINCT unnest([CAST(n_nationkey AS VARCHAR), lower(n_name), ' ALIAS ' || n_regionkey, 'none ' || n_name, ' ']) AS asked FROM nation),
t AS (SELECT lower(n_name) AS norm, min(CAST(n_nationkey AS VARCHAR)) AS id FROM nation GROUP BY 1 UNION ALL SELECT 'alias ' || n_regionkey, min(CAST(n_nationkey AS VARCHAR)) FROM nation GROUP BY 1)
SELECT asked, coalesce(CAST(n_nationkey AS VARCHAR), id) AS config FROM a LEFT JOIN nation ON trim(asked) = CAST(n_nationkey AS VARCHAR) LEFT JOIN t ON lower(trim(asked)) = norm WHERE trim(asked) <> ''""",
    "name_search": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_partkey LIMIT 25",
    "ordered_paths": "SELECT DISTINCT '/srv/' || source || '/' || doc_id % 40 AS path FROM documents",
    "version_write": f"WITH {_VERSIONS} SELECT doc_id, snapshot, started, title FROM v",
    "result_display": f"WITH {_VERSIONS} SELECT d.doc_id, d.lang, snapshot, title FROM documents d JOIN v ON v.doc_id = d.doc_id AND started = 2",
    "chunk_upsert": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT DISTINCT doc_id, md5(unnest(l)) AS chunk_id FROM l WHERE len(l) > 1 UNION ALL SELECT doc_id, 'old-' || len(l) FROM l WHERE coalesce(len(l), 0) <= 1",
    "index_status": """WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)
SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n ELSE 0 END) AS BIGINT) AS embedded, count(*) FILTER (WHERE doc_id % 5 = 0) AS skipped, count(*) FILTER (WHERE doc_id % 13 = 0) AS failed, CASE WHEN count(*) FILTER (WHERE doc_id % 13 = 0) > 0 THEN 'success_with_errors' ELSE 'success' END AS status FROM l""",
    "wait_budget": """SELECT event_id, round(greatest(nullif(CASE WHEN event_id % 3 = 0 THEN value END, 0), CASE WHEN event_id % 2 = 0 THEN (value / 2 + coalesce(value * 100 / 1000, 0)) * 1.2 + 60 END, nullif(CASE WHEN event_id % 5 = 0 THEN value * 3 + 10 END, 0)), 6) AS seconds FROM events""",
    "link_audit": """WITH f AS (SELECT doc_id, source, source || '/doc' || doc_id || '.md' AS path FROM documents), l AS (SELECT path, source || '/doc' || (doc_id + 1) || '.md' AS target FROM f UNION ALL SELECT path, path FROM f)
SELECT DISTINCT path, target FROM l WHERE target NOT IN (SELECT path FROM f WHERE path IS NOT NULL) AND target IS NOT NULL""",
    "top_processes": "WITH r AS (SELECT event_type, event_id AS pid, row_number() OVER (PARTITION BY event_type ORDER BY floor(value) DESC NULLS LAST, user_id % 7 DESC, event_id) AS place FROM events) SELECT * FROM r WHERE place <= 5",
    "best_configurations": "WITH g AS (SELECT concat_ws('-', CAST(l_linenumber AS VARCHAR), l_linestatus, l_returnflag) AS name, round(avg(l_discount), 3) AS ndcg, round(avg(l_tax), 5) AS recall FROM lineitem GROUP BY 1), r AS (SELECT name, row_number() OVER (ORDER BY ndcg DESC, recall DESC, name) AS place FROM g) SELECT * FROM r WHERE place <= 10",
    "point_ids": f"""WITH h AS (SELECT doc_id, sha1(from_hex('{NAMESPACE.replace("-", "")}') || encode('doc-' || doc_id)) AS h FROM documents)
SELECT doc_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], lower(lpad(to_hex((CAST('0x' || h[17:18] AS INTEGER) & 63) | 128), 2, '0')) || h[19:20], h[21:32]) AS id FROM h""",
    "source_ids": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'direct:' || doc_id WHEN 1 THEN 'meta:' || doc_id WHEN 2 THEN 'front:' || doc_id WHEN 3 THEN 'youtube:video_' || (doc_id + 1000000) END AS source_id FROM documents",
    "log_lines": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE event_id % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'wait' WHEN 2 THEN 'report' WHEN 3 THEN 'end' WHEN 4 THEN 'channels' WHEN 5 THEN 'prepare' END AS kind,
CASE WHEN event_id % 7 IN (1, 2) THEN round(value, 2) WHEN event_id % 7 IN (4, 5) THEN CAST(event_id AS DOUBLE) END AS amount FROM events WHERE event_id % 10 <> 9 AND (event_id % 7 NOT IN (1, 2) OR value IS NOT NULL)""",
    "summary_render": f"SELECT doc_id, {_RENDERED} AS text FROM documents",
    "summary_faults": "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'missing_section:Chances' WHEN 2 THEN 'missing_source_key:url' WHEN 3 THEN 'video_id_mismatch' ELSE 'ok' END AS fault FROM documents",
    "sse_fields": "SELECT doc_id, 'a' || doc_id || 'z' AS text, CAST(1 AS INTEGER) AS tool_calls, doc_id + 7 AS tokens, doc_id % 2 = 0 AS reasoning FROM documents",
    "name_functions": """SELECT doc_id, 'T' || doc_id % 90 AS ticker, 'plain ' || doc_id AS plain, '/data/' || source AS folder, source AS channel, source || '_' || doc_id AS handle, lpad('_' || doc_id, 11, 'a') AS video,
trim(regexp_replace(regexp_replace(' ' || source || ': a/b?? ' || doc_id || ' ', '[^\\w-]', '_', 'g'), '_+', '_', 'g'), '_') AS base, source || '/r' || doc_id AS repository,
(regexp_matches(source || '/doc' || doc_id || '.md', '^.*/doc[0-4].*\\.md$') OR regexp_matches(source || '/doc' || doc_id || '.md', '^src./.*7\\.md$')) AND NOT ends_with(source || '/doc' || doc_id || '.md', '9.md') AS kept,
CASE WHEN doc_id % 3 = 0 THEN 'truncated' WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'unknown' END AS bucket,
CASE WHEN doc_id % 7 = 0 THEN 'missing' WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 3 = 0 THEN 'metadata_invalid' WHEN doc_id % 2 = 0 THEN 'metadata_status=error' ELSE 'ok' END AS health FROM documents""",
    "markdown_functions": f"""SELECT doc_id, e'# head\\n## A\\n- k: v' || doc_id || e'\\n- only\\n- k: w' || doc_id || e'\\n## B\\nplain\\n' AS body, 'T' || doc_id AS title, 'plain' AS b, 'k: v' || doc_id || '|only|k: w' || doc_id AS bullets, 'w' || doc_id AS k, '- plain' AS as_bullets, {_MD} AS trimmed FROM documents""",
    "date_functions": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS parsed,
CASE WHEN event_id % 5 = 1 THEN strftime(ts, '%Y-%m-%d %H:%M U') WHEN event_id % 5 = 4 THEN substr('no date ' || strftime(ts, '%Y'), 1, 10) ELSE strftime(ts, '%Y-%m-%d') END AS published,
CASE WHEN value IS NOT NULL THEN CASE WHEN floor(value * 40) >= 6000 THEN CAST(CAST(floor(value * 40) AS BIGINT) // 60 AS VARCHAR) ELSE lpad(CAST(CAST(floor(value * 40) AS BIGINT) // 60 AS VARCHAR), 2, '0') END || ':' || lpad(CAST(CAST(floor(value * 40) AS BIGINT) % 60 AS VARCHAR), 2, '0') END AS clock,
CAST(DATE '1970-01-01' + CAST(event_id AS INTEGER) AS VARCHAR) AS day, strftime(ts, '%Y-%m-%d %H:%M UTC') AS label FROM events""",
    "cycle_table": f"WITH {_PK}, best AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY power DESC, snr DESC, amplitude DESC, period_days) AS place FROM c) SELECT series, k, place, CAST(round_even(period_days, 0) AS INTEGER) AS days FROM best WHERE place <= 12",
    "cycle_sorted": f"WITH {_PK} SELECT series, k, row_number() OVER (PARTITION BY series ORDER BY coalesce(CASE WHEN k % 3 <> 0 THEN round(snr, 1) END, 0) DESC, period_days DESC) AS place FROM c",
    "cycle_matched": f"WITH {_PK} SELECT series, k, k % 8 = 0 AS selected FROM c",
    "cycle_filled": f"""WITH {DAILY}, m AS (SELECT * FROM s WHERE dayofweek(ts) = 1), g AS (SELECT DISTINCT m.series, s.ts FROM (SELECT DISTINCT series FROM m) m, s), j AS (SELECT g.series, g.ts, m.value FROM g LEFT JOIN m ON m.series = g.series AND m.ts = g.ts)
SELECT series, CAST(ts AS VARCHAR) AS ts, round(coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS value FROM j""",
    "cycle_cumulative": f"WITH {SIGNAL} SELECT series, CAST(ts AS VARCHAR) AS ts, round(sum(value) OVER (PARTITION BY series ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS total FROM t",
    "cycle_superposed": f"WITH {WEEKLY} SELECT series, CAST(ts AS VARCHAR) AS ts, ts > min(ts) OVER (PARTITION BY series) + 2000 AS projection, round(3 * value, 4) AS value FROM r",
}
