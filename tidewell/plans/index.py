"""Document index, retrieval, text functions and telemetry over the tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions.stem import stemmed
from tidewell.operators import monitor as M
from tidewell.operators import retrieval as R
from tidewell.operators import search as X
from tidewell.operators import upkeep as U
from tidewell.operators.batches import arrow_batches
from tidewell.plans.tables import rounded, table

TERMS = [("q1", "that"), ("q1", "hest"), ("q2", "licensed"), ("q3", "ergebnis"), ("q3", "der"), ("q4", "avec")]
LIMITS = {"value": 90.0, "twice": 150.0}
REASONS = ("missing_section:Summary", "missing_source_key:topic", "missing_source_key:video_id", "mismatch:title")


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown made from documents: a heading before every fifth line."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## part "), i.cast("string"), F.lit("\n"), x)).otherwise(x))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))
    return X.with_chunk_ids(X.chunk_documents(docs)).select("doc_id", "idx", "heading_path", "char_len", "text_hash", "chunk_id")


def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = X.postings(docs, "doc_id", sorted({t for _, t in TERMS}))
    total, average = docs.select(F.count(F.lit(1)), F.avg(F.size(X.words(F.col("text"))).cast("double"))).first()
    found = X.bm25(index, spark.createDataFrame(TERMS, "query string, term string"), total, average)
    return rounded(X.ranked(rounded(found, 9), 50)).select("query", "id", "rank", "score")


def search_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of the same documents, fused: by words and by length."""
    docs = table(spark, sf_dir, "documents").where("n_chars > 0")
    lists = [docs.select(F.lit(n).alias("list"), F.lit("q").alias("query"), F.col("doc_id").alias("id"), o.alias("score")) for n, o in (("long", -F.col("n_chars")), ("new", -F.col("doc_id")))]
    both = lists[0].unionByName(lists[1])
    rows = X.ranked(both.withColumn("key", F.concat("list", "query")), 100, "key")
    return rounded(X.fuse(rows), 9)


def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("content_hash"))
    current = docs.where("doc_id % 7 <> 1").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    incoming = docs.where("doc_id % 11 <> 2").withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    return X.upsert(current, incoming, "doc_id", ["content_hash", "lang"])


def index_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    first = docs.withColumns({"snapshot": F.lit("a"), "started": F.lit(1), "content_hash": F.lit("old")})
    second = docs.where("doc_id % 4 <> 0").withColumns({"snapshot": F.lit("b"), "started": F.lit(2)})
    return X.changed_documents(docs.where("doc_id % 6 <> 0"), first.unionByName(second, allowMissingColumns=False)).select("doc_id")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("id"), R.normalized(F.col("embedding")).alias("v"))
    queries = corpus.where("id < 20").select(F.col("id").alias("query"), "v")
    asked = rows.where("vec_id < 20").select(F.col("vec_id").alias("query"), "label")
    qrels = rows.join(F.broadcast(asked), "label").where("vec_id <> query").select("query", F.col("vec_id").alias("id"))
    return corpus, queries, qrels


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries, _ = _vectors(spark, sf_dir)
    return rounded(R.nearest(queries, corpus, 20), 9)


def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries, qrels = _vectors(spark, sf_dir)
    return rounded(R.quality(R.nearest(queries, corpus, 20), qrels))


def vector_prefix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries, qrels = _vectors(spark, sf_dir)
    short = R.normalized(R.prefix(F.col("v"), 16))
    return rounded(R.quality(R.nearest(queries.withColumn("v", short), corpus.withColumn("v", short), 20), qrels))


def vector_projection_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries, qrels = _vectors(spark, sf_dir)
    made = R.normalized(R.random_projection(F.col("v"), 64, 16))
    return rounded(R.quality(R.nearest(queries.withColumn("v", made), corpus.withColumn("v", made), 20), qrels))


def vector_pca_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries, qrels = _vectors(spark, sf_dir)
    reduce = R.pca(corpus, 16)
    return rounded(R.quality(R.nearest(reduce(queries), reduce(corpus), 20), qrels), 3)


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", T.title(F.col("html")).alias("title"), F.size(T.hrefs(F.col("html"))).alias("n_links"), F.array_join(T.hrefs(F.col("html")), " ").alias("links"))


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(t, 220).alias("snippet"), T.truncated(t, 40, " ...").alias("cut"), T.approx_tokens(t, 1).alias("tokens"), T.slug(t, 30).alias("slug"), T.sha_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


def document_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords_found(t, ["that", "Licensed", "der"]), ",").alias("found"), F.size(T.keyword_lines(t, ["that", "Licensed"])).alias("n_lines"))


def conversation_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First system and last user message of each conversation."""
    role = lambda r: F.when(F.col("role") == r, F.col("turn"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.min_by("text", role("system")).alias("first_system"), F.max_by("text", role("user")).alias("last_user"), F.count(F.lit(1)).alias("turns"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    reading = F.when(F.col("event_id") % 9 != 0, F.col("value"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("seq"), reading.alias("value"), (2 * reading).alias("twice"))


def monitor_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.alerts(_samples(spark, sf_dir), LIMITS).select("seq", F.array_join("reasons", ";").alias("reasons"))


def monitor_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.breach_runs(_samples(spark, sf_dir), "value", 40.0, 3).select("seq", "consecutive", "fired")


def monitor_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.delta(_samples(spark, sf_dir), "value", "change").select("seq", "change"))


def monitor_cpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("host"), "ts", F.col("event_id").alias("seq"), (F.col("event_id") * 10).alias("total"), F.col("event_id") * F.lit(7) + F.floor("value"))
    rows = rows.toDF("host", "ts", "seq", "total", "idle")
    return M.cpu_percent(rows).select("seq", "cpu_pct")


def monitor_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.wait_summary(table(spark, sf_dir, "events"), "event_type", "value"))


def monitor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as starts, later clicks of the user as ends."""
    kind = F.when(F.col("event_type") == "purchase", "start").when(F.col("event_type") == "click", "end")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("log"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), kind.alias("kind")).where("kind IS NOT NULL")
    return M.pair_starts(rows)


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra: hourly windows of events by type, the batch twin of the stream."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("start"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rounded(rows.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), 4)


def search_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``search_bm25``, over stems."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = X.stemmed_postings(docs, [t for _, t in TERMS], "doc_id")
    path = f"{_checkpoints(spark)}/stemmed-{uuid.uuid4().hex}"
    made.write.parquet(path)  # read twice: for its counts and for its scores
    index = spark.read.schema(made.schema).parquet(path)
    total, average = docs.select(F.count(F.lit(1)), F.avg(F.size(X.words(F.col("text"))).cast("double"))).first()
    asked = spark.createDataFrame(TERMS, "query string, term string").withColumn("term", stemmed("term"))
    return rounded(X.ranked(rounded(X.bm25(index, asked, total, average), 9), 50)).select("query", "id", "rank", "score")


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, cut into chunks under their headings."""
    made = X.pages_to_markdown(table(spark, sf_dir, "pages"))
    parts = X.chunk_documents(made.select(F.col("page_id").alias("doc_id"), F.col("markdown").alias("text"))).select("doc_id", "idx", "heading_path", "char_len")
    path = f"{_checkpoints(spark)}/markdown-{uuid.uuid4().hex}"
    with arrow_batches(spark):  # batches are sized when rows are made, so they are made here
        parts.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(parts.schema).parquet(path)


def backfill_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (d % 4 + 1).cast("int"))
    published = F.when(d % 13 != 0, F.timestamp_seconds(F.lit(1704067200) + d % 60 * 86400))
    made = U.backfill(reason, published, F.to_timestamp(F.lit("2024-02-20")))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("b")).select("doc_id", "b.allowed", "b.why")


def crawl_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first over links from parts to the numbers of their suppliers."""
    _checkpoints(spark)
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    seeds = table(spark, sf_dir, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("url"))
    return U.crawl(links, seeds, 3)


def _checkpoints(spark: SparkSession) -> str:
    """The shared folder of the session; one of this machine only where the
    session names none, as in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


QUERIES = {
    f.__name__: f
    for f in (chunk_pages, search_bm25, search_fused, index_upsert, index_changed, vector_search, vector_quality, vector_prefix_quality, vector_projection_quality, vector_pca_quality, page_urls, page_links, document_text, document_keywords, conversation_ends, monitor_alerts, monitor_breaches, monitor_delta, monitor_cpu, monitor_waits, monitor_pairs, event_windows, search_stemmed, page_markdown, backfill_policy, crawl_depths)
}

_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


def _vector_sql(v: str) -> str:
    return f"""e AS (SELECT vec_id, label, {v} AS raw FROM embeddings), c AS (SELECT vec_id AS id, label, list_transform(raw, lambda x: CAST(x AS DOUBLE) / greatest(sqrt({_DOT.format(a="raw", b="raw")}), 1e-12)) AS v FROM e),
p AS (SELECT q.id AS query, c.id, round({_DOT.format(a="q.v", b="c.v")}, 12) AS score FROM c q, c WHERE q.id < 20 AND q.id <> c.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM p), f AS (SELECT * FROM k WHERE rank <= 20)"""


_QUALITY = """rel AS (SELECT q.id AS query, c.id FROM c q JOIN c ON c.label = q.label AND c.id <> q.id WHERE q.id < 20),
w AS (SELECT query, count(*) AS n FROM rel GROUP BY query),
h AS (SELECT f.query, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM f JOIN rel ON rel.query = f.query AND rel.id = f.id GROUP BY f.query),
j AS (SELECT w.query, first, coalesce(dcg, 0) / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))) AS nd FROM w LEFT JOIN h ON h.query = w.query)
SELECT """ + ", ".join(f"round(avg(CASE WHEN first <= {c} THEN 1.0 ELSE 0.0 END), 6) AS hit_rate_{c}" for c in R.CUTS) + ", round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 6) AS mrr_10, round(avg(nd), 6) AS ndcg_10 FROM j"
_SAMPLES = "s AS (SELECT user_id AS host, ts, event_id AS seq, CASE WHEN event_id % 9 <> 0 THEN value END AS value FROM events)"
_TERMS = ", ".join(f"('{q}', '{t}')" for q, t in TERMS)
_KEY = "(?i)(^|[^0-9A-Za-z_]){w}($|[^0-9A-Za-z_])"

ORACLES = {
    "search_bm25": f"""WITH tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM documents), st AS (SELECT count(*) AS total, avg(len(l)) AS average FROM tok),
po AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT doc_id AS id, len(l) AS dl, unnest(l) AS term FROM tok) GROUP BY ALL), asked(query, term) AS (VALUES {_TERMS}),
df AS (SELECT term, count(*) AS n FROM po GROUP BY term), wanted AS (SELECT query, count(*) AS wanted FROM asked GROUP BY query),
sc AS (SELECT a.query, po.id, round(sum(-greatest(ln((total - n + 0.5) / (n + 0.5)), {X.LEAST_IDF}) * tf * {X.K1 + 1} / (tf + {X.K1} * ({1 - X.B} + {X.B} * dl / average))), 9) AS score, count(*) AS terms FROM asked a JOIN po ON po.term = a.term JOIN df ON df.term = a.term, st GROUP BY ALL),
r AS (SELECT sc.query, id, score, row_number() OVER (PARTITION BY sc.query ORDER BY score, id) AS rank FROM sc JOIN wanted w ON w.query = sc.query AND terms = wanted) SELECT query, id, rank, round(score, 6) AS score FROM r WHERE rank <= 50""",
    "search_fused": f"""WITH a AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars > 0 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) FROM documents WHERE n_chars > 0)
SELECT 'q' AS query, id, round(sum(1.0 / ({X.FUSION_K} + r)), 9) AS score FROM a WHERE r <= 100 GROUP BY id""",
    "index_upsert": """WITH d AS (SELECT doc_id, lang, sha256(text) AS h FROM documents), j AS (SELECT doc_id, doc_id % 7 <> 1 AS old, doc_id % 11 <> 2 AS new, h, lang, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE h END AS oh, CASE WHEN doc_id % 3 <> 0 THEN lang END AS nl FROM d)
SELECT doc_id, CASE WHEN new THEN h ELSE oh END AS content_hash, CASE WHEN old THEN lang ELSE nl END AS lang, CASE WHEN NOT old THEN 'created' WHEN new AND h <> oh THEN 'updated' ELSE 'unchanged' END AS change FROM j WHERE old OR new""",
    "index_changed": "SELECT doc_id FROM documents WHERE doc_id % 6 <> 0 AND doc_id % 4 = 0",
    "vector_search": f"WITH {_vector_sql('embedding')} SELECT query, id, round(score, 9) AS score, rank FROM f",
    "vector_quality": f"WITH {_vector_sql('embedding')}, {_QUALITY}",
    "vector_prefix_quality": f"WITH {_vector_sql('embedding[1:16]')}, {_QUALITY}",
    "page_urls": """WITH a AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), b AS (SELECT page_id, CASE WHEN regexp_matches(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN u ELSE 'https://' || u END AS u FROM a),
c AS (SELECT page_id, lower(regexp_extract(u, '^([^:]+)://', 1)) AS s, lower(regexp_extract(u, '^[^:]+://([^/?]*)', 1)) AS h, regexp_extract(u, '^[^:]+://[^/?]*([^?;]*)', 1) AS p,
  array_to_string(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_') AND string_split(x, '=')[1] NOT IN ('gclid', 'fbclid', 'ref', 'source')), '&') AS q FROM b)
SELECT page_id, s || '://' || h || CASE WHEN p IN ('', '/') THEN '/' ELSE regexp_replace(p, '/$', '') END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM c""",
    "page_links": """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"''#]+)', 1) AS l, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages)
SELECT page_id, title, CAST(len(l) AS INTEGER) AS n_links, coalesce(array_to_string(l, ' '), '') AS links FROM a""",
    "document_text": """WITH a AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, CASE WHEN length(f) <= 220 THEN f ELSE rtrim(substr(f, 1, 219)) || '…' END AS snippet, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substr(text, 1, 40)) || ' ...' END AS cut, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens,
substr(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), 1, 30) AS slug, sha256(source || ':' || doc_id) AS id FROM a""",
    "document_keywords": f"""SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '{_KEY.format(w="that")}') THEN 'that' END, CASE WHEN regexp_matches(text, '{_KEY.format(w="Licensed")}') THEN 'Licensed' END, CASE WHEN regexp_matches(text, '{_KEY.format(w="der")}') THEN 'der' END) AS found,
CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_KEY.format(w="that")}'))) + len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_KEY.format(w="Licensed")}'))) AS INTEGER) AS n_lines FROM documents""",
    "conversation_ends": "SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'system') AS first_system, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user, count(*) AS turns FROM conversations GROUP BY conv_id",
    "monitor_alerts": f"WITH {_SAMPLES} SELECT seq, concat_ws(';', CASE WHEN value >= 90 THEN 'value>=90' END, CASE WHEN 2 * value >= 150 THEN 'twice>=150' END) AS reasons FROM s WHERE value >= 75",
    "monitor_breaches": f"""WITH {_SAMPLES}, a AS (SELECT *, value >= 40 AS b FROM s WHERE value IS NOT NULL), r AS (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (PARTITION BY host ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS run FROM a),
p AS (SELECT *, sum(CASE WHEN b THEN 1 ELSE 0 END) OVER (PARTITION BY host, run ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS place FROM r)
SELECT seq, CAST(CASE WHEN b THEN (place - 1) % 3 + 1 ELSE 0 END AS BIGINT) AS consecutive, b AND (place - 1) % 3 = 2 AS fired FROM p""",
    "monitor_delta": f"WITH {_SAMPLES} SELECT seq, round(value - last_value(value IGNORE NULLS) OVER (PARTITION BY host ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS change FROM s",
    "monitor_cpu": """WITH s AS (SELECT user_id AS host, ts, event_id AS seq, event_id * 10 AS total, event_id * 7 + CAST(floor(value) AS BIGINT) AS idle FROM events)
SELECT seq, CASE WHEN lag(total) OVER w IS NOT NULL THEN floor(((greatest(total - lag(total) OVER w, 1) - greatest(idle - lag(idle) OVER w, 0)) * 20000 + greatest(total - lag(total) OVER w, 1)) / (2 * greatest(total - lag(total) OVER w, 1))) / 100 END AS cpu_pct FROM s WINDOW w AS (PARTITION BY host ORDER BY ts, seq)""",
    "monitor_pairs": """WITH RECURSIVE e AS (SELECT user_id AS log, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS ts, event_type = 'purchase' AS first FROM events WHERE event_type IN ('purchase', 'click')),
r AS (SELECT *, row_number() OVER (PARTITION BY log ORDER BY ts, first DESC) AS rn FROM e),
q AS (SELECT log, CAST(0 AS BIGINT) AS rn, CAST([] AS DOUBLE[]) AS waiting, CAST(NULL AS DOUBLE) AS start, CAST(NULL AS DOUBLE) AS stop FROM (SELECT DISTINCT log FROM r) UNION ALL
  SELECT q.log, r.rn, CASE WHEN first THEN list_append(waiting, ts) ELSE waiting[2:] END, CASE WHEN NOT first THEN waiting[1] END, CASE WHEN NOT first THEN ts END FROM q JOIN r ON r.log = q.log AND r.rn = q.rn + 1),
z AS (SELECT log, arg_max(waiting, rn) AS waiting FROM q GROUP BY log)
SELECT log, start, stop AS "end" FROM q WHERE start IS NOT NULL UNION ALL SELECT log, unnest(waiting), NULL FROM z""",
    "monitor_waits": "SELECT event_type, count(value) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type",
    "backfill_policy": """WITH d AS (SELECT doc_id, doc_id % 4 < 2 AS soft, CASE WHEN doc_id % 13 <> 0 THEN TIMESTAMP '2024-01-01' + (doc_id % 60) * INTERVAL 1 DAY END AS p FROM documents)
SELECT doc_id, NOT soft OR p IS NULL OR p >= TIMESTAMP '2024-02-06' AS allowed, CASE WHEN NOT soft THEN 'hard_invalid' WHEN p IS NULL THEN 'soft_unknown_reference_time' WHEN p >= TIMESTAMP '2024-02-06' THEN 'soft_within_window' ELSE 'soft_outside_window:14d' END AS why FROM d""",
    "crawl_depths": """WITH RECURSIVE l AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem), w AS (SELECT p_partkey AS url, 0 AS depth FROM part WHERE p_partkey <= 3 UNION SELECT dst, depth + 1 FROM w JOIN l ON src = url WHERE depth < 3)
SELECT url, min(depth) AS depth FROM w GROUP BY url""",
    "event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
