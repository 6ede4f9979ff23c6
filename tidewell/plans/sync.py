"""Stored vectors and postings, lookups, crawling by rules, moves to cold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import clamp
from tidewell.functions.text import wrapped_records as records_of
from tidewell.operators import corpus as C
from tidewell.operators import search as X
from tidewell.operators import upkeep as U
from tidewell.operators import vector_store as V
from tidewell.plans.index import TERMS
from tidewell.plans.tables import rounded, table

MODEL = "model-a:1024"


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder; one of this machine only
    where the session names none, as in local runs."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against the vectors of those that have labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return V.with_hits(docs, known.select(V.vector_key(MODEL, F.col("text")).alias("key")), MODEL).select("doc_id", "key", "hit")


def vector_cache_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through a stored table of vectors: what is missing is
    computed (here two numbers a text), then read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def embed(missing: DataFrame) -> DataFrame:
        return missing.select("key", F.array(F.length("text"), F.regexp_count("text", F.lit(" "))).cast("array<float>").alias("vector"))

    path = _shared(spark, "vectors")
    V.embed_cached(docs.where("doc_id % 2 = 0"), path, MODEL, embed)
    found = V.embed_cached(docs, path, MODEL, embed)
    return found.select("doc_id", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("spaces"))


def _versions(docs: DataFrame) -> DataFrame:
    """Each document in snapshot a; those with labels' parity in b too."""
    first = docs.select(F.col("doc_id").alias("chunk_id"), "source", F.lit("a").alias("snapshot"), "lang")
    second = first.where("chunk_id % 3 <> 0").withColumn("snapshot", F.lit("b"))
    return first.unionByName(second).select("chunk_id", "source", "snapshot", F.concat_ws(" ", "lang", "snapshot").alias("title"))


def _stored_search(spark: SparkSession, sf_dir: str, source: str | None, snapshot: str | None, top_k: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = _shared(spark, "postings")
    X.write_postings(docs.select(F.col("doc_id").alias("chunk_id"), "source", "text"), path)
    asked = spark.createDataFrame(TERMS, "query string, term string")
    return rounded(X.search_stored(path, asked, _versions(docs), source, snapshot, top_k), 9)


def search_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored postings of one source, versions of one snapshot."""
    return _stored_search(spark, sf_dir, "src0", "b", 15)


def search_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources; documents appear with each of their versions."""
    return _stored_search(spark, sf_dir, None, None, 15)


def _chunks(docs: DataFrame) -> DataFrame:
    """Lines as chunks."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "line"))
    return lines.select("doc_id", "idx", F.concat_ws("-", "doc_id", "idx").alias("chunk_id"), F.md5("line").alias("heading_path"))


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chunk of every labelled document, with its newest version."""
    docs = table(spark, sf_dir, "documents")
    versions = _versions(docs).withColumn("chunk_id", F.concat_ws("-", "chunk_id", F.lit("0")))
    asked = table(spark, sf_dir, "labels").select(F.concat_ws("-", "doc_id", F.lit("0")).alias("chunk_id"))
    return X.chunk_by_id(asked, _chunks(docs), versions)


def document_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document with its chunks in order."""
    docs = table(spark, sf_dir, "documents")
    found = X.document_by_id(table(spark, sf_dir, "labels"), docs.select("doc_id", "lang"), _chunks(docs))
    return found.select("doc_id", "lang", F.size("parts").alias("n"), F.sha2(F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["chunk_id"], p["heading_path"])), ","), 256).alias("parts"))


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as snapshots of their priority: the last twenty of one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").alias("snapshot"), F.col("o_orderdate").alias("started"))
    return X.snapshot_list(rows, "1-URGENT", 20).select("snapshot", "place")


def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of line items between five hosts, with a rule a nation; the rules
    of the last host could not be read."""
    _shared(spark, "crawl")
    url = lambda c: F.concat(F.lit("https://h"), F.col(c) % 5, F.lit(".org/p/"), F.col(c))
    links = table(spark, sf_dir, "lineitem").select(url("l_partkey").alias("src"), url("l_suppkey").alias("dst"))
    host = F.concat(F.lit("h"), F.col("n_nationkey") % 5, F.lit(".org"))
    rules = table(spark, sf_dir, "nation").select(host.alias("host"), F.col("n_nationkey").alias("seq"), (F.col("n_nationkey") % 2 == 0).alias("allow"), F.concat(F.lit("/p/"), F.col("n_nationkey")).alias("prefix"))
    hosts = rules.select("host").where("host <> 'h4.org'").distinct()
    seeds = table(spark, sf_dir, "supplier").select(url("s_suppkey").alias("url"))
    return U.crawl(links, seeds, 3, permitted=lambda urls: U.robots_allowed(urls, rules, hosts))


def _cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of old years are to go cold; some are there, some nowhere."""
    rows = table(spark, sf_dir, "orders").withColumn("video", F.col("o_orderkey").cast("string"))
    wanted = rows.where("o_orderdate < TIMESTAMP '1996-01-01'")
    return C.cold_plan(wanted, rows.where("o_orderstatus <> 'O' AND o_custkey % 2 = 0"), rows.where("o_totalprice < 50000"))


def cold_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cold(spark, sf_dir)


def cold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cold_counts(_cold(spark, sf_dir))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON summaries: each line a stock, an item and a claim."""
    lines = F.split("text", "\n")
    stock = lambda x: F.struct(x.alias("canonical"), F.col("lang").alias("why_covered"), F.array(F.struct(x.alias("quote"))).alias("evidence"))
    body = F.struct(
        F.col("doc_id").cast("string").alias("video_id"), F.struct(F.col("source").alias("channel_namespace")).alias("source"), F.transform(lines, lambda x: F.struct(x.alias("text"))).alias("knowledge_items"),
        F.transform(lines, stock).alias("stocks_covered"), F.transform(lines, lambda x: F.struct(x.alias("claim"))).alias("macro_insights"),
    )
    return table(spark, sf_dir, "documents").select(F.to_json(body).alias("payload"))


def summary_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten stocks with their quotes and five claims of each summary."""
    found = U.compact_summaries(_payloads(spark, sf_dir))
    stocks = F.array_join(F.transform("stocks", lambda s: F.concat_ws("|", s["canonical"], s["why"], F.array_join(s["quotes"], "|"))), "\n")
    return found.select("video", "channel", F.md5(stocks).alias("stocks"), F.md5(F.array_join("claims", "\n")).alias("claims"))


def summary_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines of each summary, and how many more there are."""
    return U.highlights(_payloads(spark, sf_dir)).select("video", F.array_join("lines", "\n").alias("lines"))


def topic_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are left when the documents of a source are purged."""
    gone = table(spark, sf_dir, "documents").where("source = 'src0'").select("doc_id")
    return X.without_children(table(spark, sf_dir, "labels"), gone, "doc_id").select("doc_id")


def value_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(table(spark, sf_dir, "events").select("event_id", clamp(F.col("value"), 10, 60).alias("both"), clamp(F.col("value"), low=20).alias("low")))


def wrapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents in one text, one with front matter."""
    text = F.concat(F.lit("<<<DOC_START>>>\n---\ntopic: "), "source", F.lit("\nlang: "), F.coalesce("lang", F.lit("")), F.lit("\n---\n"), F.md5("text"), F.lit("\n<<<DOC_END>>>\nbetween\n<<<DOC_START>>>\nplain "), F.col("doc_id"), F.lit("\n<<<DOC_END>>>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(records_of(text, {"topic": "unknown", "lang": "none"})).alias("place", "x"))
    return rows.select("doc_id", "place", "x.*")


QUERIES = {f.__name__: f for f in (summary_compact, summary_highlights, topic_purge, value_clamp, wrapped_records, vector_cache, vector_cache_fill, search_filtered, search_versions, chunk_lookup, document_lookup, snapshot_list, crawl_robots, cold_plan, cold_counts)}

_V = """v AS (SELECT doc_id AS id, source, 'a' AS snapshot, concat_ws(' ', lang, 'a') AS title FROM documents UNION ALL SELECT doc_id, source, 'b', concat_ws(' ', lang, 'b') FROM documents WHERE doc_id % 3 <> 0)"""
_FOUND = """WITH tok AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS l FROM documents), st AS (SELECT count(*) AS total, avg(len(l)) AS average FROM tok),
po AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT doc_id AS id, len(l) AS dl, unnest(l) AS term FROM tok) GROUP BY ALL), asked(query, term) AS (VALUES {terms}),
df AS (SELECT term, count(*) AS n FROM po GROUP BY term), wanted AS (SELECT query, count(*) AS wanted FROM asked GROUP BY query),
sc AS (SELECT a.query, po.id, round(sum(-greatest(ln((total - n + 0.5) / (n + 0.5)), {least}) * tf * {k1} / (tf + {k} * ({b1} + {b} * dl / average))), 9) AS score, count(*) AS terms FROM asked a JOIN po ON po.term = a.term JOIN df ON df.term = a.term, st GROUP BY ALL),
{v},
f AS (SELECT sc.query, sc.id, source, snapshot, title, row_number() OVER (PARTITION BY sc.query ORDER BY score, sc.id, snapshot) AS place FROM sc JOIN wanted w ON w.query = sc.query AND terms = wanted JOIN v ON v.id = sc.id{where}),
g AS (SELECT query, id, min(place) AS place, arg_max(source, snapshot) AS source, max(snapshot) AS snapshot, arg_max(title, snapshot) AS title FROM f WHERE place <= 60 GROUP BY query, id),
h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY 1.0 / ({fusion} + place) DESC, id) AS rank FROM g)
SELECT query, CAST(rank AS INTEGER) AS rank, round(1.0 / ({fusion} + place), 9) AS score, id AS chunk_id, source, snapshot, title FROM h WHERE rank <= 15"""
_SEARCH = dict(terms=", ".join(f"('{q}', '{t}')" for q, t in TERMS), least=X.LEAST_IDF, k1=X.K1 + 1, k=X.K1, b1=1 - X.B, b=X.B, fusion=X.FUSION_K, v=_V)
_CHUNKS = "c AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx, unnest(string_split(text, chr(10))) AS line FROM documents)"
_PLAN = """w AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS video, o_orderstatus <> 'O' AND o_custkey % 2 = 0 AS here, o_totalprice < 50000 AS there FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'),
p AS (SELECT video, CASE WHEN here AND there THEN 'replace' WHEN here THEN 'move' WHEN there THEN 'done' ELSE 'absent' END AS step FROM w)"""

_LINES = "l AS (SELECT CAST(doc_id AS VARCHAR) AS video, source, lang, string_split(text, chr(10)) AS ls FROM documents)"

ORACLES = {
    "summary_compact": f"""WITH {_LINES} SELECT video, coalesce(source, 'unknown') AS channel, md5(array_to_string([concat_ws('|', x, lang, x) FOR x IN ls[1:10] IF trim(x, ' ') <> ''], chr(10))) AS stocks, md5(array_to_string(ls[1:5], chr(10))) AS claims FROM l""",
    "summary_highlights": f"""WITH {_LINES}, h AS (SELECT video, ['- ' || x FOR x IN ls IF x <> ''] || (CASE WHEN coalesce(lang, '') <> '' THEN ['- **' || x || '**: ' || lang FOR x IN ls IF x <> ''] ELSE [] END) || ['- *Macro*: ' || x FOR x IN ls IF x <> ''] AS a FROM l)
SELECT video, array_to_string(a[1:5], chr(10)) || CASE WHEN len(a) > 5 THEN chr(10) || '- ... (' || len(a) - 5 || ' more)' ELSE '' END AS lines FROM h WHERE len(a) > 0""",
    "topic_purge": "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')",
    "value_clamp": "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN least(greatest(value, 10), 60) END, 6) AS both, round(CASE WHEN value IS NOT NULL THEN greatest(value, 20) END, 6) AS low FROM events",
    "wrapped_records": "SELECT doc_id, CAST(0 AS INTEGER) AS place, source AS topic, coalesce(nullif(lang, ''), 'none') AS lang, md5(text) AS body FROM documents UNION ALL SELECT doc_id, 1, 'unknown', 'none', 'plain ' || doc_id FROM documents",
    "vector_cache": f"WITH k AS (SELECT doc_id, sha256('{MODEL}') || '__' || sha256(text) AS key FROM documents) SELECT doc_id, key, key IN (SELECT key FROM k WHERE doc_id IN (SELECT doc_id FROM labels)) AS hit FROM k",
    "vector_cache_fill": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS spaces FROM documents",
    "search_filtered": _FOUND.format(where=" AND source = 'src0' AND snapshot = 'b'", **_SEARCH),
    "search_versions": _FOUND.format(where="", **_SEARCH),
    "chunk_lookup": f"WITH {_CHUNKS} SELECT c.doc_id, CAST(idx AS INTEGER) AS idx, c.doc_id || '-0' AS chunk_id, md5(line) AS heading_path, CASE WHEN c.doc_id % 3 <> 0 THEN 'b' ELSE 'a' END AS snapshot, concat_ws(' ', lang, CASE WHEN c.doc_id % 3 <> 0 THEN 'b' ELSE 'a' END) AS title FROM c JOIN documents d ON d.doc_id = c.doc_id WHERE idx = 0 AND c.doc_id IN (SELECT doc_id FROM labels)",
    "document_lookup": f"WITH {_CHUNKS} SELECT d.doc_id, any_value(lang) AS lang, CAST(count(idx) AS INTEGER) AS n, sha256(coalesce(string_agg(c.doc_id || '-' || idx || ':' || md5(line), ',' ORDER BY idx), '')) AS parts FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM labels) GROUP BY d.doc_id",
    "snapshot_list": "SELECT o_orderkey AS snapshot, CAST(row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY place <= 20",
    "crawl_robots": """WITH RECURSIVE n AS (SELECT DISTINCT x FROM (SELECT l_suppkey AS x FROM lineitem UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT l_partkey FROM lineitem)),
f AS (SELECT x, arg_min(n_nationkey % 2 = 0, n_nationkey) AS allow FROM n JOIN nation ON n_nationkey % 5 = x % 5 AND starts_with('/p/' || x, '/p/' || n_nationkey) GROUP BY x),
ok AS (SELECT n.x FROM n LEFT JOIN f ON f.x = n.x WHERE n.x % 5 <> 4 AND coalesce(allow, true)),
l AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_suppkey IN (SELECT x FROM ok)),
w AS (SELECT s_suppkey AS x, 0 AS depth FROM supplier WHERE s_suppkey IN (SELECT x FROM ok) UNION SELECT dst, depth + 1 FROM w JOIN l ON src = x WHERE depth < 3)
SELECT 'https://h' || x % 5 || '.org/p/' || x AS url, min(depth) AS depth FROM w GROUP BY x""",
    "cold_plan": f"WITH {_PLAN} SELECT video, step FROM p",
    "cold_counts": f"WITH {_PLAN} SELECT count(*) AS old_candidates, count(*) FILTER (WHERE step IN ('move', 'replace')) AS cold_moved, count(*) FILTER (WHERE step = 'done') AS already_cold, count(*) FILTER (WHERE step = 'absent') AS absent FROM p",
}
