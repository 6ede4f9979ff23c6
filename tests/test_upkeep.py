"""Upkeep operators, Markdown and stems on fixtures."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.functions.stem import stem_word, stemmed
from tidewell.operators import search as X
from tidewell.operators import upkeep as U
from tidewell.plans import index

NOW = dt.datetime(2025, 3, 1)


def test_backfill_modes(spark):
    rows = spark.createDataFrame([("missing_section:A", NOW - dt.timedelta(days=20)), ("missing_source_key:Video_Id ", None), ("missing_source_key:topic", None)], "r string, p timestamp")
    made = lambda mode: [tuple(r["b"]) for r in rows.select(U.backfill(F.col("r"), F.col("p"), F.lit(NOW), mode).alias("b")).collect()]
    assert made("soft") == [(False, "soft_outside_window:14d"), (True, "hard_invalid"), (True, "soft_unknown_reference_time")]
    assert made("off") == [(False, "mode_off"), (True, "hard_invalid"), (False, "mode_off")]
    assert made(" FULL ")[0] == (True, "mode_full") and made("other") == made("soft")


def test_retention(spark):
    rows = spark.createDataFrame([("a", NOW - dt.timedelta(days=31)), ("b", NOW - dt.timedelta(days=30)), ("c", NOW)], "path string, modified timestamp")
    assert [r["path"] for r in U.expired(rows, F.lit(NOW)).collect()] == ["a"]
    assert U.expired(rows, F.lit(NOW), None).count() == 0
    with pytest.raises(ValueError):
        U.expired(rows, F.lit(NOW), -1)


def test_channel_inputs(spark):
    cases = {"UC" + "a" * 22: ("channel", "UC" + "a" * 22), "https://www.youtube.com/channel/UCx": ("channel", "UCx"), "https://www.youtube.com/watch?t=1&v=abc": ("video", "abc"), "https://youtu.be/xyz": ("video", "xyz"), " @Name ": ("handle", "name")}
    for text, wanted in cases.items():
        assert tuple(spark.range(1).select(U.channel_input(F.lit(text)).alias("c")).first()["c"]) == wanted


def test_cache_ids_and_runs(spark):
    cache = spark.createDataFrame([("a", "1", NOW - dt.timedelta(days=29)), ("b", "2", NOW - dt.timedelta(days=30))], "key string, id string, last_verified timestamp")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "key string")
    assert {tuple(r) for r in U.cached_ids(asked, cache, F.lit(NOW)).collect()} == {("a", "1"), ("b", None), ("c", None)}
    import hashlib

    configs = spark.createDataFrame([(2, "y", "two"), (1, "x", "one")], "seq int, name string, body string")
    assert U.config_set_id(configs).first()["id"] == "x+y__cs-" + hashlib.sha256(b"one\0two").hexdigest()[:12]
    names = lambda *n: U.latest_run(spark.createDataFrame([(x,) for x in n], "name string")).first()["name"]
    assert names("run_2", "run_1", "other") == "run_2" and names("run_9", "a__1", "b__1") == "b__1" and names("other") is None
    state = lambda s, e, a, t: tuple(spark.range(1).select(U.run_state(F.lit(s), F.lit(e).cast("int"), F.lit(a).cast("boolean"), F.lit(t).cast("string"), ["Block detected"]).alias("r")).first()["r"])
    assert state("running", None, True, "fine") == ("running", False) and state("running", 0, True, None) == ("finished", False) and state(None, None, None, "IP Block detected!") == ("unknown", True)


def test_file_merge(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "name string, content string")
    new = spark.createDataFrame([("b", "x"), ("c", "y")], "name string, content string")
    assert {tuple(r) for r in U.merge_files(old, new).collect()} == {("a", "move"), ("b", "delete"), ("c", "keep")}


def test_summaries(spark):
    stock = lambda k: {"canonical": f"S{k}", "why_covered": f"w{k}", "evidence": [{"quote": "q1"}, {"x": 1}, {"quote": "q3"}]}
    body = {"video_id": "v", "source": {"channel_namespace": "c"}, "knowledge_items": [{"text": "k"}, {"text": ""}], "stocks_covered": [stock(k) for k in range(12)] + [{"canonical": " "}], "macro_insights": [{"claim": f"m{k}"} for k in range(7)] + [{}]}
    rows = spark.createDataFrame([(json.dumps(body),), ("{}",), (None,)], "payload string")
    row = U.compact_summaries(rows).where("video = 'v'").first()
    assert len(row["stocks"]) == 10 and row["stocks"][0]["quotes"] == ["q1"] and row["claims"] == [f"m{k}" for k in range(5)]
    (high,) = U.highlights(rows).collect()
    assert high["lines"] == ["- k", "- **S0**: w0", "- **S1**: w1", "- **S2**: w2", "- **S3**: w3", "- ... (15 more)"]


def test_limits(spark):
    prompts = spark.createDataFrame([("m", "x" * 44), ("m", "x" * 40), ("none", "x" * 400)], "model string, text string")
    limits = spark.createDataFrame([("m", 10)], "model string, max_tokens int")
    assert sorted((r["model"], len(r["text"]), r["over"]) for r in U.over_limit(prompts, limits).collect()) == [("m", 40, False), ("m", 44, True), ("none", 400, False)]


def test_crawl(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("b", "a"), ("a", "x/no")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    ok = lambda c: ~F.col(c).endswith("no")
    assert {tuple(r) for r in U.crawl(links, seeds, 2, ok).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r["url"] for r in U.crawl(links, seeds, 9, ok, most=2).collect()] == ["a", "b"]


def test_markdown_of_pages(spark):
    html = "<html><head><title> A  page </title><style>p{}</style></head><body><h1>Top</h1><p>one <a href='/x'>link</a> &amp; more</p><ul><li>i<li>j</ul><script>no()</script><h2>Sub</h2>tail</body></html>"
    assert X.markdown_of(html) == ("A page", "# Top\n\none [link](/x) & more\n\n- i\n\n- j\n\n## Sub\n\ntail\n")
    rows = X.pages_to_markdown(spark.createDataFrame([(1, None), (2, html)], "page_id long, html string")).orderBy("page_id").collect()
    assert tuple(rows[0]) == (1, None, "\n") and rows[1]["title"] == "A page"


CASES = "caresses:caress ponies:poni ties:ti cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat rational:ration digitizer:digit operator:oper decisiveness:decis hopefulness:hope sensibiliti:sensibl triplicate:triplic electrical:electr goodness:good revival:reviv adoption:adopt replacement:replac activate:activ probate:probat rate:rate cease:ceas controll:control roll:roll is:is naïve:naïve"


def test_stems(spark):
    pairs = [c.split(":") for c in CASES.split()]
    assert [stem_word(a) for a, _ in pairs] == [b for _, b in pairs]
    df = spark.createDataFrame([(a,) for a, _ in pairs] + [(None,)], "t string")
    assert {r["s"] for r in df.select(stemmed("t").alias("s")).collect()} == {b for _, b in pairs} | {None}


def test_postings_of_asked_stems_only(spark):
    texts = [(1, "Connected connection, other"), (2, "connecting connect connects"), (3, "con 7 été"), (4, None), (5, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = X.stemmed_postings(docs, ["connection", "été", "absent"], "doc_id")
    assert sorted(map(tuple, rows.select("term", "id", "dl", "tf").collect())) == [("connect", 1, 3, 2), ("connect", 2, 3, 3), ("été", 3, 3, 1)]
    # What is dealt doesn't grow with the other words.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (connect" in plan or "INSET connect" in plan
    assert X.stemmed_postings(docs, ["absent"], "doc_id").count() == 0


def test_stems_keep_the_first_letter():
    made = random.Random(7)
    ends = ["", "s", "sses", "ies", "eed", "ed", "ing", "y", "ational", "izer", "biliti", "icate", "ness", "ement", "ion", "e", "ll"]
    words = ["".join(made.choices("abeilosty", k=made.randint(0, 4))) + made.choice(ends) + made.choice(ends) for _ in range(20_000)]
    assert not [w for w in words if stem_word(w)[:1] != w[:1]]


def test_pages_reach_python_in_small_batches(spark, tmp_path, monkeypatch):
    spark.range(5000).coalesce(1).selectExpr("id AS page_id", "concat('<p>', id, repeat(' word', 800)) AS html").write.parquet(str(tmp_path / "pages.parquet"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": [0], "idx": pa.array([b.num_rows], pa.int32()), "heading_path": [""], "char_len": pa.array([b.nbytes], pa.int32())})

    whole = X.chunk_documents
    monkeypatch.setattr(X, "chunk_documents", lambda docs: docs.mapInArrow(sizes, "doc_id long, idx int, heading_path string, char_len int"))
    rows = index.page_markdown(spark, str(tmp_path)).collect()
    assert sum(r["idx"] for r in rows) == 5000 and max(r["idx"] for r in rows) <= 2000 and max(r["char_len"] for r in rows) < 10 << 20
    monkeypatch.setattr(X, "chunk_documents", whole)
    made = index.page_markdown(spark, str(tmp_path))
    assert made.select("doc_id").distinct().count() == 5000
