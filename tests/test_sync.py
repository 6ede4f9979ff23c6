"""Vector cache, stored search, robots rules, scans with faults, cold moves."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import corpus as C
from tidewell.operators import search as X
from tidewell.operators import upkeep as U
from tidewell.operators import vector_store as V
from tidewell.operators.batches import slices
from tidewell.sources import transcripts as S


def test_vectors_are_computed_once(spark, tmp_path):
    asked = []

    def embed(missing):
        asked.append(sorted(r["text"] for r in missing.collect()))
        return missing.select("key", F.array(F.length("text")).alias("vector"))

    def run(texts, prefix="m"):
        rows = [(k, t) for k, t in enumerate(texts)]
        found = V.embed_cached(spark.createDataFrame(rows, "id int, text string"), str(tmp_path / "c"), prefix, embed)
        return [r["vector"] for r in found.orderBy("id").collect()]

    assert run(["a", "bb", "a", None, ""]) == [[1.0], [2.0], [1.0], None, [0.0]] and asked == [["", "a", "bb"]]
    assert run(["bb", "a", ""]) == [[2.0], [1.0], [0.0]] and len(asked) == 1
    assert run(["bb", "ccc"]) == [[2.0], [3.0]] and asked[1:] == [["ccc"]]
    assert run(["bb"], "other") == [[2.0]] and asked[2:] == [["bb"]]
    assert not [p for p in (tmp_path / "c").iterdir() if p.name.startswith("_staged")]
    hits = V.with_hits(spark.createDataFrame([("ccc",), ("d",)], "text string"), V.read_cache(spark, str(tmp_path / "c")), "m")
    assert sorted((r["text"], r["hit"]) for r in hits.collect()) == [("ccc", True), ("d", False)]


def test_stored_search_prunes_and_fans_out(spark, tmp_path):
    chunks = [(f"c{k}", s, t) for k, (s, t) in enumerate([("x", "red fox"), ("x", "red red fox runs far away"), ("y", "red fox"), ("y", "blue fox"), ("y", "green")])]
    X.write_postings(spark.createDataFrame(chunks, "chunk_id string, source string, text string"), str(tmp_path))
    versions = spark.createDataFrame([(c, s, v, f"{c} {v}") for c, s, _ in chunks for v in (("a", "b") if c != "c2" else ("a",))], "chunk_id string, source string, snapshot string, title string")
    asked = spark.createDataFrame([("q", "red"), ("q", "fox"), ("r", "blue")], "query string, term string")
    found = lambda **k: [(r["query"], r["rank"], r["chunk_id"], r["title"]) for r in X.search_stored(str(tmp_path), asked, versions, **k).orderBy("query", "rank").collect()]
    assert found(source="x") == [("q", 1, "c0", "c0 b"), ("q", 2, "c1", "c1 b")]
    assert found(snapshot="b") == [("q", 1, "c0", "c0 b"), ("q", 2, "c1", "c1 b"), ("r", 1, "c3", "c3 b")]
    assert found(snapshot="a", top_k=1) == [("q", 1, "c0", "c0 a"), ("r", 1, "c3", "c3 a")]
    every = X.search_stored(str(tmp_path), asked, versions).where("query = 'q'").orderBy("rank").collect()
    # c0 holds places 1 and 2 with its two versions, c2 the third.
    assert [(r["chunk_id"], round(1 / r["score"]) - X.FUSION_K) for r in every] == [("c0", 1), ("c2", 3), ("c1", 4)]
    plan = X.search_stored(str(tmp_path), asked, versions, source="x")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in plan and "PushedFilters: [In(term" in plan


def test_lookups(spark):
    docs = spark.createDataFrame([(1, "en"), (2, None), (3, "de")], "doc_id long, lang string")
    chunks = spark.createDataFrame([(1, 1, "b", "h"), (1, 0, "a", None), (3, 0, "c", "x")], "doc_id long, idx int, chunk_id string, heading_path string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (9,)], "doc_id long")
    got = {r["doc_id"]: [tuple(p) for p in r["parts"]] for r in X.document_by_id(asked, docs, chunks).collect()}
    assert got == {1: [(0, "a", None), (1, "b", "h")], 2: []}
    versions = spark.createDataFrame([("a", "s1", "old"), ("a", "s2", "new")], "chunk_id string, snapshot string, title string")
    rows = X.chunk_by_id(spark.createDataFrame([("a",), ("c",), ("z",)], "chunk_id string"), chunks, versions).collect()
    assert sorted((r["chunk_id"], r["snapshot"], r["title"]) for r in rows) == [("a", "s2", "new"), ("c", None, None)]
    snaps = spark.createDataFrame([("x", k, k % 3) for k in range(7)] + [("y", 9, 9)], "source string, snapshot int, started int")
    assert [r["snapshot"] for r in X.snapshot_list(snaps, "x", 3).orderBy("place").collect()] == [5, 2, 4]


def test_robots_rules(spark):
    rules = spark.createDataFrame([("a.org", 0, False, "/private"), ("a.org", 1, True, "/private/open"), ("a.org", 2, False, ""), ("b.org", 0, False, "/"), ("b.org", 1, True, "/x")], "host string, seq int, allow boolean, prefix string")
    hosts = spark.createDataFrame([("A.org",), ("b.org",), ("c.org",)], "host string")
    pages = ["https://a.org", "https://A.org/private/open/1", "https://a.org/private?x=1", "https://b.org/x", "https://b.org", "https://c.org/private", "https://unknown.org/"]
    urls = spark.createDataFrame([(u,) for u in pages], "url string")
    first = {r["url"] for r in U.robots_allowed(urls, rules, hosts).collect()}
    assert first == {"https://a.org", "https://c.org/private"}
    longest = {r["url"] for r in U.robots_allowed(urls, rules, hosts, longest=True).collect()}
    assert longest == first | {"https://A.org/private/open/1", "https://b.org/x"}


def test_crawl_keeps_to_the_rules(spark):
    links = spark.createDataFrame([("https://a.org/", "https://a.org/no/1"), ("https://a.org/no/1", "https://a.org/2"), ("https://a.org/", "https://a.org/3"), ("https://a.org/3", "https://a.org/2"), ("https://b.org/", "https://a.org/4")], "src string, dst string")
    rules = spark.createDataFrame([("a.org", 0, False, "/no")], "host string, seq int, allow boolean, prefix string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    seeds = spark.createDataFrame([("https://a.org/",), ("https://b.org/",)], "url string")
    found = U.crawl(links, seeds, 5, permitted=lambda u: U.robots_allowed(u, rules, rules.select("host")))
    assert sorted(tuple(r) for r in found.collect()) == [("https://a.org/", 0), ("https://a.org/2", 2), ("https://a.org/3", 1)]


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_scan_lists_faults(spark, tmp_path):
    a, b = "aaaaaaaaaaa", "bbbbbbbbbbb"
    put(tmp_path, f"r/1_transcripts/chan/2025-01-02_{a}.txt", "text")
    put(tmp_path, f"r/1_transcripts/chan/2025-01-02_{a}_meta.json", json.dumps({"published_at": "2025-03-04T05:06:07Z", "channel_handle": "@Some/one"}))
    put(tmp_path, f"r/data/transcripts/by_video_id/{a}.txt", "text")
    put(tmp_path, f"r/data/transcripts/by_video_id/{a}.meta.json", json.dumps({"published_date": "2025-03-04", "channel_handle": "@Some/one"}))
    put(tmp_path, f"r/legacy/transcripts/2024-05-06_{b}.txt", "text")
    put(tmp_path, f"r/1_transcripts/chan/{b}.txt", b"\xff\xfe bad")
    put(tmp_path, "r/1_transcripts/chan/noid.txt", "text")
    put(tmp_path, f"r/1_transcripts/odd/{b}.txt", "text")
    put(tmp_path, f"r/1_transcripts/odd/{b}.meta.json", "[1, 2")
    put(tmp_path, "r/elsewhere/ccccccccccc.txt", "text")
    scan = S.scan_transcripts(spark, [str(tmp_path / "r")])
    name = lambda p: p.removeprefix(f"{tmp_path}/r/")
    found = sorted((r["channel"], r["video"], name(r["path"]), r["published"], r["layout"], r["metadata_path"] is not None) for r in scan.transcripts.collect())
    assert found == [
        ("Some_one", a, f"data/transcripts/by_video_id/{a}.txt", "2025-03-04", 1, True),
        ("legacy", b, f"legacy/transcripts/2024-05-06_{b}.txt", "2024-05-06", 3, False),
        ("odd", b, f"1_transcripts/odd/{b}.txt", None, 2, True),
    ]
    faults = sorted((r["fault"], name(r["path"])) for r in scan.faults.collect())
    assert faults == [
        ("bad_metadata", f"1_transcripts/odd/{b}.txt"), ("bad_utf8", f"1_transcripts/chan/{b}.txt"), ("duplicate_id", f"1_transcripts/chan/2025-01-02_{a}.txt"),
        ("missing_metadata", f"legacy/transcripts/2024-05-06_{b}.txt"), ("no_video_id", "1_transcripts/chan/noid.txt"),
    ]
    with pytest.raises(Exception, match="(?i)path"):
        S.scan_transcripts(spark, [str(tmp_path / "none")]).faults.collect()


def test_cold_moves_are_idempotent(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "video string, text string")
    active, cold = table(("a", "new a"), ("b", "new b"), ("c", "c")), table(("b", "old b"), ("d", "d"))
    entries = spark.createDataFrame([("a",), (" a ",), ("b",), ("d",), ("e",), ("",), (None,)], "video string")
    plan = C.cold_plan(entries, active, cold)
    assert sorted(tuple(r) for r in plan.collect()) == [("a", "move"), ("b", "replace"), ("d", "done"), ("e", "absent")]
    assert tuple(C.cold_counts(plan).first()) == (4, 2, 1, 1)
    hot, moved = C.apply_cold(plan, active, cold)
    assert sorted(tuple(r) for r in hot.collect()) == [("c", "c")]
    assert sorted(tuple(r) for r in moved.collect()) == [("a", "new a"), ("b", "new b"), ("d", "d")]
    again = C.cold_plan(entries, hot, moved)
    assert tuple(C.cold_counts(again).first()) == (4, 0, 3, 1)
    for before, after in zip((hot, moved), C.apply_cold(again, hot, moved), strict=True):
        assert sorted(map(tuple, before.collect())) == sorted(map(tuple, after.collect()))
    assert tuple(C.cold_counts(C.cold_plan(entries.limit(0), hot, moved)).first()) == (0, 0, 0, 0)


def test_ring_of_lines(spark, tmp_path):
    from tidewell.sources import files

    path = str(tmp_path / "ring")
    for k in range(0, 12, 3):
        files.append_ring(spark.createDataFrame([(k + i, "é" * i) for i in range(3)], "seq int, text string"), path, "seq", 100)
    lines = [x for f in (tmp_path / "ring").glob("part-*") for x in f.read_bytes().splitlines(keepends=True)]
    assert sum(map(len, lines)) <= 100 and [json.loads(x)["seq"] for x in lines] == list(range(11, 11 - len(lines), -1)) or sorted(json.loads(x)["seq"] for x in lines) == list(range(12 - len(lines), 12))
    assert len(lines) == 4


def test_postings_are_counted_before_they_are_dealt(spark, tmp_path):
    texts = [(1, "x", "b a B c1 b"), (2, "y", "é É b"), (3, "x", None), (4, "y", " "), (5, None, "a")]
    chunks = spark.createDataFrame(texts, "chunk_id long, source string, text string")
    rows = chunks.select("chunk_id", "source", X.words(F.col("text")).alias("tokens"))
    counted = X.term_counts(rows)
    wanted = [(1, 5, "a", 1), (1, 5, "b", 3), (1, 5, "c1", 1), (2, 3, "b", 1), (2, 3, "é", 2), (5, 1, "a", 1)]
    assert sorted(map(tuple, counted.select("chunk_id", "dl", "term", "tf").collect())) == wanted
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()

    # Rows of one id and length are one text, as in the SQL; of other lengths they aren't.
    twice = chunks.union(spark.createDataFrame([(1, "x", "b b d e f"), (1, "x", "b")], chunks.schema))
    for k, (given, more) in enumerate([(chunks, {}), (twice, {(1, 5, "b"): 5, (1, 1, "b"): 1, (1, 5, "d"): 1, (1, 5, "e"): 1, (1, 5, "f"): 1})]):
        X.write_postings(given, str(tmp_path / str(k)))
        stored = spark.read.parquet(str(tmp_path / str(k) / "postings"))
        assert {(r["chunk_id"], r["dl"], r["term"]): r["tf"] for r in stored.collect()} == {w[:3]: w[3] for w in wanted} | more
        terms = {r["term"]: r["n"] for r in spark.read.parquet(str(tmp_path / str(k) / "terms")).collect()}
        assert terms["b"] == 2 + k and terms["a"] == 2


def test_postings_stay_with_their_task(spark, tmp_path):
    """Stored without a shuffle, by term, also with more sources than open files."""
    texts = [(k, f"s{k % (X.OPEN_FILES + 9)}" if k % 2 else "x", f"w{k % 7} b a{k} b") for k in range(300)]
    chunks = spark.createDataFrame(texts, "chunk_id long, source string, text string").repartition(3, "chunk_id")
    X.write_postings(chunks, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "postings"))
    assert {(r["chunk_id"], r["source"], r["term"], r["tf"], r["dl"]) for r in stored.collect()} == {(k, s, w, t.split().count(w), 4) for k, s, t in texts for w in t.split()}
    assert stored.count() == 3 * len(texts)
    found = [[r["term"] for r in spark.read.parquet(str(f)).collect()] for f in (tmp_path / "postings" / "source=x").glob("*.parquet")]
    assert len(found) == 3 and all(terms == sorted(terms) for terms in found)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_slices_of_batches():
    batch = pa.RecordBatch.from_pydict({"n": list(range(100)), "t": ["x" * 1000] * 100})
    parts = list(slices(batch, 10_000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict() and max(p.num_rows for p in parts) <= 10
    assert [p.num_rows for p in slices(batch, 1)] == [1] * 100 and not list(slices(batch.slice(0, 0)))
