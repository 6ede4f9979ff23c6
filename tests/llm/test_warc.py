import hashlib

from tests.compare import SMALL, assert_same
from tests.llm.helpers import clashing, empty
from tidewell.llm import warc

PAGES = "page_id long, url string, html string, n int"


def by_id(df):
    return {r["page_id"]: r for r in df.collect()}


def test_query_equals_sql(spark):
    assert assert_same(warc.op1_warc(spark, SMALL), warc.OP1_SQL) > 0


def test_revisits_null_empty_long_and_repeated(spark, tmp_path):
    long = "x\r\n\r\ny" * 150_000
    same = "<p>é</p>" * 20
    rows = [(5, "u", same, 1), (3, None, same, 1), (9, "u b", same, 1), (3, None, same, 1), (1, "u", "short", 1), (2, "u", "short", 1), (4, "u", None, 1), (6, "u", "", 1), (7, "u", long, 1), (8, "u", long, 1), (None, "u", same, 1)]
    pages = spark.createDataFrame(rows, PAGES)
    found = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert len(found) == len(rows)
    got = {r["page_id"]: r for r in found}
    assert (got[3]["record_type"], got[3]["refers_to"]) == ("response", None)
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in (5, 9, None, 8)] == [("revisit", 3)] * 3 + [("revisit", 7)]
    assert all(got[k]["record_type"] == "response" for k in (1, 2, 4, 6, 7))
    assert got[4]["payload_bytes"] == 0 and got[4]["payload_digest"] == hashlib.sha256(b"").hexdigest()
    assert got[8]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()


def test_archive_is_standard_and_round_trips(spark, tmp_path):
    rows = [(1, "http://a/ b", "<p>one</p>" * 30, 1), (2, "http://b/", "<p>one</p>" * 30, 1), (3, "http://c/", "tail\r\n\r\n", 1)]
    path = str(tmp_path / "w")
    warc.archive_pages(spark.createDataFrame(rows, PAGES), path)
    back = {r["page_id"]: r for r in warc.read_archives(spark, path).collect()}
    assert back[1]["url"] == "http://a/%20b"
    assert bytes(back[1]["payload"]) == rows[0][2].encode() and back[2]["payload"] is None
    assert bytes(back[3]["payload"]) == b"tail\r\n\r\n"


def test_revisit_rows_are_never_originals(spark):
    rows = [(1, "d", 200, "revisit"), (2, "d", 200, "response"), (3, "d", 200, "response")]
    headers = spark.createDataFrame(rows, "page_id long, payload_digest string, payload_bytes long, record_type string")
    assert warc.resolve_revisits(headers).collect()[0]["refers_to"] == 2


def test_clashing_names_are_not_read(spark, tmp_path):
    rows = [(1, "u", "<p>one</p>" * 30, 1), (2, "u", "<p>one</p>" * 30, 1), (3, None, None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    names = ("payload", "payload_digest", "payload_bytes", "record_type", "refers_to", "value", "class", "most")
    odd = clashing(pages).selectExpr("*", *[f"'x' AS {n}" for n in names])
    plain, found = (sorted(map(str, warc.archive_pages(p, str(tmp_path / n)).collect())) for p, n in ((pages, "a"), (odd, "b")))
    assert plain == found


def test_empty_table(spark, tmp_path):
    assert warc.archive_pages(empty(spark, PAGES), str(tmp_path / "w")).count() == 0
