from tests.compare import SMALL, assert_same
from tests.llm.helpers import assert_clashes_kept, clashing, empty, odd_documents
from tidewell.llm import line_chunks

PASSAGE = " ".join(f"word{k}" for k in range(60))
BLOCK = [f"line {k} of a shared licence text with several words" for k in range(40)]


def texts_after(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["removed"]) for r in line_chunks.dedup_chunks(docs, count_column="removed").collect()}


def test_query_equals_sql(spark):
    assert assert_same(line_chunks.op7_line_dedup(spark, SMALL), line_chunks.OP7_SQL) > 0


def test_long_passages_go_from_all_but_the_first(spark):
    rows = [(3, f"own three\n{PASSAGE}\nend three"), (1, f"own one\n{PASSAGE}"), (2, PASSAGE), (4, f"{PASSAGE}\n{PASSAGE}\nmore")]
    found = texts_after(spark, rows)
    assert found == {1: (f"own one\n{PASSAGE}", 0), 2: ("", 1), 3: ("own three\nend three", 1), 4: ("more", 2)}


def test_boundaries_do_not_shift(spark):
    shared = "\n".join(BLOCK)
    rows = [(1, f"a start\n{shared}\nan end"), (2, f"another beginning\nof two lines\n{shared}\nother end")]
    first, second = (texts_after(spark, rows)[k] for k in (1, 2))
    assert first == (rows[0][1], 0)
    left = second[0].split("\n")
    assert second[1] > 3 and len([x for x in left if x in BLOCK]) < len(BLOCK) / 3
    assert left[:2] == ["another beginning", "of two lines"] and left[-1] == "other end"


def test_short_lines_stay(spark):
    rows = [(k, f"Released under the MIT License.\nown text {k}") for k in range(5)]
    assert texts_after(spark, rows) == {k: (t, 0) for k, t in rows}


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    out = line_chunks.dedup_chunks(docs)
    assert_clashes_kept(out, docs.columns)
    rows = out.select("doc_id", "text").collect()
    assert len(rows) == 11
    texts = [r["text"] for r in rows if r["doc_id"] == 1]
    assert texts == [None] and [r["text"] for r in rows if r["doc_id"] == 2] == [""]
    assert line_chunks.dedup_chunks(empty(spark)).count() == 0


def test_lines_that_look_like_marks(spark):
    rows = [(1, "a\nb\naa\nbb\n\n\n"), (2, f"b\n{PASSAGE}\na\n"), (3, f"ab\n{PASSAGE}\nba\n\nb")]
    found = texts_after(spark, rows)
    assert found[1] == (rows[0][1], 0) and found[2] == (rows[1][1], 0) and found[3] == ("ab\nba\n\nb", 1)
