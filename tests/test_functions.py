"""Scalar functions on literal fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.functions import dates, stats
from tidewell.functions import text as T


def one(spark, column, **values):
    """Value of a column over one row of strings and arrays."""
    frame = spark.range(1).select(*[(F.lit(v) if not isinstance(v, (list, dict)) else F.array(*map(F.lit, v)) if isinstance(v, list) else F.create_map(*[F.lit(x) for kv in v.items() for x in kv])).alias(k) for k, v in values.items()])
    return frame.select(column.alias("x")).first()["x"]


x = lambda: F.col("t")


def test_names_and_ids(spark):
    assert one(spark, T.ticker(x()), t="Apple Inc. (AAPL)") == "AAPL"
    assert one(spark, T.ticker(x()), t="  plain ") == "plain"
    assert one(spark, T.ticker(x()), t="lower (aapl)") == "lower (aapl)"
    assert one(spark, T.channel_of(x()), t="chan/1_transcripts") == "chan"
    assert one(spark, T.channel_of(x()), t="/1_transcripts/chan_b") == "chan_b"
    assert one(spark, T.channel_of(x()), t=" ") == "unknown"
    assert one(spark, T.handle(x()), t=" @a/b\\c ") == "a_b_c"
    assert one(spark, T.video_id(x()), t="abcdefgh-_1.txt") == "abcdefgh-_1"
    assert one(spark, T.video_id(x()), t="2025-01-01_v1.txt") == "v1"
    assert one(spark, T.video_id(x()), t="notes.md") is None
    assert one(spark, T.file_base(x()), t=" Über: das / Wetter! ") == "Über_das_Wetter"
    assert one(spark, T.slug(x(), 8), t="Hello, World ü!") == "hello-wo"
    assert one(spark, T.repository(x()), t="https://github.com/o/n.git") == "o/n"
    assert one(spark, T.first_of(F.col("t"), F.col("u")), t=" ", u=" b ") == "b"


def test_urls(spark):
    cases = {
        "Example.com/a/": "https://example.com/a",
        "http://H.com?utm_x=1&a=2&gclid=3#top": "http://h.com/?a=2",
        "https://h.com/p;v=1?ref=x": "https://h.com/p",
    }
    for url, wanted in cases.items():
        assert one(spark, T.canonical_url(x()), t=url) == wanted
    ok = T.url_allowed(x(), ["h.com"], ["/docs"])
    assert one(spark, ok, t="https://h.com/docs/a") and not one(spark, ok, t="https://h.com/assets/a") and not one(spark, ok, t="https://other.com/docs")


def test_markdown_and_summaries(spark):
    assert one(spark, T.bullets(x()), t="a\n- b\n -  c\n-d") == ["b", "c"]
    assert one(spark, T.as_bullets(x()), t=" ") == "- none" and one(spark, T.as_bullets(x()), t="one") == "- one" and one(spark, T.as_bullets(x()), t="- a\n- b") == "- a\n- b"
    assert one(spark, T.source_block(x()), t="- id: 1\n- url: http://a\nno") == {"id": "1", "url": "http://a"}
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    assert one(spark, T.sections(x()), t="## A\nx\n## B\ny\nz\n## A\nlast") == {"A": "last", "B": "y\nz"}
    assert one(spark, T.missing_parts(F.col("t"), ["A", "C"]), t={"A": "1"}) == ["missing_section:C"]
    body = "---\ntopic: tech \n---\n\ntext"
    assert one(spark, T.without_frontmatter(x()), t=body) == "text"
    assert one(spark, T.frontmatter_value(x(), "topic"), t=body) == "tech" and one(spark, T.frontmatter_value(x(), "none"), t=body) == "unknown"
    assert one(spark, T.wrapped_docs(x()), t="<<<DOC_START>>>\na\n<<<DOC_END>>> <<<DOC_START>>>b<<<DOC_END>>>") == ["a", "b"]
    assert one(spark, T.markdown_links(x()), t="[a](b.md#x) [c](https://d) [e](f.py:12)") == ["b.md", "f.py"]
    assert one(spark, T.quality_bucket(F.lit(" OK "), x()), t=["It cuts off early"]) == "truncated"
    assert one(spark, T.quality_bucket(F.lit(" OK "), x()), t=["fine"]) == "ok"


def test_keywords(spark):
    text = "First line has Apple.\n  apple and PEAR \npineapple"
    assert one(spark, T.keyword_lines(x(), ["apple", "pear"]), t=text) == ["First line has Apple.", "apple and PEAR", "apple and PEAR"]
    assert one(spark, T.keywords_found(x(), ["pear", "fig", "a.c"]), t=text) == ["pear"]


def test_streams_of_events(spark):
    body = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\ndata: {bad\ndata: {"choices":[{"delta":{"content":"y","tool_calls":[1]}}]}\ndata: [DONE]\ndata: {"choices":[{"delta":{"content":"no"}}]}'
    assert one(spark, T.sse_text(x()), t=body) == "Hey" and one(spark, T.sse_tool_calls(x()), t=body) == 1


def test_globs(spark):
    hit = lambda p, i, e: one(spark, T.glob_match(x(), i, e), t=p)
    assert hit("a/b.md", ["*.md"], []) and hit("a/b.md", [], []) and not hit("a/b.md", ["*.md"], ["a/*"]) and not hit("a+b.mdx", ["*.md"], [])


def test_dates(spark):
    when = dates.parse_utc(x()).cast("string")
    cases = {"2025-01-02T03:04:05Z": "2025-01-02 03:04:05", "2025-01-02T03:04:05+02:00": "2025-01-02 01:04:05", "2025-01-02": "2025-01-02 00:00:00", "2025-01-02 03:04 UTC": "2025-01-02 03:04:00", "soon": None}
    for given, wanted in cases.items():
        assert one(spark, when, t=given) == wanted
    assert one(spark, dates.published_date(x()), t="2025-01-02T03") == "2025-01-02"
    assert one(spark, dates.minutes_seconds(F.lit(3725.9))) == "62:05"
    assert one(spark, dates.epoch_date(F.lit(86400))) == dt.date(1970, 1, 2)


@pytest.mark.parametrize(("values", "p", "wanted"), [([1, 2, 3, 4], 50, 3), ([1, 2], 50, 1), ([5], 95, 5), ([1, 2, 3, 4, 5, 6], 50, 3)])
def test_nearest_rank_rounds_half_to_even(spark, values, p, wanted):
    assert one(spark, stats.nearest_rank(x(), p), t=values) == wanted
