"""Small tables with nulls, empty and long texts, ties, repeats and columns
whose names operators use themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 30_000
CLASHES = ("id", "hash", "row", "node", "root", "fp", "part", "n", "key", "text_hash", "tw_id", "tw_hash", "tw_text", "tw_removed", "r_id", "tw_source", "c_tw_source", "tw_score", "kept_hash", "label")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", None, None, 4),
        (4, "One single line of words", "en", "a", 24),
        (4, "One single line of words", "en", "a", 24),
        (5, "One single line of words", "fr", "b", 24),
        (None, "A row without a key", "en", None, None),
        (None, None, None, None, None),
        (7, LONG, "en", "b", len(LONG)),
        (8, "naïve \u0000 𝒳 ﬁ ▁ ｆｕｌｌ   end", "de", "b", 20),
        (9, LONG + "tail", "en", "b", len(LONG) + 4),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """``df`` with columns that have the names operators use inside."""
    return df.withColumns({c: F.lit(f"kept {c}") for c in CLASHES})


def assert_clashes_kept(df, columns):
    assert df.columns == columns
    row = df.select(*CLASHES).first()
    if row is not None:
        assert list(row) == [f"kept {c}" for c in CLASHES]


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)
