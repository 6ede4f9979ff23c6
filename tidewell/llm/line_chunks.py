"""Removal of repeated passages by content-defined chunks of lines.

Main path in DataFrame functions only. A chunk ends where a rolling hash over
the last two line hashes is divisible by ``divisor``, so an inserted line
moves no boundary but those next to it. Lines of over ``long_words`` words
are chunks of their own and count as several lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table, small, stored

DIVISOR = 4
LONG_WORDS = 50
MIN_WORDS = 10
WORD = "[^\\x20\\x09-\\x0D]+"


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _is_long(line: Column, long_words: int) -> Column:
    """Over ``long_words`` words; the count runs only where length allows it."""
    return (F.length(line) > 2 * long_words) & (F.regexp_count(line, F.lit(WORD)) > long_words)


def marked_chunks(text: Column, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> Column:
    """The chunks of a text, as strings of lines that each begin with a mark:
    ``a`` on a chunk's first line, ``b`` on the others. Null stays null."""
    lines = F.split(text, "\n", -1)
    none = F.lit("")
    before = F.concat(F.array(none), lines)
    before2 = F.concat(F.array(none, none), lines)
    rows = F.filter(F.arrays_zip(lines.alias("l"), before.alias("p"), before2.alias("q")), lambda x: x["l"].isNotNull())

    def mark(x: Column, i: Column) -> Column:
        rolled = (_line_hash(x["q"]) * 31 + _line_hash(x["p"])) % divisor == 0
        starts = (i == 0) | rolled | _is_long(x["p"], long_words) | _is_long(x["l"], long_words)
        return F.concat(F.when(starts, "a").otherwise("b"), x["l"])

    return F.split(F.array_join(F.transform(rows, mark), "\n"), "\n(?=a)", -1)


def plain(chunk: Column) -> Column:
    """A chunk without its line marks."""
    return F.regexp_replace(chunk, "(?md)^[ab]", "")


def dedup_chunks(docs: DataFrame, divisor: int = DIVISOR, long_words: int = LONG_WORDS, min_words: int = MIN_WORDS, count_column: str | None = None) -> DataFrame:
    """``docs`` with the later copies of repeated chunks cut from ``text``.

    Chunks of two lines or more with ``min_words`` words or more, and lines of
    over ``long_words`` words, are compared over all documents. Of equal ones
    (equal hash, then equal bytes) the first by (doc_id, position) stays. The
    lines that remain keep their order; a text may become empty. Null texts
    stay null, empty texts stay empty. Rows that repeat a doc_id with equal
    text count as one occurrence; null doc_ids come first. Other columns pass
    through, whatever their names. ``count_column`` adds the number of chunks removed.
    """
    key = {"tw_id": F.col("doc_id").cast("long"), "tw_hash": F.xxhash64("text")}
    base = docs.select(key["tw_id"].alias("tw_id"), key["tw_hash"].alias("tw_hash"), F.col("text").alias("tw_text"))
    chunked = base.select("tw_id", "tw_hash", F.posexplode(marked_chunks(F.col("tw_text"), divisor, long_words)).alias("pos", "chunk"))
    words = F.regexp_count("chunk", F.lit(WORD))
    eligible = chunked.where(F.when(F.col("chunk").contains("\n"), words >= min_words).otherwise(words > long_words))
    keys = stored(eligible.select("tw_id", "tw_hash", "pos", F.xxhash64("chunk").alias("h")), "chunk-keys")
    place = F.struct("tw_id", "pos", "tw_hash")
    firsts = keys.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h", "first")
    marks = keys.join(firsts, "h").select("tw_id", "tw_hash", F.struct("pos", (~place.eqNullSafe(F.col("first"))).alias("again")).alias("mark"))
    wanted = marks.groupBy("tw_id", "tw_hash").agg(F.map_from_entries(F.collect_set("mark")).alias("wanted")).select(F.col("tw_id").alias("w_id"), F.col("tw_hash").alias("w_hash"), "wanted")
    wanted = small(stored(wanted, "chunk-wanted"))
    texts = (
        base.join(wanted, base.tw_id.eqNullSafe(wanted.w_id) & (base.tw_hash == wanted.w_hash))
        .select("tw_id", "tw_hash", "wanted", F.posexplode(marked_chunks(F.col("tw_text"), divisor, long_words)).alias("pos", "chunk"))
        .where(F.map_contains_key("wanted", F.col("pos")))
        .select("tw_id", "tw_hash", "pos", F.xxhash64("chunk").alias("h"), "chunk", F.col("wanted")[F.col("pos")].alias("again"))
    )
    texts = stored(texts, "chunk-texts")
    kept = stored(texts.where("NOT again").select(F.col("h").alias("k"), F.col("chunk").alias("kept")).distinct(), "chunk-kept")
    same = texts.where("again").join(kept, (F.col("h") == F.col("k")) & (F.col("chunk") == F.col("kept")))
    removed = same.groupBy("tw_id", "tw_hash").agg(F.collect_set("pos").alias("tw_removed")).withColumnsRenamed({"tw_id": "r_id", "tw_hash": "r_hash"})
    removed = small(stored(removed, "chunk-removed"))
    others = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("tw_row")
    rows = docs.select(key["tw_id"].alias("tw_id"), key["tw_hash"].alias("tw_hash"), F.col("text").alias("tw_text"), row)
    rows = rows.join(removed, F.col("tw_id").eqNullSafe(F.col("r_id")) & (F.col("tw_hash") == F.col("r_hash")), "left")
    kept = F.filter(marked_chunks(F.col("tw_text"), divisor, long_words), lambda c, i: ~F.array_contains(F.col("tw_removed"), i))
    text = F.when(F.col("tw_removed").isNull(), F.col("tw_text")).otherwise(plain(F.array_join(kept, "\n")))
    count = [] if count_column is None else [F.coalesce(F.size("tw_removed"), F.lit(0)).alias(count_column)]
    return rows.select(*[text.alias(c) if c == "text" else F.col("tw_row").getField(c).alias(c) for c in docs.columns], *count)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_chunks(docs, count_column="removed_chunks")


OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS hl, length(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > {LONG_WORDS} AS long FROM l),
r AS (SELECT *, lag(hl, 1, CAST('0x' || substr(md5(''), 1, 8) AS BIGINT)) OVER w AS h1, lag(hl, 2, CAST('0x' || substr(md5(''), 1, 8) AS BIGINT)) OVER w AS h2, lag(long, 1, false) OVER w AS long1 FROM h WINDOW w AS (PARTITION BY rid ORDER BY i)),
s AS (SELECT *, sum(CASE WHEN i = 1 OR (h2 * 31 + h1) % {DIVISOR} = 0 OR long1 OR long THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS pos FROM r),
c AS (SELECT rid, doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM s GROUP BY ALL),
e AS (SELECT *, length(regexp_extract_all(chunk, '[^\\x20\\x09-\\x0D]+')) AS words FROM c),
f AS (SELECT *, CASE WHEN n > 1 THEN words >= {MIN_WORDS} ELSE words > {LONG_WORDS} END AS ok FROM e),
g AS (SELECT *, ok AND row_number() OVER (PARTITION BY ok, chunk ORDER BY doc_id, pos) > 1 AS again FROM f),
t AS (SELECT rid, string_agg(chunk, chr(10) ORDER BY pos) FILTER (WHERE NOT again) AS text, sum(CASE WHEN again THEN 1 ELSE 0 END) AS n FROM g GROUP BY rid)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text, CAST(coalesce(t.n, 0) AS INTEGER) AS removed_chunks
FROM d LEFT JOIN t USING (rid)
"""
