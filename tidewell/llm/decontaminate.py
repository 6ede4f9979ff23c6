"""Benchmark passages in documents, by a prefix-filtered join of windows.

DataFrame functions only. An item stands for its windows of ``WINDOW``
consecutive words. A window is a set of shingles at fixed places, and a
document that holds it holds all of them: at full containment one shingle, the
window's rarest over all documents, is the necessary prefix. Documents'
shingles are joined to the windows by that prefix. The shingle's place in the
window gives the only place where the window could begin (positional bound),
which has to lie within the document (length bound); there the words
themselves are compared.

A shingle leaves the scan of its document only where it meets a window, so no
text is shuffled. The windows come from a stated set of items and are
broadcast in blocks of measured size.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import broadcast_blocks, read_table, small, stored

WINDOW = 10
SHINGLE = 5
BREAK = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of one byte a character go
    the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), BREAK, -1), "")


def _shingle(of: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(of, at + k) for k in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: words ``win``, their number ``w`` and the ids of the
    items that have them, as strings."""
    counted = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    placed = counted.select("item", "ws", F.least(F.size("ws"), F.lit(window)).alias("w")).select("item", "ws", "w", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("w") + 1)).alias("at"))
    return placed.groupBy(F.slice("ws", F.col("at"), F.col("w")).alias("win"), "w").agg(F.collect_set("item").alias("items"))


def document_shingles(docs: DataFrame, size: int, least: int) -> DataFrame:
    """Every shingle of ``size`` words of texts with ``least`` words or more."""
    long = docs.where(F.size("ws") >= least)
    placed = long.select("*", F.explode(F.sequence(F.lit(0), F.size("ws") - size)).alias("at"))
    return placed.withColumn("h", _shingle(F.col("ws"), F.col("at"), size))


def prefixes(windows: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``windows`` with size, place and hash of their rarest shingle; windows
    with a shingle that no document has are left out."""
    sizes = {r["w"]: min(r["w"], shingle) for r in windows.select("w").distinct().collect()}
    rows = []
    for size in sorted(set(sizes.values())):
        own = windows.where(F.least("w", F.lit(shingle)) == size)
        rows.append(own.select("*", F.lit(size).alias("size"), F.explode(F.sequence(F.lit(0), F.col("w") - size)).alias("off")).withColumn("h", _shingle(F.col("win"), F.col("off"), size)))
    if not rows:
        return windows.select("*", F.lit(0).alias("size"), F.lit(0).alias("off"), F.lit(0).cast("long").alias("h"))
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    every = stored(every, "window-shingles")
    counted = None
    for size in sorted(set(sizes.values())):
        least = min(w for w, s in sizes.items() if s == size)
        for block in broadcast_blocks(every.where(F.col("size") == size).select("h").distinct(), "h"):
            part = document_shingles(docs, size, least).select("h").join(block, "h").groupBy("h").agg(F.count("*").alias("n"))
            counted = part if counted is None else counted.unionByName(part)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "off", "h")).alias("rarest")
    found = every.join(counted, "h", "left").groupBy("win", "w").agg(rarest, F.first("items").alias("items"))
    return found.where("rarest.n > 0").select("win", "w", "items", "rarest.size", "rarest.off", "rarest.h")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per text with hits (tw_id, tw_hash): ``hits``, the sorted word spans
    (start, end) of all windows found, and ``items``, the sorted ids."""
    base = docs.select(F.col("doc_id").cast("long").alias("tw_id"), F.xxhash64("text").alias("tw_hash"), words(F.col("text")).alias("ws"))
    index = stored(prefixes(item_windows(items, window), base, shingle), "window-prefixes")
    found = base.select("tw_id", "tw_hash", F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("items")).where("false")
    for size, least in [(r["size"], r["least"]) for r in index.groupBy("size").agg(F.min("w").alias("least")).collect()]:
        for block in broadcast_blocks(index.where(F.col("size") == size), "win"):
            met = document_shingles(base, size, least).join(block, "h").withColumn("start", F.col("at") - F.col("off"))
            inside = met.where((F.col("start") >= 0) & (F.col("start") + F.col("w") <= F.size("ws")))
            same = inside.where(F.slice("ws", F.greatest("start", F.lit(0)) + 1, F.col("w")) == F.col("win"))
            found = found.unionByName(same.select("tw_id", "tw_hash", "start", (F.col("start") + F.col("w")).alias("end"), "items"))
    grouped = found.groupBy("tw_id", "tw_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"), F.collect_set("items").alias("sets"))
    return grouped.select("tw_id", "tw_hash", "hits", F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))


def find_leaks(docs: DataFrame, items: DataFrame, hits_column: str = "leak_hits", items_column: str = "leak_items", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the places and the items of ``items``
    (item_id, text) whose windows they hold.

    ``hits_column``: sorted array of word spans (start, end), one a place and
    length; ``items_column``: sorted array of item ids as strings. Both are
    empty where nothing is found. Words are compared after A-Z are in lower
    case. Items of fewer than ``window`` words are one window; null texts and
    texts without words are no item, and hold none. Items without an id mark
    words but aren't listed; rows that share an item_id are one item. Equal
    texts get equal results, rows that repeat a doc_id are kept apart by their
    text. Other columns pass through, whatever their names.
    """
    found = small(stored(occurrences(docs, items, window, shingle), "leaks")).withColumnsRenamed({"tw_id": "r_id", "tw_hash": "r_hash", "hits": "tw_hits", "items": "tw_items"})
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("tw_row")
    rows = docs.select(F.col("doc_id").cast("long").alias("tw_id"), F.xxhash64("text").alias("tw_hash"), row)
    rows = rows.join(found, F.col("tw_id").eqNullSafe(F.col("r_id")) & (F.col("tw_hash") == F.col("r_hash")), "left")
    hits = F.coalesce("tw_hits", F.array().cast("array<struct<start:int,end:int>>"))
    listed = F.coalesce("tw_items", F.array().cast("array<string>"))
    return rows.select(*[F.col("tw_row").getField(c).alias(c) for c in docs.columns], hits.alias(hits_column), listed.alias(items_column))


def covered(hits: Column) -> Column:
    """Words inside any of the sorted spans."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["end"] - F.greatest(acc["reach"], x["start"])
        return F.struct((acc["n"] + F.greatest(fresh, F.lit(0))).alias("n"), F.greatest(acc["reach"], x["end"]).alias("reach"))

    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")), step, lambda acc: acc["n"])


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all ``benchmark`` windows in every whole text of ``documents``.

    One row a row of ``documents``; null texts have no words and no hits; an
    empty table gives no rows, an empty ``benchmark`` no hits.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), "hits", "items")
    return found.select(
        "doc_id", "n_words", covered(F.col("hits")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


_WORDS = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
o AS (SELECT item_id, ws, least(len(ws), {WINDOW}) AS w, unnest(range(len(ws) - least(len(ws), {WINDOW}) + 1)) AS pos FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, w, array_to_string(ws[pos + 1:pos + w], ' ') AS s FROM o),
u AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos, len(ws) AS n FROM d),
p AS (SELECT rid, pos, w, n, string_agg(word, ' ') OVER (PARTITION BY rid, w ORDER BY pos ROWS BETWEEN CURRENT ROW AND w - 1 FOLLOWING) AS s FROM u, (SELECT DISTINCT w FROM win)),
h AS (SELECT rid, pos, p.w, item_id FROM p JOIN win USING (w, s) WHERE pos + p.w - 1 <= n),
c AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + w)) AS k FROM (SELECT DISTINCT rid, pos, w FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""
