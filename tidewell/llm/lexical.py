"""Ranked lexical search through a tiered index of postings.

The postings of the asked terms are stored by impact, the part of a document's
score that depends on the document: the first tier holds each term's highest
``FIRST`` or so, each later one up to ``STEP`` times as many in all. What a
term leaves to later tiers is bounded by the highest impact there.

An item is first scored from the first tier alone. The exact scores of the best
documents found there give a threshold; an unseen document scores at most the
sum of the terms' residual bounds. Where that sum is below the threshold, the
documents whose own bound reaches it are scored exactly and the answer is
proven; items without proof fall through to the next tier. After the last tier
nothing is left, so every item ends with the exact answer.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table, small, stored

BEST = 50
FIRST = 512
STEP = 4
BLOCK_BYTES = 16 << 20
BUCKET = 4096
#: Digits, A-Z as a-z and all bytes of other characters; the rest parts words.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct (item_id, term) of a table (item_id, text)."""
    kind = items.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(x.as_py()))) for x in batch.column(1)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([t.decode() for x in found for t in x], pa.string())], names=["item_id", "term"])

    return items.select("item_id", F.col("text").cast("binary")).mapInArrow(split, f"item_id {kind}, term string").distinct()


def forward_rows(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Per document with terms: doc_id, number of terms ``n``, and the ids and
    counts of those in ``vocabulary``."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.keys()
        for batch in batches:
            rows, sizes, ends, ids, counts = [], [], [0], [], []
            for row, text in enumerate(batch.column(1)):
                if words := terms_of(text.as_py()):
                    tally = Counter(words)
                    own = [t for t in tally if t in known]
                    ids += [vocabulary[t] for t in own]
                    counts += [tally[t] for t in own]
                    rows.append(row)
                    sizes.append(len(words))
                    ends.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "ts", "tfs"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(count, f"doc_id {kind}, n long, ts array<long>, tfs array<long>")


def impact(total: int, length: int) -> Column:
    """Of ``tf`` occurrences in a document of ``n`` terms, below 1,000,000."""
    return F.expr(f"(1000000000 * tf) div (1000 * tf + 20 * (50 + (50 * n * {total}) div {length}))")


def postings(forward: DataFrame, total: int, length: int) -> DataFrame:
    """(t, key, impact) of all documents."""
    each = forward.select("key", "n", F.explode(F.arrays_zip("ts", "tfs")).alias("x"))
    return each.select("key", F.col("x.ts").alias("t"), F.col("x.tfs").alias("tf"), "n").select("t", "key", impact(total, length).alias("impact"))


def cut_tiers(found: DataFrame, total: int, first: int, step: int) -> tuple[DataFrame, int]:
    """Per term: weight ``w``, the lowest bucket ``cut_k`` and the residual
    impact ``rest_k`` of each tier; and the number of tiers.

    Buckets of impacts are never split, so equal impacts share a tier.
    """
    buckets = stored(found.groupBy("t", F.expr(f"impact div {BUCKET}").alias("bucket")).agg(F.count("*").alias("n"), F.max("impact").alias("top")), "impact-buckets")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = buckets.withColumn("before", before)
    most = ranked.agg(F.max("before")).first()[0] or 0
    tiers = 1 + (0 if most < first else 1 + int(math.log(most / first, step) + 1e-9))
    while first * step ** (tiers - 1) <= most:
        tiers += 1
    inside = [F.col("before") < first * step**k if k < tiers - 1 else F.lit(True) for k in range(tiers)]
    cuts = [F.min(F.when(x, F.col("bucket"))).alias(f"cut_{k}") for k, x in enumerate(inside)]
    rests = [F.coalesce(F.max(F.when(~x, F.col("top"))), F.lit(0)).alias(f"rest_{k}") for k, x in enumerate(inside)]
    weight = F.floor(1000 * F.log((2 * F.lit(total) + 2) / (2 * F.sum("n") + 1))).cast("long")
    return stored(ranked.groupBy("t").agg(weight.alias("w"), *cuts, *rests), "term-tiers"), tiers


def write_tiers(found: DataFrame, terms: DataFrame, tiers: int) -> DataFrame:
    """The postings of each shard of documents by tier and term, so a reader of
    the first tiers passes over the rest of each file. As a document's postings
    lie in one shard, its scores are summed there before they are shuffled."""
    bucket = F.expr(f"impact div {BUCKET}")
    tier = sum((F.when(bucket < F.col(f"cut_{k}"), 1).otherwise(0) for k in range(tiers - 1)), F.lit(0))
    placed = found.join(small(terms.select("t", *[f"cut_{k}" for k in range(tiers)])), "t").select(tier.alias("tier"), "t", "key", "impact")
    return stored(placed.sortWithinPartitions("tier", "t", "key"), "postings")


def exact_scores(pairs: DataFrame, forward: DataFrame, asked: DataFrame, total: int, length: int) -> DataFrame:
    """(item, key) with doc_id and the whole score."""
    rows = forward.select("key", "doc_id", "n", "ts", "tfs").join(small(pairs), "key")
    each = rows.select("item", "key", "doc_id", "n", F.explode(F.arrays_zip("ts", "tfs")).alias("x")).select("item", "key", "doc_id", "n", F.col("x.ts").alias("t"), F.col("x.tfs").alias("tf"))
    scored = each.join(small(asked.select("item", "t", "w")), ["item", "t"]).select("item", "key", "doc_id", (F.col("w") * impact(total, length)).alias("part"))
    return scored.groupBy("item", "key", "doc_id").agg(F.sum("part").alias("score"))


def _best(df: DataFrame, order: list[Column], most: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)


def _search_block(docs: DataFrame, items: DataFrame, best: int, first: int, step: int) -> tuple[list[DataFrame], DataFrame, list[int]]:
    """Answers by tier, the items, and how many items each tier has proven."""
    asked = stored(item_terms(items), "item-terms")
    named = stored(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    vocabulary = stored(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    known = {r["term"].encode(): r["t"] for r in vocabulary.toLocalIterator()}  # at most BLOCK_BYTES of texts
    forward = stored(forward_rows(docs, known).withColumn("key", F.monotonically_increasing_id()), "forward")
    total, length = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total or not known:
        return [], named, []
    found = postings(forward, total, length)
    terms, tiers = cut_tiers(found, total, first, step)
    index = write_tiers(found, terms, tiers)
    asked = asked.join(vocabulary, "term").join(terms, "t").join(named, asked["item_id"].eqNullSafe(named["item_id"]))
    asked = stored(asked.select("item", "t", "w", *[(F.col("w") * F.col(f"rest_{k}")).alias(f"rest_{k}") for k in range(tiers)]), "asked")
    open_items = asked.groupBy("item").agg(F.lit(0).cast("long").alias("least"))
    answers, proven = [], []
    for k in range(tiers):
        rest = F.col(f"rest_{k}")
        bounds = asked.groupBy("item").agg(F.sum(rest).alias("bound")).join(open_items, "item")
        bounds = stored(bounds, "bounds")
        terms_k = small(asked.join(open_items, "item", "left_semi").select("item", "t", "w", rest.alias("rest")))
        part = F.col("w") * F.col("impact")
        seen = index.where(F.col("tier") <= k).join(terms_k, "t").groupBy("item", "key").agg(F.sum(part).alias("low"), F.sum(part - F.col("rest")).alias("gain"))
        # What cannot reach an earlier tier's threshold is abandoned here.
        seen = stored(seen.join(F.broadcast(bounds), "item").where("gain + bound >= least").select("item", "key", "low", "gain"), "seen")
        leaders = _best(seen.where("low > 0"), [F.desc("low"), F.asc("key")], best).select("item", "key")
        reached = exact_scores(leaders, forward, asked, total, length).groupBy("item").agg(F.min("score").alias("low"), F.count("*").alias("n"))
        reached = reached.select("item", F.when(F.col("n") >= best, F.col("low")).otherwise(0).alias("now"))
        state = bounds.join(reached, "item", "left").select("item", "bound", F.greatest("least", F.coalesce("now", F.lit(0))).alias("least"))
        state = stored(state.withColumn("done", (F.col("bound") == 0) | (F.col("bound") < F.col("least"))), "thresholds")
        proven.append(state.where("done").count())
        if proven[-1]:
            could = seen.join(F.broadcast(state.where("done")), "item").where("gain + bound >= least").select("item", "key")
            scores = exact_scores(stored(could, "candidates"), forward, asked, total, length).where("score > 0")
            answers.append(stored(_best(scores, [F.desc("score"), F.asc_nulls_last("doc_id")], best), "answers"))
        open_items = state.where("NOT done").select("item", "least")
        if sum(proven) == named.count():
            break
    return answers, named, proven


def search(docs: DataFrame, items: DataFrame, best: int = BEST, first: int = FIRST, step: int = STEP, proven: list[int] | None = None) -> DataFrame:
    """The ``best`` documents (doc_id, text) of each item (item_id, text):
    item_id, rank, doc_id, score, by descending score and ascending doc_id
    (null last), scores above 0 only.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z in
    lower case. A document is a row with at least one term; null and empty
    texts are none, rows that repeat a doc_id are documents of their own and
    share ranks in no set order where their scores are equal. Rows that share
    an item_id (null too) are one item with the terms of all. Items without
    terms, or without a term that any document holds, have no rows; neither
    has any where either table is empty. Other columns are not carried, so
    their names don't matter.

    Items are searched in blocks of about ``BLOCK_BYTES`` of text, whose terms
    go to every task; an item with a longer text is a block by itself.
    ``proven`` gets the number of items that each tier has settled.
    """
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = None
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        answers, named, settled = _search_block(docs, block, best, first, step)
        if proven is not None:
            proven += settled
        for part in answers:
            part = part.join(small(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = items.select("item_id").where("false").join(docs.select("doc_id").where("false"), F.lit(True)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    return out


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each ``benchmark`` item.

    Nulls, empty texts, ties, repeats and empty tables as in ``search``.
    """
    return search(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ws FROM documents),
s AS (SELECT count(*) AS nd, CAST(sum(len(ws)) AS BIGINT) AS nt FROM d WHERE len(ws) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
t AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
c AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * len(ws) * nd) // nt)))) AS BIGINT) AS score FROM q JOIN t USING (term) JOIN p USING (term) JOIN d USING (rid), s GROUP BY item_id, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM c JOIN d USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {BEST}
"""
