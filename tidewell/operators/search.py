"""Document index: Markdown chunks, versions, postings, BM25, rank fusion."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.stem import stem_word
from tidewell.functions.text import sha_id
from tidewell.operators.batches import arrow_batches, settings, slices

# BM25 as SQLite documents it, and the usual fusion constant.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FUSION_K = 60
OPEN_FILES = 64  # sources that a task stores side by side; Spark sorts the postings of further ones
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BREAKS = frozenset((*HEADINGS, *"p div ul ol li br tr table section article header footer nav main aside blockquote pre".split()))
HIDDEN = frozenset(("script", "style", "noscript"))
_HEADING = re.compile(r"(#{1,6})\s+(.*)")


def _sections(markdown: str) -> Iterator[tuple[str, list[str]]]:
    """Heading path and lines of each run of lines between headings."""
    above: list[tuple[int, str]] = []
    lines: list[str] = []
    for line in map(str.rstrip, markdown.splitlines()):
        heading = _HEADING.fullmatch(line)
        if heading is None:
            lines.append(line)
            continue
        yield " > ".join(name for _, name in above), lines
        depth = len(heading[1])
        above = [x for x in above if x[0] < depth] + [(depth, heading[2].strip())]
        lines = []
    yield " > ".join(name for _, name in above), lines


def chunks_of(markdown: str, target: int = 400, most: int = 800, overlap: int = 60) -> list[tuple[str, str]]:
    """(heading path, text) of the chunks of a text, by approximate tokens.

    A chunk ends at a heading, before a line that would take it over ``most``
    and after the line that takes it to ``target``; in the last two cases its
    last lines, worth ``overlap`` tokens, begin the next one.
    """
    found: list[tuple[str, str]] = []
    tail: list[str] = []

    def cost(line: str) -> int:
        return max(1, (len(line) + 1) // 4)

    def end(path: str, lines: list[str]) -> list[str]:
        nonlocal tail
        if text := "\n".join(lines).strip():
            found.append((path, text + "\n"))
            at, held = len(lines), 0
            while at and held < overlap:
                at -= 1
                held += cost(lines[at])
            tail = lines[at:]
        return list(tail)

    for path, lines in _sections(markdown):
        held: list[str] = []
        size = 0
        for line in lines:
            if held and size + cost(line) > most:
                held = end(path, held)
                size = sum(map(cost, held))
            held.append(line)
            size += cost(line)
            if size >= target:
                held = end(path, held)
                size = sum(map(cost, held))
        end(path, held)
    return found


def chunk_documents(docs: DataFrame, target: int = 400, most: int = 800, overlap: int = 60) -> DataFrame:
    """``doc_id, idx, heading_path, text, char_len`` of ``doc_id, text``; the
    length is without the closing line feed. A document is one unit of work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            rows = [(d, i, path, text, len(text) - 1) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (path, text) in enumerate(chunks_of(t or "", target, most, overlap))]
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "idx", "heading_path", "text", "char_len"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, idx int, heading_path string, text string, char_len int")


class _Markdown(HTMLParser):
    """Headings, paragraphs, list items and links of a page as Markdown."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = [""]
        self.name, self.hidden, self.in_title, self.hrefs = "", 0, False, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.hidden += tag in HIDDEN
        self.in_title |= tag == "title"
        if tag in BREAKS:
            self.blocks.append("#" * int(tag[1]) + " " if tag in HEADINGS else "- " if tag == "li" else "")
        elif tag == "a":
            self.hrefs.append(dict(attrs).get("href"))
            self.blocks[-1] += "[" * (self.hrefs[-1] is not None)

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in HIDDEN and self.hidden > 0
        self.in_title &= tag != "title"
        if tag in BREAKS:
            self.blocks.append("")
        elif tag == "a" and self.hrefs and (href := self.hrefs.pop()) is not None:
            self.blocks[-1] += f"]({href})"

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.name += data
        elif not self.hidden:
            self.blocks[-1] += data


def markdown_of(html: str) -> tuple[str | None, str]:
    """(title or None, Markdown) of a page; ends with one line feed."""
    page = _Markdown(html)
    blocks = [" ".join(b.split()) for b in page.blocks]
    text = "\n\n".join(b for b in blocks if b.strip("#- "))
    return " ".join(page.name.split()) or None, text.strip() + "\n"


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    """``page_id, title, markdown`` of ``page_id, html``; null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = [markdown_of(h or "") for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string())], names=["page_id", "title", "markdown"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, "page_id long, title string, markdown string")


def with_chunk_ids(chunks: DataFrame) -> DataFrame:
    """Adds ``text_hash`` and ``chunk_id`` from document, index and text."""
    rows = chunks.withColumn("text_hash", F.sha2("text", 256))
    return rows.withColumn("chunk_id", sha_id(F.col("doc_id").cast("string"), F.col("idx").cast("string"), F.col("text_hash")))


def upsert(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The merged table, with ``change``: created, updated or unchanged; a null
    in the incoming row keeps the old value."""
    old = current.select(F.col(key).alias("old_key"), *[F.col(v).alias(f"old_{v}") for v in values])
    rows = incoming.select(key, *values, F.lit(True).alias("is_new")).join(old, F.col(key) == F.col("old_key"), "full")
    merged = {v: F.coalesce(F.col(v), F.col(f"old_{v}")) for v in values}
    changed = F.lit(False)
    for v in values:
        changed = changed | ~merged[v].eqNullSafe(F.col(f"old_{v}"))
    change = F.when(F.col("old_key").isNull(), "created").when(F.col("is_new").isNotNull() & changed, "updated").otherwise("unchanged")
    return rows.select(F.coalesce(F.col(key), F.col("old_key")).alias(key), *[c.alias(v) for v, c in merged.items()], change.alias("change"))


def latest_versions(versions: DataFrame) -> DataFrame:
    """The version of each ``doc_id`` that started last (``started``)."""
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("started"), F.desc("snapshot")))
    return versions.withColumn("n", newest).where("n = 1").drop("n")


def changed_documents(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """Rows of ``doc_id, content_hash`` whose hash differs from the latest."""
    last = latest_versions(versions).select("doc_id", F.col("content_hash").alias("last_hash"))
    return incoming.join(last, "doc_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("last_hash"))).drop("last_hash")


def without_children(children: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """Cascade of a deletion: rows whose parent is gone go too."""
    return children.join(removed.select(key).distinct(), key, "left_anti")


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits and other letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def postings(chunks: DataFrame, id_col: str = "chunk_id", only: list[str] | None = None, text: Column | None = None) -> DataFrame:
    """``term, id, tf, dl``: counts of each term and the length of its text.
    ``only`` keeps some terms, before the terms of a text become rows."""
    tokens = words(F.col("text") if text is None else text)
    held = F.col("tokens") if only is None else F.filter("tokens", lambda x: x.isin(*only))
    rows = chunks.select(F.col(id_col).alias("id"), tokens.alias("tokens")).select("id", F.size("tokens").alias("dl"), F.explode(held).alias("term"))
    return rows.groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def stemmed_postings(chunks: DataFrame, terms: list[str], id_col: str = "chunk_id") -> DataFrame:
    """``postings`` by stem, of the stems of ``terms`` only.

    Each word of the texts that begins like one of the stems (a stem keeps
    its word's first letter) is stemmed once; a stem has but a few words, and
    only theirs become postings.
    """
    spark = chunks.sparkSession
    asked = {stem_word(t) for t in terms}

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = batch.assign(stem=batch["word"].map(stem_word))
            yield made[made["stem"].isin(asked)]

    # A map, not a column: Spark would move a filter on stems in front of distinct.
    alike = F.filter(words(F.col("text")), lambda x: F.substring(x, 1, 1).isin(*{t[:1] for t in asked}))
    every = chunks.select(F.explode(F.array_distinct(alike)).alias("word")).distinct()
    found = [tuple(r) for r in every.mapInPandas(wanted, "word string, stem string").collect()]
    index = postings(chunks, id_col, sorted(w for w, _ in found)).withColumnRenamed("term", "word")
    held = index.join(F.broadcast(spark.createDataFrame(found, "word string, stem string")), "word")
    return held.groupBy(F.col("stem").alias("term"), "id", "dl").agg(F.sum("tf").alias("tf"))


def term_counts(rows: DataFrame) -> DataFrame:
    """``chunk_id, source, dl, term, tf`` of ``chunk_id, source, tokens``.

    A text's words are counted inside its row, so that its postings needn't be
    shuffled to be counted. Those of a batch of texts come by source and term.
    """

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [t.split(" ") if t else [] for t in batch.column(2).to_pylist()]
        counts = [Counter(words) for words in lists]
        of = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        terms, tf = pa.array([t for c in counts for t in c], pa.string()), pa.array([n for c in counts for n in c.values()], pa.int64())
        dl = pa.array(np.array([len(words) for words in lists], np.int32)[of])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), dl, terms, tf], names=["chunk_id", "source", "dl", "term", "tf"])

    def places(column: pa.ChunkedArray) -> np.ndarray:
        """Each value's place among the distinct ones, in order; -1 for nulls."""
        coded = column.combine_chunks().dictionary_encode()
        place = np.append(np.argsort(np.argsort(np.array(coded.dictionary.to_pylist(), object))), -1)
        return place[coded.indices.fill_null(-1).to_numpy()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if parts := [counted(part) for part in slices(batch)]:
                rows = pa.Table.from_batches(parts)
                yield from rows.take(np.lexsort((places(rows["term"]), places(rows["source"])))).to_batches(1 << 16)

    ids = ", ".join(f"{c} {kind}" for c, kind in rows.select("chunk_id", "source").dtypes)
    return rows.select("chunk_id", "source", F.array_join("tokens", " ").alias("words")).mapInArrow(run, f"{ids}, dl int, term string, tf long")


def bm25(index: DataFrame, queries: DataFrame, total: int, average: float, counts: DataFrame | None = None) -> DataFrame:
    """``query, id, score`` for ``queries`` (``query, term``), a bounded table.

    A text must hold all terms of a query. Lower scores are better, as in the
    engine whose formula this is; ``total`` and ``average`` are the number of
    texts and their mean length. ``counts`` (``term, n``) says how many texts
    have a term, where ``index`` is only a part of the postings.
    """
    asked = queries.distinct()
    wanted = asked.groupBy("query").agg(F.count(F.lit(1)).alias("wanted"))
    held = index.join(F.broadcast(asked.select("term").distinct()), "term")  # a query set is small by contract
    seen = held.groupBy("term").agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.join(asked.select("term").distinct(), "term")
    idf = F.greatest(F.ln((total - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / average))
    rows = held.join(F.broadcast(seen), "term").join(F.broadcast(asked), "term")
    scores = rows.groupBy("query", "id").agg(F.sum(-part).alias("score"), F.count(F.lit(1)).alias("terms"))
    return scores.join(F.broadcast(wanted), "query").where("terms = wanted").select("query", "id", "score")


def ranked(scores: DataFrame, most: int, by: str = "query") -> DataFrame:
    """``rank`` from 1, lower scores first, ties by id; at most ``most``."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("score", "id"))
    return scores.withColumn("rank", place).where(F.col("rank") <= most)


def fuse(lists: DataFrame, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of ``list, query, id, rank``; an id counts once
    a list, at its best rank."""
    best = lists.groupBy("query", "list", "id").agg(F.min("rank").alias("rank"))
    return best.groupBy("query", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def write_postings(chunks: DataFrame, path: str) -> None:
    """Stores the postings of ``chunks`` (``chunk_id, source, text``) in a
    folder a source, by term, with the counts of all terms and the totals.

    Texts of a task are sorted by source, and each batch of them is stored as a
    run of postings by term: readers pass over the pages of other terms by
    their statistics. So postings are neither shuffled nor sorted by Spark, and
    neither a large source nor a common term is one task's work. Only where
    ids repeat, ranges of (source, term, chunk) are dealt over the tasks.
    """
    spark = chunks.sparkSession
    rows = chunks.select("chunk_id", "source", words(F.col("text")).alias("tokens"))
    if chunks.groupBy("chunk_id", "source").count().where("count > 1").isEmpty():
        placed = term_counts(chunks.sortWithinPartitions("source").select("chunk_id", "source", words(F.col("text")).alias("tokens")))
        files = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES)}
    else:  # rows of one id and length are one text; they meet in one range
        merged = term_counts(rows).repartitionByRange("source", "term", "chunk_id").groupBy("term", "chunk_id", "source", "dl").agg(F.sum("tf").alias("tf"))
        placed, files = merged.sortWithinPartitions("source", "term"), {}
    with arrow_batches(spark), settings(spark, files):
        placed.write.mode("overwrite").partitionBy("source").option("compression", "zstd").parquet(f"{path}/postings")
    stored = spark.read.parquet(f"{path}/postings")
    stored.groupBy("term").agg(F.count("*").alias("n")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    rows.agg(F.count("*").alias("total"), F.avg(F.size("tokens").cast("double")).alias("average")).write.mode("overwrite").parquet(f"{path}/totals")


def search_stored(path: str, queries: DataFrame, versions: DataFrame, source: str | None = None, snapshot: str | None = None, top_k: int = 10) -> DataFrame:
    """``query, rank, score, chunk_id, source, snapshot, title`` from stored
    postings: only the asked terms, and with ``source`` only its folder, are
    read. ``queries`` is a stated set, a few words each.

    A chunk appears with each of its ``versions`` (``chunk_id, source,
    snapshot, title``) that the filters leave. The best ``max(50, 4 * top_k)``
    of these rows (by BM25 over all sources' counts, chunk and snapshot) are
    ranked; a chunk counts once, at its best place, and the first ``top_k`` by
    reciprocal rank are returned with the newest version among the rows.
    """
    spark = queries.sparkSession
    terms = [r[0] for r in queries.select("term").distinct().collect()]
    index = spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms))
    if source is not None:
        index = index.where(F.col("source") == source)
        versions = versions.where(F.col("source") == source)
    if snapshot is not None:
        versions = versions.where(F.col("snapshot") == snapshot)
    counts = spark.read.parquet(f"{path}/terms").where(F.col("term").isin(terms))
    total, average = spark.read.parquet(f"{path}/totals").first()
    scores = bm25(index.select("term", F.col("chunk_id").alias("id"), "dl", "tf"), queries, total, average, counts)
    scores = scores.withColumn("score", F.round("score", 9))
    fanned = scores.join(versions.withColumnRenamed("chunk_id", "id"), "id")
    place = F.row_number().over(Window.partitionBy("query").orderBy("score", "id", "snapshot"))
    rows = fanned.withColumn("place", place).where(F.col("place") <= max(50, 4 * top_k))
    newest = F.max_by(F.struct("source", "snapshot", "title"), F.col("snapshot")).alias("v")
    best = rows.groupBy("query", "id").agg(F.min("place").alias("place"), newest).withColumn("score", 1.0 / (FUSION_K + F.col("place")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top_k).select("query", "rank", "score", F.col("id").alias("chunk_id"), "v.source", "v.snapshot", "v.title")


def chunk_by_id(asked: DataFrame, chunks: DataFrame, versions: DataFrame) -> DataFrame:
    """``chunks`` (``chunk_id, doc_id, ...``) asked for by ``chunk_id``, each
    with the newest of its ``versions``; unknown ids have no row."""
    newest = versions.groupBy("chunk_id").agg(F.max_by(F.struct("snapshot", "title"), F.col("snapshot")).alias("v"))
    rows = chunks.join(asked.select("chunk_id").distinct(), "chunk_id")
    return rows.join(newest, "chunk_id", "left").select(*chunks.columns, "v.snapshot", "v.title")


def document_by_id(asked: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``documents`` asked for by ``doc_id``, each with its ``chunks`` in order
    (``chunk_id, heading_path, idx``); a document without any has an empty list."""
    parts = F.array_sort(F.collect_list(F.struct("idx", "chunk_id", "heading_path")))
    wanted = asked.select("doc_id").distinct()
    held = chunks.join(wanted, "doc_id").groupBy("doc_id").agg(parts.alias("parts"))
    none = F.array().cast(held.schema["parts"].dataType)
    return documents.join(wanted, "doc_id").join(held, "doc_id", "left").withColumn("parts", F.coalesce("parts", none))


def snapshot_list(snapshots: DataFrame, source: str, limit: int) -> DataFrame:
    """The last ``limit`` snapshots of a source, newest first, with ``place``."""
    rows = snapshots.where(F.col("source") == source)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("started"), F.desc("snapshot")))
    return rows.withColumn("place", place).where(F.col("place") <= limit)
