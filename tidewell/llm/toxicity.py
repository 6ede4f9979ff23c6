"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled rows is the example set. Every word of it is a
term; its weight in a text is (1 + log tf) * idf * gain ** GAIN_POWER, idf and
information gain taken from the examples, so that words which say nothing about
the label don't decide what is near. The factor of the gain departs from plain
TF-IDF. It was chosen on the learning rows alone, by three folds of 2,990 rows
of 300 words each: of the labels of the fold left out, the best threshold gets
5.8 % wrong by plain idf, 3.7 % with the root of the gain, 2.1 % with the gain
and 1.8 % with its square. A word that no example holds has no gain, so its
weight is zero in the norm too. The inverted index holds, for each term and block of examples, the postings and
their greatest weight; the weights of words that very many examples hold stand
side by side for all of them. Blocks are visited by their bound, so the nearest
examples are exact; distance-weighted votes, calibrated by folds, each
judged by weights and examples of the others, are the score, and the nearest
examples are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewell.llm._shared import read_table, stored
from tidewell.operators.batches import slices

MAX_EXAMPLES = 4_000  # labelled rows learned from
FOLDS = 3
OFTEN = 8  # words in an eighth of the examples or more have their weights side by side
NEAREST = 15
LEADING = 4  # blocks that are searched first
BLOCK = 64
THRESHOLD = 0.3
GAIN_POWER = 2
_WORD = re.compile(r"[^\W\d_]+")

Vector = tuple[np.ndarray, np.ndarray]  # term numbers and weights, of length one (or no terms)


def word_counts(text: str | None) -> Counter[str]:
    """How often each word (a run of letters, in lower case) is in a whole text."""
    return Counter(_WORD.findall((text or "").lower()))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of them, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _entropy(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return -p * np.log2(p) - (1 - p) * np.log2(1 - p)


def term_weights(n: np.ndarray, n1: np.ndarray, total: int, ones: float) -> np.ndarray:
    """idf * gain ** GAIN_POWER of terms in ``n`` of ``total`` examples,
    ``n1`` of them with label 1 (of ``ones`` in all)."""
    rest = np.maximum(total - n, 1)
    gain = _entropy(np.array(ones / total)) - n / total * _entropy(n1 / n) - (total - n) / total * _entropy((ones - n1) / rest)
    return np.log((1 + total) / (1 + n)) * np.maximum(gain, 0) ** GAIN_POWER


@dataclass
class Index:
    """Examples as postings by term and block, with block maxima."""

    terms: dict[str, int]
    weight: np.ndarray  # of each term
    ids: np.ndarray  # doc_id of each example
    labels: np.ndarray
    common: np.ndarray = field(default=None)  # term -> row of ``dense``, or -1
    dense: np.ndarray = field(default=None)  # weights of common words in all examples
    term_cells: np.ndarray = field(default=None)  # other terms -> cells (term, block)
    cell_block: np.ndarray = field(default=None)
    cell_max: np.ndarray = field(default=None)
    cell_rows: np.ndarray = field(default=None)  # cell -> postings
    lanes: np.ndarray = field(default=None)  # of a posting's example in its block
    weights: np.ndarray = field(default=None)
    levels: np.ndarray = field(default=None)  # calibration: votes ...
    chances: np.ndarray = field(default=None)  # ... to share of label 1

    def vector(self, counts: Counter[str]) -> Vector:
        """Unit vector of a whole text's words; words that no example holds have
        weight zero."""
        known = [(t, n) for w, n in counts.items() if (t := self.terms.get(w)) is not None]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        return self.unit(*np.array(known, np.int64).T)

    def unit(self, at: np.ndarray, tf: np.ndarray) -> Vector:
        order = np.argsort(at)
        at, tf = at[order], tf[order]
        w = (1 + np.log(tf)) * self.weight[at]
        at, w = at[w > 0], w[w > 0]
        return at, w / np.linalg.norm(w) if len(w) else w

    def build(self, vectors: list[Vector]) -> None:
        n_blocks = max(1, -(-len(vectors) // BLOCK))
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)])
        row = np.repeat(np.arange(len(vectors)), np.array([len(v[0]) for v in vectors], np.int64))
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        often = np.flatnonzero(np.bincount(term, minlength=len(self.terms)) * OFTEN >= max(1, len(vectors)))
        self.common = np.full(len(self.terms), -1, np.int32)
        self.common[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n_blocks * BLOCK))
        held = self.common[term] >= 0
        self.dense[self.common[term[held]], row[held]] = weight[held]
        term, row, weight = term[~held], row[~held], weight[~held]
        order = np.lexsort((row, term))
        self.lanes, self.weights = (row[order] % BLOCK).astype(np.uint8), weight[order]
        cells, first = np.unique(term[order] * n_blocks + row[order] // BLOCK, return_index=True)
        self.cell_rows = np.append(first, len(order)).astype(np.int32)
        self.cell_block = (cells % n_blocks).astype(np.int32)
        most = np.maximum.reduceat(self.weights, first) if len(first) else np.zeros(0)
        self.cell_max = np.nextafter(most.astype(np.float32), np.float32(2))  # never below the true maximum
        self.term_cells = np.searchsorted(cells // n_blocks, np.arange(len(self.terms) + 1)).astype(np.int32)

    def nearest(self, vector: Vector, k: int = NEAREST, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine, exact: first the blocks of greatest
        bound (the most that their common words give, and the block maxima of
        the others), then those whose bound exceeds the k-th best found; the
        rest are passed over. Equal cosines go to the smaller row."""
        at, w = vector
        n_blocks = max(1, -(-len(self.ids) // BLOCK))
        often = self.common[at] >= 0
        known = (w[often] @ self.dense[self.common[at[often]]]).reshape(n_blocks, BLOCK)
        at, w = at[~often], w[~often]
        sizes = (self.term_cells[at + 1] - self.term_cells[at]).astype(np.int64)
        cells, by = _ranges(self.term_cells[at].astype(np.int64), sizes), np.repeat(w, sizes)
        blocks = self.cell_block[cells]
        bound = known.max(axis=1) + np.bincount(blocks, by * self.cell_max[cells], n_blocks)
        rows, sims, done = np.zeros(0, np.int64), np.zeros(0), np.zeros(n_blocks, bool)
        first = np.argsort(-bound, kind="stable")[:LEADING]
        while len(first):
            place = np.full(n_blocks, -1)
            place[first] = np.arange(len(first))
            turn = place[blocks]
            kept = turn >= 0
            at, turn, weight = cells[kept], turn[kept], by[kept]
            starts = self.cell_rows[at].astype(np.int64)
            held = self.cell_rows[at + 1] - starts
            if (held == 1).all():
                posting = starts
            else:
                posting, turn, weight = _ranges(starts, held), np.repeat(turn, held), np.repeat(weight, held)
            score = known[first].ravel() + np.bincount(turn * BLOCK + self.lanes[posting], weight * self.weights[posting], len(first) * BLOCK)
            more = (first[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            real = (more < len(self.ids)) & (more != skip)
            rows, sims = np.concatenate([rows, more[real]]), np.round(np.concatenate([sims, score[real]]), 12)
            if len(sims) > k:
                near = np.flatnonzero(sims >= np.partition(sims, len(sims) - k)[len(sims) - k])
                near = near[np.lexsort((rows[near], -sims[near]))[:k]]
                rows, sims = rows[near], sims[near]
            done[first] = True
            first = np.flatnonzero(~done & (bound > (sims.min() if len(sims) == k else -1.0) - 1e-11))
        best = np.lexsort((rows, -sims))
        return rows[best], sims[best]

    def prior(self) -> float:
        """Share of label 1 among the examples."""
        return float(self.labels.mean()) if len(self.labels) else 0.0

    def votes(self, rows: np.ndarray, sims: np.ndarray) -> float:
        """Share of label 1 among the examples, weighted by 1 / distance;
        examples without a common word have no vote, and without votes it is
        the share among all."""
        near = sims > 0
        w = near / (1.02 - np.minimum(sims, 1))
        return float((w * self.labels[rows]).sum() / w.sum()) if near.any() else self.prior()

    def calibrate(self, votes: np.ndarray) -> None:
        """Isotonic map from the votes that each example got from the other
        folds to the share of label 1; equal votes are one level."""
        levels, at = np.unique(np.round(votes, 12), return_inverse=True)
        ones, counts = np.bincount(at, self.labels, len(levels)), np.bincount(at, minlength=len(levels))
        blocks: list[list[float]] = []  # pool adjacent violators: level sum, label sum, count
        for level, s, n in zip(levels.tolist(), ones.tolist(), counts.tolist(), strict=True):
            blocks.append([level * n, s, n])
            while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
                last = blocks.pop()
                blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
        prior = self.prior()
        self.levels = np.array([b[0] / b[2] for b in blocks] or [0.0])
        self.chances = np.maximum.accumulate(np.array([(b[1] + prior) / (b[2] + 1) for b in blocks] or [0.0]))

    def score(self, vector: Vector) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated vote, and the examples that it rests on. Examples of
        one label only tell nothing: all texts score 0."""
        rows, sims = self.nearest(vector)
        if not 0 < self.prior() < 1:
            return 0.0, rows, sims
        return float(np.interp(self.votes(rows, sims), self.levels, self.chances)), rows, sims


def training_rows(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> DataFrame:
    """``doc_id, text, toxic`` of labelled rows outside the held-out quarter,
    at most ``max_examples``, chosen by a hash of doc_id. Labels that repeat
    a doc_id count as their greatest; null labels are left out; of rows that
    repeat a doc_id the one with the smallest text is taken."""
    key = F.col("doc_id").cast("long")
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(key.alias("tw_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("tw_id").cast("string").cast("binary")) % 4 != 2)
    known = known.orderBy(F.xxhash64("tw_id"), "tw_id").limit(max_examples)
    texts = docs.select(key.alias("doc_id"), "text")
    rows = texts.join(F.broadcast(known), texts.doc_id == known.tw_id)  # bounded by max_examples
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """Learn term weights, example index and calibration. What reaches the
    driver are the word counts of at most ``max_examples`` texts; for the
    calibration the examples of each fold are searched in Spark tasks."""
    rows = stored(training_rows(docs, labels, max_examples), "examples")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [word_counts(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "toxic", "words", "counts"])

    counted = stored(rows.mapInArrow(words, "doc_id long, toxic int, words array<string>, counts array<long>"), "example-words")
    found = counted.orderBy("toxic", "doc_id").toArrow()
    column = found["words"].combine_chunks()
    values = column.flatten().dictionary_encode()
    ends = np.cumsum(column.value_lengths().to_numpy().astype(np.int64))
    names, number = values.dictionary.to_pylist(), np.split(values.indices.to_numpy(), ends[:-1]) if len(ends) else []
    times = [np.array(c, np.int64) for c in found["counts"].to_pylist()]
    ids, marks = found["doc_id"].to_numpy(), found["toxic"].to_numpy().astype(float)

    def made(chosen: np.ndarray) -> Index:
        number_, marks_ = [number[k] for k in chosen], marks[chosen]
        at = np.concatenate(number_ or [np.zeros(0, np.int64)])
        owner = np.repeat(np.arange(len(chosen)), [len(x) for x in number_])
        n, n1 = np.bincount(at, minlength=len(names)), np.bincount(at, marks_[owner], len(names))
        held = np.flatnonzero(n)
        weight = term_weights(n[held], n1[held], max(1, len(chosen)), marks_.sum())
        new = np.zeros(len(names), np.int64)
        new[held] = np.arange(len(held))
        index = Index({names[k]: i for i, k in enumerate(held.tolist())}, weight, ids[chosen], marks_)
        index.build([index.unit(new[x], times[k]) for k, x in zip(chosen, number_, strict=True)])
        return index

    index, every = made(np.arange(len(ids))), np.arange(len(ids))
    votes = np.zeros(len(ids))
    for fold in range(FOLDS):
        asked = every % FOLDS == fold  # examples stand by label, so each fold has its share
        votes[asked] = _votes(counted, ids[asked], made(every[~asked]))
    index.calibrate(votes)
    return index


def _votes(counted: DataFrame, ids: np.ndarray, index: Index) -> np.ndarray:
    """The votes that the examples ``ids`` get from those of ``index``."""
    sent, place = _sent(counted.sparkSession, index), {d: k for k, d in enumerate(ids.tolist())}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            rows = [r for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) if r[0] in place]
            made = [index.votes(*index.nearest(index.vector(Counter(dict(zip(w, c, strict=True)))))) for _, w, c in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(made, pa.float64())], names=["doc_id", "vote"])

    found = counted.select("doc_id", "words", "counts").mapInArrow(vote, "doc_id long, vote double").toArrow()
    sent.unpersist()
    votes = np.zeros(len(ids))
    votes[[place[d] for d in found["doc_id"].to_pylist()]] = found["vote"].to_numpy()
    return votes


def _sent(spark: SparkSession, index: Index) -> Broadcast[Index]:
    """The index for all tasks; the bound on its examples bounds it (some
    300,000 postings of 12 bytes for each 1,000 examples of 300 words)."""
    return spark.sparkContext.broadcast(index)


def score_documents(docs: DataFrame, index: Index, with_evidence: bool = False) -> DataFrame:
    """``docs`` with ``tw_score`` (0 to 1) and, if asked for, ``tw_evidence``
    (array of doc_id and similarity of the nearest examples).

    Texts without a known word, null and empty ones too, get the calibrated
    share of label 1 among the examples. Rows may repeat; equal texts score
    alike. All other columns pass through, whatever their names; an empty
    table gives an empty result.
    """
    kept = [c for c in docs.columns if c not in ("tw_score", "tw_evidence")]
    found = _scored(docs.select(*[F.col(f"`{c}`") for c in kept]), index, with_evidence)
    return found.select("row.*", *found.columns[1:])


def _scored(docs: DataFrame, index: Index, with_evidence: bool = False) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, beside what
    ``score_documents`` finds: each text goes to Python once, and slices of a
    batch become Python objects."""
    sent = _sent(docs.sparkSession, index)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in (part for whole in batches for part in slices(whole)):
            made, why = [], []
            for text in batch.column(0).field("text").to_pylist():
                value, rows, sims = index.score(index.vector(word_counts(text)))
                made.append(value)
                if with_evidence:
                    why.append([{"doc_id": int(index.ids[r]), "similarity": float(s)} for r, s in zip(rows, sims, strict=True)])
            columns, names = [batch.column(0), pa.array(made, pa.float64())], ["row", "tw_score"]
            if with_evidence:
                columns.append(pa.array(why, pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64())]))))
                names.append("tw_evidence")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = StructType([*rows.schema.fields, StructField("tw_score", DoubleType())])
    if with_evidence:
        out = StructType([*out.fields, StructField("tw_evidence", ArrayType(StructType([StructField("doc_id", LongType()), StructField("similarity", DoubleType())])))])
    return rows.mapInArrow(score, out)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below the threshold, columns unchanged."""
    return _scored(docs, fit(docs, labels)).where(F.col("tw_score") < THRESHOLD).select("row.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``. Rows with a null doc_id have a null
    ``held_out``; for odd texts, repeats and empty tables see ``score_documents``."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, index).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).alias("held_out"),
        F.col("tw_score").alias("score"),
        (F.col("tw_score") >= THRESHOLD).cast("int").alias("predicted"),
    )
