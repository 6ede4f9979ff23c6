"""Corpus pipeline: five stages, each over all rows that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next one's ``docs``.

All stages take rows with nulls in any column, empty and very long texts, rows
that repeat, and columns of any further names; an empty table gives an empty
result. What each makes of them stands with the operator: ``drop_toxic``,
``dedup_chunks``, ``keep_representatives``, ``sample_mixed``,
``encode_pieces``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import line_chunks, mixing, pieces, simhash, toxicity
from tidewell.llm._shared import read_table, stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go. Texts without a known
    word, null and empty ones too, score as the share of toxic examples; rows
    with equal texts fare alike."""
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut; documents keep what is left. Null and
    empty texts stay as they are; of equal chunks the first by doc_id and place
    stays, so a repeated row loses the same as its twin."""
    return line_chunks.dedup_chunks(docs)


def dedup_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the
    smallest doc_id, ties by a hash of the text. Texts without words, null or
    empty, are one group."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to the target weights; those of cells that need
    more than they have come more than once. Null sources and languages are
    values of their own; null and empty texts weigh nothing."""
    return mixing.sample_mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row a
    document; null texts are empty."""
    return pieces.encode_pieces(docs, pieces.default_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_similar),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # toxicity, similarity and encoding are beyond SQL; see tests/llm


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
