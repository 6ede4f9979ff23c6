"""A content-addressed table of vectors: what is known is read, what is
missing is computed once and added."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "key string, vector array<float>"


def vector_key(prefix: str, text: Column) -> Column:
    """Hash of what made the vector (model, settings) and hash of the text."""
    return F.concat_ws("__", F.sha2(F.lit(prefix), 256), F.sha2(text, 256))


def with_hits(texts: DataFrame, cache: DataFrame, prefix: str, text: str = "text") -> DataFrame:
    """``texts`` with ``key`` and ``hit``: whether ``cache`` (``key, ...``) has it."""
    known = cache.select("key", F.lit(True).alias("hit")).distinct()
    return texts.withColumn("key", vector_key(prefix, F.col(text))).join(known, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def missing_texts(hits: DataFrame, text: str = "text") -> DataFrame:
    """``key, text`` of what has to be computed, once for equal texts."""
    return hits.where("NOT hit").groupBy("key").agg(F.first(text).alias("text"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """All parts of the table at ``path``; empty where there is none. Parts
    that overlap (two writers at once) give one vector a key."""
    if not _parts(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{path}/part=*").groupBy("key").agg(F.first("vector").alias("vector"))


def embed_cached(texts: DataFrame, path: str, prefix: str, embed: Callable[[DataFrame], DataFrame], text: str = "text") -> DataFrame:
    """``texts`` with ``key`` and ``vector``; null texts have none.

    ``embed`` takes ``key, text`` and returns ``key, vector``; it is given
    only what the table at ``path`` lacks. Its rows are written beside the table
    and renamed into it as one folder, so readers see all of them or nothing,
    and what is there is never written again.
    """
    spark = texts.sparkSession
    hits = with_hits(texts.where(F.col(text).isNotNull()), read_cache(spark, path), prefix, text)
    missing = missing_texts(hits, text)
    if not missing.isEmpty():
        name = uuid.uuid4().hex
        embed(missing).select("key", F.col("vector").cast("array<float>").alias("vector")).write.parquet(f"{path}/_staged-{name}")
        files, at = _files(spark, path)
        if not files.rename(at(f"{path}/_staged-{name}"), at(f"{path}/part={name}")):
            raise OSError(f"vectors at {path} could not be added")
    keyed = texts.withColumn("key", F.when(F.col(text).isNotNull(), vector_key(prefix, F.col(text))))
    return keyed.join(read_cache(spark, path), "key", "left")


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _parts(spark: SparkSession, path: str) -> int:
    files, at = _files(spark, path)
    return len(files.globStatus(at(f"{path}/part=*")) or [])
