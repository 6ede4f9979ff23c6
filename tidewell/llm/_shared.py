"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.batches import arrow_batches as arrow_batches


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none, as in local tests, a folder of this
    machine is set instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor rereads files instead of recomputing.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small iterated tables."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint only if its rows, measured as JSON, take at
    most ``most`` bytes; otherwise unchanged, so that Spark shuffles."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def broadcast_blocks(df: DataFrame, key: str, most: int = 32 << 20) -> list[DataFrame]:
    """``df``, a stored table of a stated query set, dealt by the hash of
    ``key`` over blocks of at most about ``most`` bytes, measured as JSON, each
    with a broadcast hint. What is joined to them is read once a block."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    blocks = -(-size // most) or 1
    return [F.broadcast(df if blocks == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)) for k in range(blocks)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
