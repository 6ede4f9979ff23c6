"""Folders of transcripts: what is found, and what is wrong with the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import channel_of, handle, video_id

#: Fixed layouts, tried in this order.
GLOBS = ("data/transcripts/by_video_id/*.txt", "**/1_transcripts/**/*.txt", "**/transcripts/*.txt")
FAULTS = ("bad_utf8", "no_video_id", "duplicate_id", "bad_metadata", "missing_metadata")


class Scan(NamedTuple):
    """``transcripts``: root, channel, video, path, metadata_path, published,
    layout (place of the first glob that fits). ``faults``: path, fault."""

    transcripts: DataFrame
    faults: DataFrame


def _pattern(glob: str) -> str:
    """Regular expression of a path pattern: ``**/`` any folders, ``*`` within one."""
    out = glob.replace(".", r"\.").replace("**/", "\0").replace("*", "[^/]*").replace("\0", "(?:[^/]+/)*")
    return f"^{out}$"


def _layout(rel: Column, globs: tuple[str, ...]) -> Column:
    place: Column = F.lit(None).cast("int")
    for k in range(len(globs) - 1, -1, -1):
        place = F.when(F.regexp_like(rel, F.lit(_pattern(globs[k]))), k + 1).otherwise(place)
    return place


def scan_transcripts(spark: SparkSession, roots: list[str], globs: tuple[str, ...] = GLOBS) -> Scan:
    """Transcripts below ``roots`` and the faults of files, from one listing.

    A file belongs to the first glob that fits. Its metadata lie beside it:
    ``id.meta.json``, or ``prefix_id_meta.json`` for ``prefix_id.txt``. They
    give channel and date; without them the folder and the name do. Each file
    has at most one row a fault: text that is no UTF-8 or without an id is no
    transcript; of equal ids in one channel the first layout, then the smallest
    path counts and the others are ``duplicate_id``; metadata that are missing
    or no JSON object leave the transcript as it is. Roots that don't exist
    fail the read.
    """
    parts = []
    for root in sorted(set(roots)):
        base = root.rstrip("/")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
        local = F.regexp_replace("path", "^file:/*", "/")
        at = F.length(F.lit(base.removeprefix("file:").replace("///", "/"))) + 2
        parts.append(files.select(F.lit(base).alias("root"), local.alias("path"), F.substr(local, at).alias("rel"), "content"))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    name = F.substring_index("rel", "/", -1)
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    text = F.col("content").cast("string")
    side = every.where(F.col("path").endswith(".json")).select("path", F.when(F.is_valid_utf8(text), F.from_json(text, "struct<published_at:string,published_date:string,channel_handle:string,channel_handle_raw:string,bad:string>", {"columnNameOfCorruptRecord": "bad"})).alias("meta")).withColumnRenamed("path", "metadata_path")
    texts = every.where(F.col("path").endswith(".txt")).withColumn("layout", _layout(F.col("rel"), globs)).where("layout IS NOT NULL")
    texts = texts.select("root", "path", "layout", folder.alias("folder"), name.alias("name"), video_id(name).alias("video"), F.is_valid_utf8(text).alias("valid"))
    beside = F.when(F.col("name") == F.concat("video", F.lit(".txt")), F.concat("video", F.lit(".meta.json"))).otherwise(F.concat(F.regexp_replace("name", r"\.txt$", ""), F.lit("_meta.json")))
    texts = texts.withColumn("metadata_path", F.concat("folder", F.lit("/"), beside)).join(side, "metadata_path", "left")
    known = F.col("meta").isNotNull() & F.col("meta.bad").isNull()
    given = lambda c: F.when(known & (F.trim(F.col(f"meta.{c}")) != ""), F.trim(F.col(f"meta.{c}")))
    day = F.coalesce(given("published_at"), given("published_date"))
    day = F.when(day.contains("T"), F.substring_index(day, "T", 1)).when(F.length(day) >= 10, F.substring(day, 1, 10))
    dated = F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1)
    # Legacy folders lie in the channel's, the others name it after their own.
    owner = F.when(F.col("folder").endswith("/transcripts"), F.regexp_extract("folder", "([^/]+)/transcripts$", 1)).otherwise(channel_of(F.col("folder")))
    texts = texts.select(
        "root", F.coalesce(handle(F.coalesce(given("channel_handle"), given("channel_handle_raw"))), owner).alias("channel"), "video", "path", F.when(F.col("meta").isNotNull(), F.col("metadata_path")).alias("metadata_path"),
        F.coalesce(day, F.when(dated != "", dated)).alias("published"), "layout", "valid", (F.col("meta").isNotNull() & ~known).alias("odd"),
    )
    good = F.col("valid") & F.col("video").isNotNull()
    order = F.struct("layout", "path")
    firsts = texts.where(good).groupBy("root", "channel", "video").agg(F.min(order).alias("first"))
    texts = texts.join(firsts, ["root", "channel", "video"], "left").withColumn("again", F.coalesce(good & (order != F.col("first")), F.lit(False)))
    held = [~F.col("valid"), F.col("video").isNull(), F.col("again"), F.col("odd"), good & ~F.col("again") & F.col("metadata_path").isNull()]
    faults = F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in zip(FAULTS, held, strict=True)]))
    found = texts.where(good & ~F.col("again")).select("root", "channel", "video", "path", "metadata_path", "published", "layout")
    return Scan(found, texts.select("path", F.explode(faults).alias("fault")))
