"""Token ids in binary shard files with a minimal perfect hash index.

Documents are range-partitioned by id before they are encoded, so each task
holds a run of ids and fills shards in order. A shard is one file: header, raw
ids, then the index. Shards go through Spark's text writer, one record a file
with a closing line feed, so that any store that Spark reaches will do. The
folder names carry each shard's token count and its first and last key; the
global offsets and the shard of a key come from a listing, without opening
files.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import arrow_batches, read_table, shared_path

MAGIC = b"TWSHARD1"
HEADER = struct.Struct("<8sIIQQQQ")  # magic, id bytes, spare, documents, tokens, keys, buckets
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
CACHE_LIMIT = 400_000


class ChunkEncoder:
    """Ids of whole texts from a ``tokenizers`` file.

    Texts are cut at spaces and line feeds, which the tokenizer drops and
    never merges across; ids of the first ``CACHE_LIMIT`` chunks are kept.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        probe = "It's  naïve,\n1st <|x|>"
        parts = [i for c in probe.replace("\n", " ").split(" ") if c for i in self.tokenizer.encode(c, add_special_tokens=False).ids]
        if parts != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            raise ValueError("this tokenizer does not drop white space; texts cannot be cut there")
        self.known: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {"": b""}  # lower-case letters, "." and ","
        self.lowers = self._ids(["Äé"]) == self._ids(["äé"])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        self.closing[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, chunks: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """As ``_ids``, for words of one piece each: many are encoded as one
        text, which is cut at the tokens that end a word."""
        out: list[bytes] = []
        groups = [words[k : k + 200] for k in range(0, len(words), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, self.dtype)
            ends = (np.flatnonzero(self.closing[ids]) + 1) * self.dtype.itemsize
            if len(ends) != len(group):
                out.extend(self._ids(group))
                continue
            raw, at = ids.tobytes(), 0
            for end in ends.tolist():
                out.append(raw[at:end])
                at = end
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks. Letters and a full stop or comma after them are
        always split, and case is lost, so such chunks are put together from
        their words; this holds for Latin letters in composed form."""
        found: dict[str, bytes] = {}
        words, plain = {}, []
        for c in chunks:
            core, tail = (c[:-1], c[-1]) if c[-1] in ".," else (c, "")
            if self.lowers and core.isalpha() and max(core) < "\u0250" and "\u0130" not in core:
                words[c] = (core.lower(), tail)
            else:
                plain.append(c)
        known = self.words
        new = [w for w in {x for pair in words.values() for x in pair} if w not in known]
        fresh = dict(zip(new, self._word_ids(new), strict=True))
        for c, (core, tail) in words.items():
            found[c] = (fresh.get(core) or known.get(core, b"")) + (fresh.get(tail) or known.get(tail, b""))
        found.update(zip(plain, self._ids(plain), strict=True))
        if len(known) < CACHE_LIMIT:
            known.update(fresh)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        known = self.known
        cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
        rows = [list(map(known.get, chunks)) for chunks in cut]
        missing = [[k for k, v in enumerate(row) if v is None] if None in row else () for row in rows]
        if new := {chunks[k] for chunks, at in zip(cut, missing, strict=True) for k in at}:
            found = self._learn(list(new))
            for chunks, row, at in zip(cut, rows, missing, strict=True):
                for k in at:
                    row[k] = found[chunks[k]]
            if len(known) < CACHE_LIMIT:  # the frequent chunks come early
                known.update(found)
        return [b"".join(row) for row in rows]


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder, kept with what it has learned in a Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _mixed(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h + np.asarray(seed).astype(np.uint64) * np.uint64(MIX[0]) + np.uint64(MIX[0])
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[1])
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[2])
    return h ^ (h >> np.uint64(31))


def _key_hashes(keys: list[int | None]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(repr(k)) for k in keys], np.uint64)


def build_mph(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and displace: a seed for each bucket, and the slot of each key.

    n distinct hashes get the slots 0 to n - 1. Large buckets are placed first,
    by the first seed that finds free slots; buckets of one key take what
    slots are left and store them directly, as negative numbers.
    """
    n = len(hashes)
    n_buckets = max(1, n // 3)
    bucket = (_mixed(hashes, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket, minlength=n_buckets)
    starts = np.cumsum(counts) - counts
    seeds, slots, free = np.zeros(n_buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for b in np.argsort(-counts, kind="stable"):
        keys = order[starts[b] : starts[b] + counts[b]]
        if len(keys) < 2:
            break
        first = 1
        while True:
            tried = np.arange(first, first + 32)
            at = (_mixed(hashes[keys][:, None], tried[None, :]) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(at, axis=0)
            good = np.flatnonzero(free[at].all(axis=0) & (ranked[1:] != ranked[:-1]).all(axis=0))
            if len(good):
                seeds[b], slots[keys] = tried[good[0]], at[:, good[0]]
                free[slots[keys]] = False
                break
            first += 32
    lone = np.flatnonzero(counts == 1)
    left = np.flatnonzero(free)
    slots[order[starts[lone]]] = left
    seeds[lone] = -1 - left
    return seeds, slots


def _slot(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    seed = seeds[(_mixed(h, 0) % np.uint64(len(seeds))).astype(np.int64)]
    placed = (_mixed(h, np.maximum(seed, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(seed < 0, -1 - seed, placed)


def build_shard(keys: list[int | None], ids: list[bytes], dtype: np.dtype) -> bytes:
    """A shard of documents in order; a repeated key is indexed at its first."""
    lengths = np.array([len(x) for x in ids], np.int64) // dtype.itemsize
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    first: dict[int | None, int] = {}
    for at, k in enumerate(keys):
        first.setdefault(k, at)
    hashes = _key_hashes(list(first))
    seeds, slots = build_mph(hashes)
    position, mark = np.empty(len(first), "<u4"), np.empty(len(first), "<u4")
    position[slots] = list(first.values())
    mark[slots] = (_mixed(hashes, 7) >> np.uint64(32)).astype(np.uint32)
    return b"".join(
        [
            HEADER.pack(MAGIC, dtype.itemsize, 0, len(keys), int(offsets[-1]), len(first), len(seeds)),
            *ids,
            offsets.astype("<i8").tobytes(),
            np.array([k or 0 for k in keys], "<i8").tobytes(),
            np.array([k is None for k in keys], np.uint8).tobytes(),
            seeds.astype("<i8").tobytes(),
            position.tobytes(),
            mark.tobytes(),
            b"\n",
        ]
    )


class Shard:
    """Reader of one shard file. ``lookup`` takes constant time a key."""

    def __init__(self, data: bytes) -> None:
        magic, width, _, docs, tokens, keys, buckets = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, parts = HEADER.size, []
        for kind, n in ((f"<u{width}", tokens), ("<i8", docs + 1), ("<i8", docs), ("u1", docs), ("<i8", buckets), ("<u4", keys), ("<u4", keys)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.ids, self.offsets, keys_at, absent, self.seeds, self.position, self.mark = parts
        self.keys = [None if gone else k for k, gone in zip(keys_at.tolist(), absent.tolist(), strict=True)]

    def find(self, keys: list[int | None]) -> np.ndarray:
        """Positions of keys in the shard, -1 for keys that it lacks."""
        h = _key_hashes(keys)
        slot = _slot(h, self.seeds, len(self.position))
        known = self.mark[slot] == (_mixed(h, 7) >> np.uint64(32)).astype(np.uint32)
        at = np.where(known, self.position[slot].astype(np.int64), -1)
        return np.array([a if a >= 0 and self.keys[a] == k else -1 for a, k in zip(at.tolist(), keys, strict=True)], np.int64)

    def lookup(self, key: int | None) -> np.ndarray | None:
        at = int(self.find([key])[0])
        return None if at < 0 else self.ids[self.offsets[at] : self.offsets[at + 1]]


def write_token_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_bytes: int = 4 << 20) -> None:
    """Encode ``doc_id, text`` and write shards in ascending doc_id order.

    Null texts are empty, null ids come first, rows with the same id are
    ordered by text; every document ends with ``end_id``. A shard has about
    ``shard_bytes`` of ids, or one longer document.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = chunk_encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, seq, keys, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            blob = build_shard(keys, ids, encoder.dtype)
            row = [[part], [seq], [keys[0]], [keys[-1]], [size // encoder.dtype.itemsize], [blob]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds, strict=True)], names=["part", "seq", "first_key", "last_key", "n_tokens", "value"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                for key, raw in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1).to_pylist()), strict=True):
                    keys.append(key)
                    ids.append(raw + end)
                    size += len(ids[-1])
                    if size >= shard_bytes:
                        yield shard()
                        seq, keys, ids, size = seq + 1, [], [], 0
        if keys:
            yield shard()

    shards = (
        docs.select(F.col("doc_id").cast("long"), F.col("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(build, "part int, seq int, first_key long, last_key long, n_tokens long, value binary")
    )
    with arrow_batches(docs.sparkSession):
        (
            shards.withColumn("value", F.col("value").cast("string"))
            .write.partitionBy("part", "seq", "first_key", "last_key", "n_tokens")
            .option("lineSep", "\n")
            .text(path)
        )


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document ``doc_id, start, n_tokens, ids_crc32`` from the files.

    Each document's ids are found through its shard's index (rows that repeat
    a key follow the first one). ``start`` adds the token counts of all earlier
    shards: sums per task, then within a task.
    """
    files = spark.read.format("binaryFile").load(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                shard = Shard(content.as_py())
                firsts = shard.find(shard.keys)
                rows, seen = [], Counter()
                for key, first in zip(shard.keys, firsts.tolist(), strict=True):
                    if first < 0:
                        raise ValueError("a document is not found by the shard's index")
                    at = first + seen[key]
                    seen[key] += 1
                    a, b = int(shard.offsets[at]), int(shard.offsets[at + 1])
                    rows.append((key, a, b - a, zlib.crc32(shard.ids[a:b].astype("<u4").tobytes())))
                cols = [*zip(*rows, strict=True)]
                head = [pa.array([x.as_py()] * len(rows), pa.int32()) for x in (part, seq)]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(c, pa.int64()) for c in cols)], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    if not files.columns[-1] == "n_tokens":  # no shards: an empty table was written
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    shards = files.select(F.col("part").cast("int").alias("part"), F.col("seq").cast("int").alias("seq"), F.col("n_tokens").cast("long").alias("shard_tokens"))
    parts = shards.groupBy("part").agg(F.sum("shard_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each write task
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.join(parts, "part").select("part", "seq", (F.col("part_start") + F.coalesce(F.sum("shard_tokens").over(within), F.lit(0))).alias("shard_start"))
    docs = files.select(F.col("part").cast("int"), F.col("seq").cast("int"), "content").mapInArrow(read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup_tokens(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the first document of each of ``keys`` (column
    ``doc_id``; null is a key too) that the shards at ``path`` hold.

    A key goes to the write tasks whose bounds hold it (a row a task, sent to
    all), then to the shard within the task by the bounds in the folder names;
    only these shards are opened, and the perfect hash gives the place.
    Keys that no shard holds give no row; repeated keys give one.
    """
    files = spark.read.format("binaryFile").load(path)
    if files.columns[-1] != "n_tokens":
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    low, least = F.col("first_key").cast("long"), F.lit(-(2**63))  # null keys come first
    shards = files.select("path", F.col("part").cast("int").alias("part"), F.col("seq").cast("int").alias("seq"), F.coalesce(low, least).alias("first_key"), F.coalesce(F.col("last_key").cast("long"), least).alias("last_key"))
    parts = shards.groupBy(F.col("part").alias("in_part")).agg(F.min("first_key").alias("low"), F.max("last_key").alias("high"))
    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("k", F.coalesce("doc_id", least))
    wanted = wanted.join(F.broadcast(parts), F.col("k").between(F.col("low"), F.col("high"))).select("doc_id", "k", F.col("in_part").alias("part"))
    found = wanted.join(shards, "part").where(F.col("k").between(F.col("first_key"), F.col("last_key")))
    asked = found.groupBy("path").agg(F.min("part").alias("part"), F.min("seq").alias("seq"), F.collect_list(F.struct("doc_id")).alias("asked"))  # no more than a shard's documents

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, rows, seq in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(content.as_py())
                hits = [(r["doc_id"], ids.astype(np.int64)) for r in rows if (ids := shard.lookup(r["doc_id"])) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int64())), pa.array([seq] * len(hits), pa.int32())], names=["doc_id", "ids", "seq"])

    opened = files.select("path", "content").join(asked, "path").select("content", "asked", asked["seq"])
    return opened.mapInArrow(read, "doc_id long, ids array<long>, seq int").groupBy("doc_id").agg(F.min_by("ids", "seq").alias("ids"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all of ``documents``, read back; for odd rows see
    ``write_token_shards``; an empty table gives an empty result."""
    import public_tokenizers

    path = shared_path(spark, "token-shards")
    docs = read_table(spark, sf_dir, "documents")
    write_token_shards(docs, path, str(public_tokenizers.path("word_bpe_49k.json")))
    return read_token_shards(spark, path)
