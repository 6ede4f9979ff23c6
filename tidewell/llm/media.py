"""PNG images in binary columns: checked chunks, unfiltering, DCT hashes.

A payload becomes an 8-bit grey image 576 samples wide. The reader handles all
five PNG row filters; the writer picks none, sub or up by the smallest sum of
absolute residuals in each row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table, stored

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 576
PAD = b"\xff"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(samples: np.ndarray, level: int = 6) -> bytes:
    """An 8-bit grey PNG of a two-dimensional uint8 array."""
    height, width = samples.shape
    left = np.zeros_like(samples)
    left[:, 1:] = samples[:, :-1]
    above = np.zeros_like(samples)
    above[1:] = samples[:-1]
    forms = np.stack([samples, samples - left, samples - above])
    cost = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64)
    best = cost.argmin(axis=0)
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = best
    rows[:, 1:] = forms[best, np.arange(height)]
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    kinds, out = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown PNG row filter")
    sub = kinds == 1
    out[sub] = np.cumsum(out[sub], axis=1, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(kinds == 2)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):
        if kinds[a] == 2:  # a run of rows that each add to the row above
            if a:
                out[a] += out[a - 1]
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8)
        else:
            for y in np.flatnonzero(kinds[a:b] > 2) + a:
                _unfilter_row(out, y, kinds[y])
    return out


def _unfilter_row(out: np.ndarray, y: int, kind: int) -> None:
    row, up = out[y].astype(int).tolist(), (out[y - 1].astype(int).tolist() if y else [0] * out.shape[1])
    for x in range(len(row)):
        a, b, c = (row[x - 1], up[x], up[x - 1]) if x else (0, up[x], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        row[x] = (row[x] + guess) & 255
    out[y] = row


def decode_png(data: bytes) -> np.ndarray:
    """Samples of an 8-bit grey PNG, with every chunk's checksum tested."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", data, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk checksum differs")
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", body)
            if rest != [8, 0, 0, 0, 0]:
                raise ValueError("only 8-bit grey PNGs without interlace are read")
            shape = (height, width + 1)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape)
    return _unfilter(rows)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi / n * np.outer(k, k + 0.5))


COSINES = _cosines(32)[:8]


def _pooled(image: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Mean over n equal, possibly fractional spans of an axis."""
    size = image.shape[axis]
    total = np.concatenate([np.zeros_like(image.take([0], axis)), np.cumsum(image, axis)], axis)
    at = np.arange(n + 1) * size / n
    low = np.minimum(at.astype(int), size - 1)
    part = (at - low).reshape([-1 if k == axis else 1 for k in range(2)])
    value = total.take(low, axis) * (1 - part) + total.take(low + 1, axis) * part
    return np.diff(value, axis=axis) * (n / size)


def dct_hash(image: np.ndarray) -> str:
    """64 bits: which of the 8 x 8 lowest cosine coefficients of the image,
    pooled to 32 x 32, lie above their median (the mean level is left out)."""
    low = COSINES @ _pooled(_pooled(image.astype(np.float64), 32, 0), 32, 1) @ COSINES.T
    flat = np.round(low.ravel(), 6)
    flat[0] = 0
    return np.packbits(flat > np.median(flat[1:])).tobytes().hex()


def pack_text(raw: bytes, unit: int = WIDTH) -> bytes:
    """``raw`` filled with bytes 255 to a positive multiple of ``unit``."""
    return raw + PAD * (max(1, -(-len(raw) // unit)) * unit - len(raw))


def text_to_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, media``: the UTF-8 bytes of each text as a PNG.

    Null texts are empty; ids may be null or repeated and are passed through.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                sizes.append(len(raw))
                media.append(encode_png(np.frombuffer(pack_text(raw), np.uint8).reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, n_bytes long, media binary")


def png_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored PNGs; digests of samples and of the stored form, DCT hash."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                image = decode_png(data)
                raw = image.tobytes()
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(data), hashlib.sha256(data).hexdigest(), dct_hash(image)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(id_col, "n_bytes", "media").mapInArrow(decode, schema)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return png_features(stored(text_to_png(docs), "media"))
