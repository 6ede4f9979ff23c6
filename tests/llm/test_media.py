import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SMALL
from tests.llm.helpers import clashing, empty, odd_documents
from tidewell.llm import media


@given(st.binary(max_size=3000))
@settings(max_examples=60, deadline=None)
def test_round_trip(raw):
    packed = media.pack_text(raw)
    assert len(packed) % 576 == 0 and len(packed) >= 576 and packed.startswith(raw)
    image = np.frombuffer(packed, np.uint8).reshape(-1, 576)
    assert media.decode_png(media.encode_png(image)).tobytes() == packed


def filtered(image, kinds):
    """PNG rows under given filters, by the plain rule of the format."""
    out, h, w = [], *image.shape
    at = lambda y, x: int(image[y, x]) if y >= 0 and x >= 0 else 0
    for y in range(h):
        row = [kinds[y]]
        for x in range(w):
            a, b, c = at(y, x - 1), at(y - 1, x), at(y - 1, x - 1)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            row.append((at(y, x) - [0, a, b, (a + b) // 2, paeth][kinds[y]]) & 255)
        out.append(bytes(row))
    return b"".join(out)


def png(image, kinds):
    h, w = image.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(filtered(image, kinds))) + media._chunk(b"IEND", b"")


def test_all_row_filters_are_undone():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (40, 17), dtype=np.uint8)
    for kinds in ([k % 5 for k in range(40)], [2] * 40, [4] * 40, [3] * 40, [1] * 40, rng.integers(0, 5, 40).tolist()):
        assert (media.decode_png(png(image, kinds)) == image).all()


def test_damage_is_found():
    data = bytearray(media.encode_png(np.zeros((2, 576), np.uint8)))
    data[-20] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(bytes(data))


def test_hash_is_the_plain_transform():
    image = np.random.default_rng(2).integers(0, 256, (64, 96)).astype(np.uint8)
    pooled = image.reshape(32, 2, 32, 3).mean(axis=(1, 3))
    low = np.array([[sum(pooled[y, x] * np.cos(np.pi / 32 * u * (y + 0.5)) * np.cos(np.pi / 32 * v * (x + 0.5)) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).ravel()
    low[0] = 0
    bits = np.round(low, 6) > np.median(np.round(low[1:], 6))
    assert media.dct_hash(image) == np.packbits(bits).tobytes().hex()


def test_query_gives_the_payloads(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = media.op6_media(spark, SMALL).collect()
    assert len(found) == len(texts)
    seen = {}
    for row in found:
        raw = texts[row["doc_id"]].encode()
        packed = media.pack_text(raw)
        assert (row["n_bytes"], row["payload_bytes"]) == (len(raw), len(packed))
        assert row["payload_sha256"] == hashlib.sha256(packed).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(packed[-32:])
        key = (row["media_bytes"], row["media_sha256"], row["feature"])
        assert seen.setdefault(texts[row["doc_id"]], key) == key


def test_odd_rows(spark):
    found = media.png_features(media.text_to_png(clashing(odd_documents(spark)))).collect()
    assert len(found) == 11
    blank = [r for r in found if r["n_bytes"] == 0]
    assert len(blank) == 3 and {r["payload_bytes"] for r in blank} == {576}
    assert media.png_features(media.text_to_png(empty(spark))).count() == 0
