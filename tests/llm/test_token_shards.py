import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.compare import SMALL
from tests.llm.helpers import clashing, empty, odd_documents
from tidewell.llm import token_shards

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = token_shards.ChunkEncoder(PATH)


def plain_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@given(st.text(st.one_of(st.sampled_from(" \n\t.,'AaeiÉéßİı<|endoftext|>0́"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library(text):
    assert np.frombuffer(ENCODER.encode([text])[0], ENCODER.dtype).tolist() == plain_ids(text)


@given(st.lists(st.integers(-(2**62), 2**62), unique=True, min_size=1, max_size=400))
@settings(max_examples=40, deadline=None)
def test_hash_is_minimal_and_perfect(keys):
    hashes = token_shards._key_hashes(keys)
    seeds, slots = token_shards.build_mph(hashes)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    assert token_shards._slot(hashes, seeds, len(keys)).tolist() == slots.tolist()


def test_shard_lookup():
    keys = [5, None, -3, 5, 7]
    ids = [np.array([k], "<u2").tobytes() * (k + 1) for k in range(5)]
    shard = token_shards.Shard(token_shards.build_shard(keys, ids, np.dtype("<u2")))
    assert shard.lookup(None).tolist() == [1, 1] and shard.lookup(-3).tolist() == [2] * 3
    assert shard.lookup(5).tolist() == [0]  # of a repeated key, the first
    assert all(shard.lookup(k) is None for k in range(100, 400))


def test_query_equals_library(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    ids = [[*plain_ids(t), 2] for _, t in docs]
    starts = [0, *accumulate(map(len, ids))]
    wanted = {d: (s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (d, _), x, s in zip(docs, ids, starts, strict=False)}
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_shards.op9_token_ids(spark, SMALL).collect()}
    assert found == wanted


def test_odd_rows_and_many_shards(spark, tmp_path):
    docs = clashing(odd_documents(spark))
    path = str(tmp_path / "s")
    token_shards.write_token_shards(docs, path, PATH, shard_bytes=64)
    found = token_shards.read_token_shards(spark, path).orderBy("start").collect()
    ordered = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in found] == [d for d, _ in ordered]
    assert [r["n_tokens"] for r in found] == [len(plain_ids(t)) + 1 for _, t in ordered]
    assert [r["start"] for r in found] == [0, *accumulate(r["n_tokens"] for r in found)][:-1]


def test_keys_are_found_over_many_shards(spark, tmp_path):
    path = str(tmp_path / "s")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).selectExpr("doc_id * 10000000 AS doc_id", "text"))
    token_shards.write_token_shards(docs.repartition(4), path, PATH, shard_bytes=4096)
    texts = {}
    for r in sorted(docs.collect(), key=lambda r: r["text"] or ""):
        texts.setdefault(r["doc_id"], r["text"])
    asked = [*texts, -5, 10**15, 3 * 10**7 + 1]
    found = token_shards.lookup_tokens(spark, path, spark.createDataFrame([(k,) for k in [*asked, *asked]], "doc_id long"))
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {k: [*plain_ids(t), 2] for k, t in texts.items()}
    assert len(found.collect()) == len(texts)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "s")
    token_shards.write_token_shards(empty(spark), path, PATH)
    assert token_shards.lookup_tokens(spark, path, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    assert token_shards.read_token_shards(spark, path).count() == 0


def test_foreign_file_is_refused():
    with pytest.raises(ValueError, match="not a token shard"):
        token_shards.Shard(b"x" * 100)
