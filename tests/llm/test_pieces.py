import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SMALL
from tests.llm.helpers import clashing, empty, odd_documents
from tidewell.llm import pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@given(st.text(st.one_of(st.sampled_from(" \n\t▁aeinrst<>s/0x"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_ids_and_text_equal_the_library(text):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = pieces.piece_model(PATH)
    ids = library.encode(text)
    assert model.encode(text) == ids
    assert model.decode(ids) == library.decode(ids)


def test_long_runs_without_spaces(library):
    for text in ("ab" * 3000, "a" * 5000, "thethatand" * 800, "=" * 999 + "x" * 999, "日本語" * 700, " " * 2000):
        assert pieces.piece_model(PATH).encode(text) == library.encode(text)


def test_split_is_the_merge_rule():
    model = pieces.piece_model(PATH)
    for text in ("▁unbelievable", "▁international", "▁erthanding", "▁ththwhwhblee", "▁▁▁▁a"):
        assert model.split(text) == model.merge(text)


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in pieces.op4_sentencepiece(spark, SMALL).collect():
        ids = library.encode(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, library):
    found = pieces.encode_pieces(clashing(odd_documents(spark)), PATH, with_ids=True).collect()
    assert len(found) == 11
    assert [r["n_tokens"] for r in found if r["doc_id"] in (1, 2)] == [0, 0]
    assert all(r["decoded_sha256"] == hashlib.sha256(b"").hexdigest() for r in found if r["n_tokens"] == 0)
    assert [list(r["ids"]) for r in found if r["doc_id"] == 8] == [library.encode("naïve \u0000 𝒳 ﬁ ▁ ｆｕｌｌ   end")]
    assert pieces.encode_pieces(empty(spark), PATH).count() == 0


def test_workers_keep_nothing_of_the_texts(spark):
    """Python workers outlive the stage; what they learned from texts mustn't."""
    texts = [(k, " ".join(f"w{k * 100 + j}x" for j in range(100))) for k in range(40)]
    assert pieces.encode_pieces(spark.createDataFrame(texts, "doc_id long, text string"), PATH).agg({"n_tokens": "sum"}).first()[0] > 4000

    def held(batches):
        from tidewell.llm import pieces as module

        for batch in batches:
            yield batch.assign(id=sum(len(m.known) + len(m.fits) for m in module._models.values()))

    assert spark.range(64).repartition(16).mapInPandas(held, "id long").agg({"id": "max"}).first()[0] == 0
