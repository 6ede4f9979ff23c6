import zlib

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from tests.compare import connection, sorted_rows
from tests.llm.helpers import clashing, empty, odd_documents
from tidewell.llm import line_chunks, mixing

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, by name; ``documents`` is the input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found, top = {"documents": docs}, tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{top}/{name}")
        docs = found[name] = spark.read.parquet(f"{top}/{name}")
    return found


def test_stages_keep_the_columns(stages):
    columns = stages["documents"].columns
    assert all(df.columns == columns for name, df in stages.items() if name != "sentencepiece")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_decisions_take_effect(stages):
    n = {k: df.count() for k, df in stages.items()}
    assert n["documents"] > n["toxicity"] == n["line_dedup"] > n["near_dedup"] > 0 and n["mixing"] == n["sentencepiece"] > 0


def test_clean_documents_stay(spark, stages):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages["toxicity"].select("doc_id").collect()}
    clean = [d for d, t in labels.items() if t == 0 and zlib.crc32(str(d).encode()) % 4 == 2]  # not learned from
    assert sum(d in kept for d in clean) >= 0.95 * len(clean)


def test_native_stages_equal_their_sql(stages):
    con = connection(FOLDER)
    con.register("kept", stages["toxicity"].toArrow())
    wanted = con.sql(line_chunks.OP7_SQL.replace("FROM documents", "FROM kept"))
    found = stages["line_dedup"].select("doc_id", "text")
    assert sorted_rows(["doc_id", "text"], found.collect()) == sorted_rows(["doc_id", "text"], [r[:2] for r in wanted.fetchall()])
    con = duckdb.connect()
    con.register("near", stages["near_dedup"].toArrow())
    wanted = con.sql(f"WITH {mixing.mixing_sql('near')} SELECT doc_id FROM (SELECT doc_id, unnest(range(copies)) FROM mixed)").fetchall()
    assert sorted(r[0] for r in stages["mixing"].select("doc_id").collect()) == sorted(r[0] for r in wanted)


def test_run_is_the_stages_in_turn(spark, stages):
    whole = __spark_entry__.queries()["pipeline"](spark, FOLDER)
    assert sorted_rows(whole.columns, whole.collect()) == sorted_rows(stages["sentencepiece"].columns, stages["sentencepiece"].collect())


def test_stages_take_odd_and_empty_tables(spark):
    for docs in (clashing(odd_documents(spark)), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, FOLDER).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() == docs.count()
