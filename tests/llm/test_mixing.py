import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL, assert_same
from tests.llm.helpers import assert_clashes_kept, clashing, empty, odd_documents
from tidewell.llm import mixing


def test_query_equals_sql(spark):
    assert assert_same(mixing.op5_mixing(spark, SMALL), mixing.OP5_SQL) > 0


def test_margins_meet_their_targets(spark):
    rows = [(s, l, t, 10 + 7 * i) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")]
    cells = spark.createDataFrame(rows, "tw_source string, tw_lang string, tw_topic string, tokens long")
    shares = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 2.0)], "tw_source string, share double")
    raked = mixing.rake(cells, targets={"tw_source": shares})
    assert raked.select("residual").distinct().first()[0] <= 1e-12
    total = sum(r[3] for r in rows)
    found = {r["tw_source"]: r["w"] for r in raked.groupBy("tw_source").agg(F.sum("raked").alias("w")).collect()}
    assert found == pytest.approx({"a": total * 0.5, "b": total * 0.3, "c": total * 0.2}, rel=1e-6)
    langs = {r["tw_lang"]: r["tokens"] ** mixing.TEMPER for r in cells.groupBy("tw_lang").agg(F.sum("tokens").alias("tokens")).collect()}
    found = {r["tw_lang"]: r["w"] for r in raked.groupBy("tw_lang").agg(F.sum("raked").alias("w")).collect()}
    assert found == pytest.approx({k: v / sum(langs.values()) * total for k, v in langs.items()}, rel=1e-6)


def test_targets_that_no_cell_holds_or_that_contradict(spark):
    cells = spark.createDataFrame([("a", "x", "p", 60), ("b", "y", "p", 40), ("c", "y", None, 0)], "tw_source string, tw_lang string, tw_topic string, tokens long")
    shares = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("gone", 8.0)], "tw_source string, share double")
    found = {r["tw_source"]: (r["raked"], r["residual"]) for r in mixing.rake(cells, targets={"tw_source": shares, "tw_lang": shares.selectExpr("translate(tw_source, 'ab', 'xy') AS tw_lang", "share")}).collect()}
    assert found == {"a": (pytest.approx(50), pytest.approx(0, abs=1e-9)), "b": (pytest.approx(50), pytest.approx(0, abs=1e-9)), "c": (0, pytest.approx(0, abs=1e-9))}
    other = spark.createDataFrame([("x", 9.0), ("y", 1.0)], "tw_lang string, share double")
    rows = mixing.rake(cells, targets={"tw_source": shares, "tw_lang": other}).collect()  # a goes with x: both targets can't hold
    assert rows[0]["residual"] > 0.1 and sum(r["raked"] for r in rows) == pytest.approx(100)
    assert mixing.rake(cells.limit(0)).count() == 0


def test_stage_output_has_the_target_shares(spark):
    """Plain token shares of the rows that the pipeline's stage returns."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    mixed = mixing.mix(docs)
    kept = mixing.sample_mixed(docs).select("source", "lang", mixing.text_topic(F.col("text")).alias("tw_topic"), mixing.token_weight(F.col("text")).alias("t"))
    for dim in ("lang", "tw_topic"):
        wanted = {r[0]: r[1] for r in mixed.groupBy(dim).agg(F.sum(F.col("tw_ratio") * F.col("tw_tokens"))).collect()}
        found = {r[0]: r[1] for r in kept.groupBy(dim).agg(F.sum("t")).collect()}
        a, b = sum(wanted.values()), sum(found.values())
        assert all(abs(found.get(k, 0) / b - w / a) < 0.02 for k, w in wanted.items())


def test_weighted_sample_follows_the_raked_weights(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = mixing.mix(docs).cache()
    kept = mixed.where("tw_selected").groupBy("source").agg(F.sum(F.col("tw_weight") * F.col("tw_tokens")).alias("w"))
    wanted = mixed.groupBy("source").agg(F.sum(F.col("tw_ratio") * F.col("tw_tokens")).alias("w"))
    a, b = ({r["source"]: r["w"] for r in x.collect()} for x in (kept, wanted))
    assert sum(a.values()) == pytest.approx(sum(b.values()), rel=0.1)
    assert mixed.where("tw_probability >= 1 AND NOT tw_selected").count() == 0


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    assert mixing.mix(odd_documents(spark)).count() == 11
    assert_clashes_kept(mixing.sample_mixed(docs), docs.columns)
    plain = {tuple(r) for r in mixing.sample_mixed(odd_documents(spark)).select("doc_id", "lang").collect()}
    assert plain == {tuple(r) for r in mixing.sample_mixed(docs).select("doc_id", "lang").collect()}
    assert mixing.sample_mixed(empty(spark)).count() == 0
