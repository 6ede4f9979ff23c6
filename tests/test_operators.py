"""Operators that SQL cannot check, on fixtures and against numpy."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tidewell.operators import corpus as C
from tidewell.operators import monitor as M
from tidewell.operators import retrieval as R
from tidewell.operators import search as X
from tidewell.operators import series as S
from tidewell.plans import cycles
from tidewell.plans import cycles


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(7)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(200)]
    y = np.sin(2 * np.pi * np.arange(200) / 20 + 0.4) + 0.1 * rng.normal(size=200)
    return spark.createDataFrame([("a", d, float(v)) for d, v in zip(days, y, strict=True)], "series string, ts date, value double")


def test_periodogram_equals_the_direct_sums(signal):
    made = S.build_signal(signal, "levels")
    a = {r["k"]: r["power"] for r in S.dft(made).collect()}
    b = {r["k"]: r["power"] for r in S.periodogram(made).collect()}
    assert a == pytest.approx(b, abs=1e-12) and max(a, key=a.get) == 10


def test_harmonic_fit_finds_amplitude_and_phase(spark, signal):
    flat = S.build_signal(signal, "levels", taper=False)
    fit = S.harmonic_fit(S.windowed(flat, [(0, 200)]), spark.createDataFrame([("a", 20.0)], "series string, period_days double")).first()
    sd = math.sqrt(0.5 + 0.01)
    assert fit["amplitude"] == pytest.approx(1 / sd, rel=0.05) and fit["r2"] > 0.95
    assert math.cos(fit["phase"] - (0.4 - math.pi / 2)) > 0.99
    short = S.harmonic_fit(S.windowed(flat, [(0, 5)]), spark.createDataFrame([("a", 20.0)], "series string, period_days double")).first()
    assert (short["amplitude"], short["phase"], short["r2"]) == (0.0, 0.0, 0.0)


def test_known_cycles_are_recovered(spark):
    for seed in (7, 21, 42, 77, 123):
        periods = [45.0, 90.0, 140.0, 220.0, 365.0]
        made = S.synthetic(spark, 1460, periods, [1.0, 0.9, 0.8, 0.9, 1.0], [0.3, 1.1, 2.0, 0.7, 1.6], seed=seed)
        best = S.spaced_top(S.local_peaks(S.periodogram(made, 1.0, 30.0, 500.0)), [F.desc("power"), F.asc("k")], 8)
        assert S.recovered(best, spark.createDataFrame([(p,) for p in periods], "period_days double")).where("hit").count() == 5


def test_spaced_choice_keeps_its_distance(spark):
    made = spark.createDataFrame([("a", p, s) for p, s in ((100.0, 9.0), (105.0, 8.0), (50.0, 7.0), (112.0, 6.0), (20.0, 5.0))], "series string, period_days double, score double")
    found = S.spaced_top(made, [F.desc("score")], 3)
    assert sorted(r["period_days"] for r in found.collect()) == [50.0, 100.0, 112.0]


def test_scalogram_peaks_at_the_period(signal):
    found = S.scalogram(S.build_signal(signal, "levels", taper=False), 5.0, 60.0, 16)
    assert found.count() == 16 * 200


def test_window_plan():
    assert S.window_plan(100, [64], 30) == [(0, 64), (30, 64), (36, 64)]
    assert S.window_plan(20, [64], 30) == [(0, 20)] and S.window_plan(100, [16], 5) == [(0, 100)]


def test_returns_fall_back_to_percent(spark):
    made = spark.createDataFrame([("a", dt.date(2020, 1, k + 1), v) for k, v in enumerate([1.0, 2.0, 0.0, 3.0])], "series string, ts date, value double")
    assert [r["value"] for r in S.returns(made).orderBy("ts").collect()] == [1.0, -1.0]  # division by zero is dropped


def test_chunks():
    text = "intro\n# A\n" + "\n".join(["x" * 399] * 9) + "\n## B\ntail\n### C\n# D\nlast"
    found = X.chunks_of(text, 400, 800, 60)
    assert [p for p, _ in found] == ["", "A", "A", "A", "A > B", "D"]
    assert found[0] == ("", "intro\n") and found[-1] == ("D", "last\n")
    assert [t.count("x" * 399) for p, t in found if p == "A"] == [4, 4, 3]  # each begins with the last line before
    assert X.chunks_of("", 400) == [] and X.chunks_of("\n \n# only\n", 400) == []
    long = X.chunks_of("y" * 4000, 400, 800, 60)
    assert [t for _, t in long] == ["y" * 4000 + "\n"] * 2  # the rest holds the overlap alone


def test_merge_and_versions(spark):
    now = spark.createDataFrame([(1, "a", "t"), (2, "b", "t")], "id long, h string, title string")
    new = spark.createDataFrame([(2, "c", None), (3, "d", "n")], "id long, h string, title string")
    assert rows(X.upsert(now, new, "id", ["h", "title"]), "id") == [(1, "a", "t", "unchanged"), (2, "c", "t", "updated"), (3, "d", "n", "created")]
    kept = X.without_children(spark.createDataFrame([(1, 1), (2, 2)], "id long, chunk long"), spark.createDataFrame([(2,)], "id long"), "id")
    assert rows(kept, "id") == [(1, 1)]


def test_fusion_counts_an_id_once_a_list(spark):
    lists = spark.createDataFrame([("a", "q", 1, 1), ("a", "q", 1, 4), ("b", "q", 1, 2), ("b", "q", 2, 1)], "list string, query string, id long, rank int")
    assert {r["id"]: r["score"] for r in X.fuse(lists).collect()} == pytest.approx({1: 1 / 61 + 1 / 62, 2: 1 / 61})


def test_retrieval_quality(spark):
    found = spark.createDataFrame([("q1", 1, 1), ("q1", 2, 2), ("q1", 3, 3), ("q2", 9, 1)], "query string, id long, rank int")
    qrels = spark.createDataFrame([("q1", 2), ("q1", 3), ("q2", 5)], "query string, id long")
    row = R.quality(found, qrels).first()
    ndcg = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert (row["hit_rate_1"], row["hit_rate_5"], row["mrr_10"]) == (0.0, 0.5, 0.25) and row["ndcg_10"] == pytest.approx(ndcg / 2)
    assert tuple(R.quality(found, qrels.limit(0)).first()) == (0.0,) * 6


def test_reducers(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8)) @ np.diag([5, 3, 1, 1, 1, 1, 1, 1]) + 2
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    made = np.array([r["v"] for r in R.pca(df, 3, whiten=True)(df).orderBy("id").collect()])
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    wanted = u[:, :3] * math.sqrt(59)
    assert np.allclose(np.abs(made), np.abs(wanted), atol=1e-8)
    made = np.array([r["v"] for r in df.orderBy("id").select(R.random_projection(F.col("v"), 8, 4, 5).alias("v")).collect()])
    assert np.allclose(made, x @ np.random.default_rng(5).standard_normal((8, 4)))
    with pytest.raises(Exception, match="fewer than 9"):
        df.select(R.prefix(F.col("v"), 9)).collect()


def test_benchmark_faults(spark):
    q, c = spark.createDataFrame([("a",), ("b",)], "query string"), spark.createDataFrame([(1,)], "id long")
    rel = spark.createDataFrame([("a", 1), ("a", 2)], "query string, id long")
    assert rows(R.missing_queries(q, rel, c), "key") == [("2", "unknown_id"), ("b", "no_qrels")]
    assert rows(R.restrict(rel, c), "id") == [(1, "a")]


def test_start_and_end_pairs(spark):
    log = spark.createDataFrame([(1, 1.0, "start"), (1, 5.0, "start"), (1, 6.0, "end"), (1, 4.0, "end"), (1, 7.0, "start"), (2, 3.0, "end"), (2, 3.0, "start")], "log long, ts double, kind string")
    assert rows(M.pair_starts(log), "log", "start") == [(1, 1.0, 4.0), (1, 5.0, 6.0), (1, 7.0, None), (2, 3.0, 3.0)]


def test_pairs_equal_plain_matching(spark):
    """Many logs with ties, ends without a start and starts without an end."""
    rng = np.random.default_rng(6)
    lines = [(int(log), float(rng.integers(0, 25)), str(rng.choice(["start", "end", "end"]))) for log in range(40) for _ in range(rng.integers(0, 20))]
    wanted = []
    for log in range(40):
        starts, ends = (sorted(t for g, t, k in lines if g == log and k == kind) for kind in ("start", "end"))
        for s in starts:
            end = next((e for e in ends if e >= s), None)
            if end is not None:
                ends = ends[ends.index(end) + 1 :]
            wanted.append((log, s, end))
    found = [tuple(r) for r in M.pair_starts(spark.createDataFrame([*lines, (1, 3.0, None)], "log long, ts double, kind string")).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr)


def test_waves_go_on_beyond_the_end(spark, signal):
    made = S.build_signal(signal, "levels", taper=False)
    bins = S.periodogram(made)
    ahead = S.extended(made, 1.0, 30.5).withColumnRenamed("i", "j").withColumnRenamed("j", "i")
    n = made.count()
    found = S.reconstruct(bins.select("series", "k", "n", "re", "im").where(F.col("k") * 2 < F.col("n")), ahead).orderBy("i").collect()
    assert len(found) == n + 31 and sum(r["projection"] for r in found) == 31
    assert (found[-1]["ts"] - found[n - 1]["ts"]).days == 31 and found[n]["value"] == pytest.approx(found[0]["value"])
    assert S.extended(made, 1.0, 0).count() == n


def test_dates_come_from_the_last_row_of_the_index(spark):
    index = spark.createDataFrame([("v", "2024-01-01", 1), ("v", None, 2), ("w", None, 1), ("w", "2024-02-02", 5)], "video string, published string, seq int")
    found = C.with_dates(spark.createDataFrame([("v",), ("w",), ("x",)], "video string"), index)
    assert rows(found, "video") == [("v", None), ("w", "2024-02-02"), ("x", None)]


def test_breaches_skip_missing_readings(spark):
    made = spark.createDataFrame([(1, k, k, v) for k, v in enumerate([9.0, 9.0, None, 9.0, 9.0, 1.0, 9.0])], "host long, ts long, seq long, value double")
    found = rows(M.breach_runs(made, "value", 5.0, 3).select("ts", "consecutive", "fired"), "ts")
    assert found == [(0, 1, False), (1, 2, False), (3, 3, True), (4, 1, False), (5, 0, False), (6, 1, False)]


def test_mention_fixtures(spark):
    made = spark.createDataFrame([("a", "v1", "AAPL", None), ("a", "v1", "AAPL", None), ("b", "v2", "MSFT", "Tesla (MSFT)"), ("b", "v3", None, None), ("b", "v4", "", "x")], "channel string, video string, symbol string, label string")
    assert rows(C.mentions_by_symbol(made, unresolved=True), "symbol") == [("AAPL", 2, 1, 1), ("MSFT", 1, 1, 1), (C.UNRESOLVED, 2, 2, 1)]
    assert rows(C.mentions_global(made.limit(0)), "mention_count") == [(0, 0, 0)]
    assert rows(C.skip_merge(made.where("video = 'v1'").limit(1), made, ["video"]).select("video"), "video") == [("v1",), ("v2",), ("v3",), ("v4",)]


def test_candidates_over_the_tables(spark):
    found = cycles.cycle_measures(spark, "/root/testdata/sf0.001").collect()
    assert found and all(0 <= r["presence_ratio"] <= 1 and 0 <= r["phase_locking_r"] <= 1 + 1e-9 for r in found)


def test_windows_follow_each_series_length(spark):
    rows = [(s, i, n, float(i)) for s, n in (("a", 342), ("b", 130), ("c", 20)) for i in range(n)]
    signal = spark.createDataFrame(rows, "series string, i long, n long, value double")
    found = S.windowed_by_length(signal, [104, 156], 52).groupBy("series", "window", "n").agg(F.min("value").alias("s"), F.count("i").alias("rows")).collect()
    assert all(r["rows"] == r["n"] for r in found)
    for s, n in (("a", 342), ("b", 130), ("c", 20)):
        assert [(int(r["s"]), r["n"]) for r in sorted(found, key=lambda r: r["window"]) if r["series"] == s] == S.window_plan(n, [104, 156], 52)


def test_stability_sees_the_end_of_the_series(spark):
    n = cycles.S.build_signal(cycles.weekly(spark, SMALL)).agg(F.max("n")).first()[0]
    assert n > 300
    found = {r["n"] for r in cycles.cycle_stability(spark, SMALL).groupBy("series", "period_days").agg(F.count("start").alias("n")).collect()}
    assert found == {len(S.window_plan(n, [104, 156], 52))}
