"""The chain of stability: signals of known make-up, numpy, and each rung."""

from __future__ import annotations

import math
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import series as S
from tidewell.operators import stability as T

N, STEP, LOW, HIGH = 240, 7.0, 21.0, 840.0


def signal_of(spark, **series):
    """series, ts, i, n, value of plain lists."""
    rows = [(s, i, len(y), float(v)) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "series string, i long, n long, value double").withColumn("ts", F.date_add(F.to_date(F.lit("2020-01-06")), (F.col("i") * 7).cast("int")))


def waves(*parts, n=N, noise=0.0, seed=1):
    t = np.arange(n)
    return sum(a * np.cos(2 * np.pi * k * t / n + f) for k, a, f in parts) + noise * np.random.default_rng(seed).standard_normal(n)


def test_bands_of_known_lines(spark):
    """Two lines of power 1/4 and 1/16 over a floor of 1e-4 in every bin."""
    bins = [("a", k, N, k / (N * STEP), {10: 0.25, 60: 0.0625}.get(k, 1e-4)) for k in range(1, 121)]
    spectrum = spark.createDataFrame(bins, "series string, k long, n long, freq double, power double")
    cycles = spark.createDataFrame([("a", 10 / (N * STEP)), ("a", 60 / (N * STEP)), ("a", 5.0)], "series string, freq double")
    found = {round(r["freq"] * N * STEP): r for r in T.band_snr(cycles, spectrum, ["series"], ["series"]).collect()}
    total = 0.25 + 0.0625 + 118e-4
    # Bins 9 to 11 and 57 to 63 are the bands; the last frequency has no bin.
    assert found[10]["band_ratio"] == pytest.approx((0.25 + 2e-4) / total) and found[10]["snr"] == pytest.approx((0.25 + 2e-4) / 3e-4)
    assert found[60]["band_ratio"] == pytest.approx((0.0625 + 6e-4) / total) and found[60]["snr"] == pytest.approx((0.0625 + 6e-4) / 7e-4)
    assert len(found) == 2 or found[round(5 * N * STEP)]["snr"] == 0


def test_one_bin_and_silence(spark):
    bins = [("one", 3, 9, 3 / 63, 2.0), *[("still", k, 64, k / 448, 0.0) for k in range(1, 33)]]
    spectrum = spark.createDataFrame(bins, "series string, k long, n long, freq double, power double")
    cycles = spark.createDataFrame([("one", 3 / 63), ("still", 5 / 448)], "series string, freq double")
    found = {r["series"]: (r["band_ratio"], r["snr"]) for r in T.band_snr(cycles, spectrum, ["series"], ["series"]).collect()}
    assert found == {"one": (1.0, 1.0), "still": (0.0, 0.0)}


def test_stable_cycles_come_first(spark):
    """A cycle that runs through is stable, one that stops halfway is not."""
    half = np.where(np.arange(N) < N // 3, waves((40, 1.5, 0.0)), 0)
    made = signal_of(spark, a=waves((12, 1.0, 0.4), noise=0.2) + half)
    rows = {round(N * STEP / r["period_days"]): r for r in T.evaluate(made, STEP, LOW, HIGH, [80, 120], 20).collect()}
    steady, passing = rows[12], rows[40]
    assert steady["stable"] and steady["presence_ratio"] == 1 and steady["place"] == 1 and steady["rank_norm"] == 1
    assert steady["amp_median"] == pytest.approx(1, abs=0.1) and steady["phase_locking_r"] > 0.3 and steady["fit_median"] > 0.5
    assert 0 < passing["presence_ratio"] < 0.7 and passing["amp_p25"] < 0.3 < passing["snr_global"]
    for r in rows.values():
        # 9 windows of 80 rows and 7 of 120
        assert len(r["window_ratios"]) == 16 and median(r["window_ratios"]) == pytest.approx(r["band_ratio_median"])
        assert r["stability_score"] == pytest.approx(r["presence_ratio"] * r["norm_power"]) and r["margin_median"] == pytest.approx(r["snr_median"] - 2)
    assert max(r["stability_norm"] for r in rows.values()) == 1


def test_windows_have_their_dates(spark):
    made = signal_of(spark, a=waves((12, 1.0, 0.4)))
    cycles = spark.createDataFrame([("a", 12 / (N * STEP), N * STEP / 12)], "series string, freq double, period_days double")
    found = T.window_measures(S.windowed_by_length(made, [100], 70), cycles, STEP, LOW, HIGH).orderBy("start").collect()
    days = [(r["start"], r["n"], (r["mid_date"] - r["start_date"]).days, (r["end_date"] - r["start_date"]).days) for r in found]
    assert days == [(s, 100, 350, 693) for s in (0, 70, 140)] and all(r["present"] and r["amplitude"] == pytest.approx(1) for r in found)
    assert [r["lag"] for r in found] == [pytest.approx(r["phase"] / (2 * math.pi) * r["period_days"]) for r in found]


@pytest.mark.parametrize("n", [240, 241, 3])
def test_surrogates_keep_the_magnitudes(spark, n):
    y = waves((5, 1.0, 0.3), (33, 0.4, 0.9), n=n, noise=0.5)[:n]
    made = signal_of(spark, a=y, b=y)
    runs = {}
    for r in T.surrogates(made, 3).orderBy("i").collect():
        runs.setdefault((r["series"], r["run"]), []).append(r["value"])
    assert len(runs) == 6 and all(len(z) == n for z in runs.values())
    if n == 3:
        assert all(z == list(y) for z in runs.values())
        return
    want = np.abs(np.fft.rfft(y))
    for z in runs.values():
        got = np.fft.rfft(z)
        assert np.abs(got[1:-1]) == pytest.approx(want[1:-1], rel=1e-9) and abs(got[0]) < 1e-9
        assert got[-1].real == pytest.approx(np.fft.rfft(y)[-1].real) and abs(got[-1].imag) < 1e-9
    assert runs["a", 1] != runs["b", 1] and runs["a", 1] != runs["a", 2]
    assert [r["value"] for r in T.surrogates(made, 3).where("series = 'b' AND run = 2").orderBy("i").collect()] == runs["b", 2]


def strongest(y):
    """The greatest SNR among the spaced peaks of a series, in plain numpy."""
    power, freqs = np.abs(np.fft.rfft(y)) ** 2 / len(y) ** 2, np.fft.rfftfreq(len(y), STEP)
    shown = [k for k in range(len(y) // 2, 0, -1) if LOW <= 1 / freqs[k] <= HIGH]
    peaks = [b for a, b, c in zip(shown, shown[1:], shown[2:], strict=False) if power[b] > power[a] and power[b] >= power[c]]
    kept = []
    for k in sorted(peaks or [max(shown, key=lambda k: power[k])], key=lambda k: -power[k]):
        if len(kept) < 48 and all(abs(1 / freqs[k] - 1 / freqs[j]) / max(1 / freqs[k], 1 / freqs[j]) >= 0.1 for j in kept):
            kept.append(k)
    return max(snr(power, freqs, freqs[k]) for k in kept), {k: snr(power, freqs, freqs[k]) for k in kept}


def snr(power, freqs, f):
    width = max(1.5 * freqs[1], 0.05 * f)
    inner = np.flatnonzero(abs(freqs - f) <= width * (1 + 1e-9))
    outer = np.flatnonzero((abs(freqs - f) <= max(2 * width, f / 4) * (1 + 1e-9)) & (abs(freqs - f) > max(1.2 * width, 0.08 * f) * (1 + 1e-9)))
    return power[inner].sum() / (np.median(power[outer]) * len(inner))


def test_p_values_equal_plain_numpy(spark):
    ys = {"a": waves((12, 0.4, 0.0), noise=1.0), "b": waves(noise=1.0, seed=5)}
    made = signal_of(spark, **ys)
    bins = T.spectra(made, ["series"], STEP)
    own = T.band_snr(T.candidates(T.in_periods(bins, ["series"], LOW, HIGH), ["series"]), bins, ["series"], ["series"]).withColumnRenamed("snr", "snr_global")
    maxima = T.band_maxima(T.surrogate_spectra(made, 30, STEP, seed=9), LOW, HIGH)
    got = {(r["series"], round(r["freq"] * N * STEP)): (r["snr_global"], r["p_value"]) for r in T.p_values(own, maxima).collect()}
    want = {}
    for s, y in ys.items():
        tops = [strongest(T.randomized(y, 9, s, run))[0] for run in range(1, 31)]
        for k, x in strongest(y)[1].items():
            want[s, k] = (pytest.approx(x), pytest.approx(sum(t * (1 + 1e-9) >= x for t in tops) / 30))
    assert got == want
    alone = T.p_values(own, maxima.where("run < 0")).select("p_value").distinct().collect()
    assert [r[0] for r in alone] == [1.0]


def test_p_values_are_ranks(spark):
    cycles = spark.createDataFrame([("a", k, x) for k, x in enumerate((9.0, 4.0, 3.9, 3.0, 0.5))] + [("b", 0, 1.0)], "series string, k int, snr_global double")
    maxima = spark.createDataFrame([("a", r, x) for r, x in enumerate((4.0, 3.0, 3.0, 2.0, 1.0))], "series string, run int, snr double")
    got = {(r["series"], r["k"]): r["p_value"] for r in T.p_values(cycles, maxima).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 0.2, ("a", 2): 0.2, ("a", 3): 0.6, ("a", 4): 1.0, ("b", 0): 1.0}


CYCLES = "series string, period_days double, stable boolean, presence_ratio double, phase_locking_r double, amp_median double, p_value double, norm_power double, rank_norm double, snr_median double"


def chosen(spark, rows, **limits):
    found = T.select_cycles(spark.createDataFrame(rows, CYCLES), T.Choice(**{"percentile": 0.0} | limits))
    return [tuple(r) for r in found.select("series", "chosen", "rung", "period_days").orderBy("series", "chosen").collect()]


def cycle(series, period, stable=True, presence=0.9, locking=0.5, amplitude=0.5, p=0.01, power=0.1, rank=0.5, snr=3.0):
    return (series, float(period), stable, presence, locking, amplitude, p, power, rank, snr)


def test_each_rung(spark):
    rows = [cycle("strict", 10, rank=0.2), cycle("strict", 20, presence=0.4, rank=1.0)]
    rows += [cycle(f"no {k}", 10, **{k: x}) for k, x in (("locking", 0.01), ("amplitude", 0.01), ("p", 0.5))] + [cycle("no p", 40, presence=0.4)]
    rows += [cycle("stable only", 10, presence=0.4), cycle("stable only", 20, stable=False), cycle("none", 10, stable=False), cycle("null p", 10, p=None)]
    assert chosen(spark, rows, p_value=0.05) == [
        ("no amplitude", 1, 2, 10.0), ("no locking", 1, 2, 10.0), ("no p", 1, 2, 10.0), ("null p", 1, 2, 10.0), ("stable only", 1, 3, 10.0), ("strict", 1, 1, 10.0)
    ]


def test_percentile_rank_and_distance(spark):
    rows = [cycle("a", p, power=w, rank=r) for p, w, r in ((10, 0.1, 1.0), (20, 0.2, 0.9), (22, 0.3, 0.8), (40, 0.4, 0.7), (80, 0.5, 0.6))]
    # The linear 30th percentile is 0.22: periods 10 and 20 go.
    assert chosen(spark, rows, percentile=0.3) == [("a", 1, 1, 22.0), ("a", 2, 1, 40.0), ("a", 3, 1, 80.0)]
    assert chosen(spark, rows) == [("a", 1, 1, 10.0), ("a", 2, 1, 20.0), ("a", 3, 1, 40.0)]
    ties = [cycle("t", p, rank=0.5, presence=a, locking=b, snr=float(c)) for p, a, b, c in ((10, 0.8, 0.5, 1), (20, 0.9, 0.4, 1), (40, 0.9, 0.5, 1), (80, 0.9, 0.5, 2))]
    assert [p for *_, p in chosen(spark, ties, most=4)] == [80.0, 40.0, 20.0, 10.0]
