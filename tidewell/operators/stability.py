"""Candidate cycles of series, their stability over windows, their chance
level, and the choice among them.

Every step is a relation keyed by ``keys``: a whole series is keyed by
``series``, its windows by ``series, window``, its surrogates by ``series,
run``. Spectra are rows of bins, bands are range joins on bin numbers, so
series, windows and runs are all spread over tasks alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators import series as S

EDGE = 1 + 1e-9  # a bin on the edge of a band lies inside, whatever its rounding


class Limits(NamedTuple):
    """Widths are shares of the cycle's frequency."""

    peak: float = 0.05
    background: float = 0.25
    apart: float = 0.08
    snr: float = 2.0
    ratio: float = 0.03
    presence: float = 0.30


class Choice(NamedTuple):
    """Limits of the selection; ``percentile`` is of the power shares."""

    presence: float = 0.5
    locking: float = 0.04
    amplitude: float = 0.06
    p_value: float = 1.0
    percentile: float = 0.75
    distance: float = 0.2
    most: int = 3


def spectra(signal: DataFrame, keys: list[str], step_days: float) -> DataFrame:
    """``keys, k, n, freq, power`` of each group by FFT, from k = 0."""
    kinds = ", ".join(f"`{c}` {signal.schema[c].dataType.simpleString()}" for c in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        bins = _bins(part.sort_values("i")["value"].to_numpy(), step_days)
        return pd.concat([pd.DataFrame({c: part[c].iloc[0] for c in keys}, index=bins.index), bins], axis=1)

    return signal.select(*keys, "i", "value").groupBy(*keys).applyInPandas(run, f"{kinds}, k long, n long, freq double, power double")


def _bins(y: np.ndarray, step_days: float) -> pd.DataFrame:
    size = np.abs(np.fft.rfft(y))
    return pd.DataFrame({"k": np.arange(len(size)), "n": len(y), "freq": np.fft.rfftfreq(len(y), step_days), "power": (size / len(y)) ** 2})


def in_periods(spectrum: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Bins whose period lies between ``low`` and ``high`` days, with
    ``period_days`` and the share of the group's power among them."""
    rows = spectrum.where("k > 0").withColumn("period_days", 1 / F.col("freq")).where(F.col("period_days").between(low, high))
    total = F.sum("power").over(Window.partitionBy(*keys))
    return rows.withColumn("norm_power", F.when(total > 0, F.col("power") / total).otherwise(0.0))


def candidates(band: DataFrame, keys: list[str], most: int = 48, distance: float = 0.1) -> DataFrame:
    """The strongest local peaks of each group, by ascending period, that keep
    ``distance`` from stronger ones."""
    peaks = S.local_peaks(band, keys, F.asc("period_days"))
    return S.spaced_top(peaks, [F.desc("power"), F.asc("period_days")], most, distance, keys).drop("place")


def band_snr(cycles: DataFrame, spectrum: DataFrame, keys: list[str], on: list[str], limits: Limits = Limits()) -> DataFrame:
    """``keys, freq, band_ratio, snr`` of each cycle (``on, freq``) in each
    spectrum with the same ``on``.

    The band holds the bins within the greater of 1.5 bins and ``peak`` of the
    frequency; its share of all power is the ratio. The SNR compares it with as
    many bins of the median of the surroundings: beyond the greater of 1.2
    bands and ``apart``, within the greater of two bands and ``background``; or
    of the whole spectrum where no bin lies there. Without a bin in the band
    both are 0. Bins are found by their numbers, not by comparing all.
    """
    groups = spectrum.groupBy(*keys).agg(
        F.count("*").alias("bins"), F.max("n").alias("n"), F.sum("power").alias("total"), F.median("power").alias("middle"), F.min("freq").alias("f_low"), F.max("freq").alias("f_high"), F.min("k").alias("k_low"), F.max("k").alias("k_high")
    )
    f = F.col("f0")
    each = groups.join(cycles.select(*on, F.col("freq").alias("f0")), on)
    step = F.when(F.col("bins") > 1, (F.col("f_high") - F.col("f_low")) / (F.col("bins") - 1)).otherwise(F.greatest(f / 20, F.lit(1e-6)))
    near = F.greatest(F.greatest(step, F.lit(1e-12)) * 1.5, f * limits.peak)
    each = each.withColumn("near", near).withColumns({"far": F.greatest(F.col("near") * 2, f * limits.background), "gap": F.greatest(F.col("near") * 1.2, f * limits.apart)})
    # With one bin the numbers don't tell the distance: it is looked at in any case.
    width = F.when(F.col("bins") > 1, (F.col("f_high") - F.col("f_low")) / (F.col("k_high") - F.col("k_low")))
    place = lambda edge: F.col("k_low") + (edge - F.col("f_low")) / width
    first = F.coalesce(F.greatest(F.floor(place(f - F.col("far"))) - 1, F.col("k_low")), F.col("k_low"))
    last = F.coalesce(F.least(F.ceil(place(f + F.col("far"))) + 1, F.col("k_high")), F.col("k_high"))
    looked = each.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array(F.col("k_low")))))
    looked = looked.join(spectrum.select(*keys, "k", "freq", "power"), [*keys, "k"])
    away = F.abs(F.col("freq") - f)
    inside, around = away <= F.col("near") * EDGE, (away <= F.col("far") * EDGE) & (away > F.col("gap") * EDGE)
    sums = looked.groupBy(*keys, "f0").agg(
        F.sum(F.when(inside, F.col("power"))).alias("band"), F.count(F.when(inside, 1)).alias("held"), F.median(F.when(around, F.col("power"))).alias("level"), F.first("total").alias("total"), F.first("middle").alias("middle")
    )
    some = (F.col("held") > 0) & (F.col("total") > 0)
    noise = F.greatest(F.coalesce("level", "middle") * F.col("held"), F.lit(1e-18))
    return sums.select(*keys, f.alias("freq"), F.when(some, F.col("band") / F.col("total")).otherwise(0.0).alias("band_ratio"), F.when(some, F.col("band") / noise).otherwise(0.0).alias("snr"))


def nearest_bins(cycles: DataFrame, spectrum: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """``keys, f0, k, freq``: the bin of each spectrum that is nearest to each
    cycle's frequency (``on, freq``), the first of equals. Bins of a spectrum
    are evenly spaced, so only those around the frequency are looked at."""
    groups = spectrum.groupBy(*keys).agg(F.min("freq").alias("f_low"), F.max("freq").alias("f_high"), F.min("k").alias("k_low"), F.max("k").alias("k_high"))
    each = groups.join(cycles.select(*on, F.col("freq").alias("f0")), on)
    width = F.when(F.col("k_high") > F.col("k_low"), (F.col("f_high") - F.col("f_low")) / (F.col("k_high") - F.col("k_low"))).otherwise(1.0)
    at = F.least(F.greatest(F.floor(F.col("k_low") + (F.col("f0") - F.col("f_low")) / width), F.col("k_low")), F.col("k_high"))
    around = F.sequence(F.greatest(at - 1, F.col("k_low")), F.least(at + 2, F.col("k_high")))
    looked = each.select(*keys, "f0", F.explode(around).alias("k")).join(spectrum.select(*keys, "k", "freq"), [*keys, "k"])
    away = F.struct(F.round(F.abs(F.col("freq") - F.col("f0")), 15), F.col("k"))
    best = looked.groupBy(*keys, "f0").agg(F.min_by(F.struct("k", "freq"), away).alias("best"))
    return best.select(*keys, "f0", "best.k", "best.freq")


def window_measures(windows: DataFrame, cycles: DataFrame, step_days: float, low: float, high: float, limits: Limits = Limits()) -> DataFrame:
    """Each cycle (``series, freq, period_days``) in each window (see
    ``series.windowed_by_length``): the window's ``start``, ``n`` and dates,
    band ratio and SNR from its own spectrum between the periods ``low`` and
    ``high``, amplitude, phase, lag and fit of the harmonic regression, and
    whether the cycle is ``present``: both limits reached."""
    keys = ["series", "window"]
    bands = band_snr(cycles, in_periods(spectra(windows, keys, step_days), keys, low, high), keys, ["series"], limits)
    fits = S.harmonic_fit(windows.select(*keys, "i", "n", "value"), cycles.select("series", "period_days"), step_days)
    spans = windows.groupBy(*keys).agg(
        F.min("start").alias("start"), F.max("n").alias("n"), F.min("ts").alias("start_date"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("ts"))).alias("mid_date"), F.max("ts").alias("end_date")
    )
    rows = fits.join(cycles.select("series", "period_days", "freq"), ["series", "period_days"]).join(bands, [*keys, "freq"], "left").join(spans, keys)
    rows = rows.withColumns({"band_ratio": F.coalesce("band_ratio", F.lit(0.0)), "snr": F.coalesce("snr", F.lit(0.0)), "lag": F.col("phase") / (2 * np.pi) * F.col("period_days")})
    return rows.withColumn("present", (F.col("snr") >= limits.snr) & (F.col("band_ratio") >= limits.ratio))


def stability(measures: DataFrame, cycles: DataFrame, whole: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every measure of a cycle over its windows, one row a cycle.

    ``cycles`` adds power and share of power, ``whole`` (``series, freq, snr``)
    the SNR in the spectrum of the whole series. ``window_ratios`` are the band
    ratios in the order of the windows' starts, then lengths.
    """
    at = lambda c, q: F.percentile(c, F.lit(q))
    locking = F.sqrt(F.pow(F.avg(F.cos("phase")), 2) + F.pow(F.avg(F.sin("phase")), 2))
    held = F.array_sort(F.collect_list(F.struct("start", "n", "band_ratio")))
    rows = measures.groupBy("series", "freq").agg(
        F.avg(F.col("present").cast("double")).alias("presence_ratio"), at("band_ratio", 0.5).alias("band_ratio_median"), F.transform(held, lambda x: x["band_ratio"]).alias("window_ratios"),
        at("amplitude", 0.5).alias("amp_median"), at("amplitude", 0.25).alias("amp_p25"), F.min("amplitude").alias("amp_min"), at("r2", 0.5).alias("fit_median"),
        at("snr", 0.5).alias("snr_median"), at("snr", 0.25).alias("snr_p25"), at("lag", 0.5).alias("lag_median"), (at("lag", 0.75) - at("lag", 0.25)).alias("lag_iqr"), locking.alias("phase_locking_r"),
    )
    rows = cycles.select("series", "freq", "period_days", "power", "norm_power").join(rows, ["series", "freq"])
    rows = rows.join(whole.select("series", "freq", F.col("snr").alias("snr_global")), ["series", "freq"])
    return rows.withColumns({"margin_median": F.col("snr_median") - limits.snr, "stability_score": F.col("presence_ratio") * F.col("norm_power"), "stable": F.col("presence_ratio") >= limits.presence})


def ranked(cycles: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``rank_score, rank_norm, stability_norm`` and ``place`` in the series:
    stable cycles first, then by score, presence and SNR."""
    weights = weights or {"amp_median": 1.0, "snr_median": 1.0, "presence_ratio": 1.0, "phase_locking_r": 1.0}
    rows = S.max_norm(S.rank_score(cycles, weights), "stability_score", "stability_norm")
    order = [F.desc("stable"), F.desc("rank_norm"), F.desc("presence_ratio"), F.desc("snr_median"), F.asc("period_days")]
    return rows.withColumn("place", F.row_number().over(S.by_series().orderBy(*order)))


def evaluate(signal: DataFrame, step_days: float, low: float, high: float, lengths: list[int], step: int, limits: Limits = Limits(), most: int = 48) -> DataFrame:
    """All measures and ranks of the candidate cycles of each series."""
    bins = spectra(signal, ["series"], step_days)
    cycles = candidates(in_periods(bins, ["series"], low, high), ["series"], most)
    measures = window_measures(S.windowed_by_length(signal, lengths, step), cycles, step_days, low, high, limits)
    return ranked(stability(measures, cycles, band_snr(cycles, bins, ["series"], ["series"], limits), limits))


def randomized(y: np.ndarray, seed: int, series: str, run: int) -> np.ndarray:
    """A copy with random phases: the edge bins keep theirs (the last one only
    its real part), the mean goes. The generator is that of the series and run
    alone, so any task makes the same copy. Up to three values stay as they are."""
    c = np.fft.rfft(y)
    if len(c) <= 2:
        return y.copy()
    own = np.random.default_rng(np.random.SeedSequence(seed, spawn_key=(zlib.crc32(series.encode()), run)))
    turned = np.abs(c[1:-1]) * np.exp(2j * np.pi * own.random(len(c) - 2))
    z = np.fft.irfft(np.concatenate([c[:1], turned, c[-1:].real]), len(y))
    return z - z.mean()


def _runs(signal: DataFrame, runs: int) -> DataFrame:
    """``series, run, y``: each series' values in order, once a run."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda x: x["value"])
    return signal.groupBy("series").agg(values.alias("y")).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(runs)))).select("series", "run", "y").repartition("series", "run")


def surrogates(signal: DataFrame, runs: int, seed: int = 42) -> DataFrame:
    """``series, run, i, n, value``: phase-randomized copies, runs from 1."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s, r, y in part.itertuples(index=False):
                z = randomized(np.asarray(y, float), seed, s, r)
                yield pd.DataFrame({"series": s, "run": r, "i": np.arange(len(z)), "n": len(z), "value": z})

    return _runs(signal, runs).mapInPandas(make, "series string, run int, i long, n long, value double")


def surrogate_spectra(signal: DataFrame, runs: int, step_days: float, seed: int = 42) -> DataFrame:
    """``spectra`` of the surrogates, made where they are: ``series, run, k,
    n, freq, power``."""

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s, r, y in part.itertuples(index=False):
                bins = _bins(randomized(np.asarray(y, float), seed, s, r), step_days)
                yield pd.concat([pd.DataFrame({"series": s, "run": r}, index=bins.index), bins], axis=1)

    return _runs(signal, runs).mapInPandas(make, "series string, run int, k long, n long, freq double, power double")


def band_maxima(spectrum: DataFrame, low: float, high: float, limits: Limits = Limits(), most: int = 48) -> DataFrame:
    """``series, run, snr``: of each run the greatest SNR of its own
    candidates, 0 for runs without a bin between the periods."""
    keys = ["series", "run"]
    found = band_snr(candidates(in_periods(spectrum, keys, low, high), keys, most), spectrum, keys, keys, limits)
    best = found.groupBy(*keys).agg(F.max("snr").alias("snr"))
    return spectrum.select(*keys).distinct().join(best, keys, "left").select(*keys, F.greatest(F.coalesce("snr", F.lit(0.0)), F.lit(0.0)).alias("snr"))


def p_values(cycles: DataFrame, maxima: DataFrame, score: str = "snr_global") -> DataFrame:
    """``cycles`` with ``p_value``: the share of the series' runs whose
    greatest SNR reaches the cycle's, 1 without runs. Surrogates have the
    magnitudes of their series, so ties are common; what is equal up to
    rounding counts as reached. Cycles and runs are ranked together, so no
    cycle is compared with every run."""
    packed = cycles.select("series", F.col(score).alias("x"), F.struct("*").alias("row"))
    none = F.lit(None).cast(packed.schema["row"].dataType)
    both = packed.withColumn("of", F.lit(0)).unionByName(maxima.select("series", (F.col("snr") * EDGE).alias("x"), none.alias("row"), F.lit(1).alias("of")))
    by = Window.partitionBy("series")
    reached = F.sum("of").over(by.orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    all_ = F.sum("of").over(by)
    rows = both.withColumn("p_value", F.when(all_ > 0, reached / all_).otherwise(1.0)).where("of = 0")
    return rows.select("row.*", "p_value")


def select_cycles(cycles: DataFrame, choice: Choice = Choice()) -> DataFrame:
    """The chosen cycles of each series, with ``rung`` and ``chosen`` (1, 2 ..).

    A series takes the first rung that any of its cycles reaches: 1 stable and
    within every limit (presence, phase locking, amplitude, p-value), 2 stable
    and present, 3 stable; no stable cycle, no choice. Of these, cycles below
    the percentile of power shares go, unless all would. The rest are taken by
    score, presence, locking and SNR, each at ``distance`` from those before.
    A missing ``p_value`` counts as 1.
    """
    p: Column = F.coalesce("p_value", F.lit(1.0)) if "p_value" in cycles.columns else F.lit(1.0)
    present = F.col("presence_ratio") >= choice.presence
    strict = present & (F.col("phase_locking_r") >= choice.locking) & (F.col("amp_median") >= choice.amplitude) & (p <= choice.p_value)
    rows = cycles.where("stable").drop("place").withColumn("rung", F.when(strict, 1).when(present, 2).otherwise(3))
    first = rows.groupBy("series").agg(F.min("rung").alias("rung"))
    eligible = rows.join(first, ["series", "rung"])
    least = eligible.groupBy("series").agg(F.percentile("norm_power", F.lit(choice.percentile)).alias("least"), F.max("norm_power").alias("greatest"))
    kept = eligible.join(least, "series").where((F.col("norm_power") >= F.col("least")) | (F.col("greatest") < F.col("least"))).drop("least", "greatest")
    order = [F.desc("rank_norm"), F.desc("presence_ratio"), F.desc("phase_locking_r"), F.desc("snr_median"), F.asc("period_days")]
    taken = S.spaced_top(kept, order, choice.most, choice.distance)
    return taken.withColumn("chosen", F.row_number().over(S.by_series().orderBy("place"))).drop("place")
