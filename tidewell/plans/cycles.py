"""Cycle analytics over daily order totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators import series as S
from tidewell.operators import stability as T
from tidewell.plans.tables import DAILY, daily, rounded

LOW, HIGH = 21.0, 364.0
TOP = 10


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.resample_last(daily(spark, sf_dir), 7)


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.periodogram(S.build_signal(weekly(spark, sf_dir)), 7.0)
    return found.select("series", "k", "n", "re", "im", "power", (F.hypot("re", "im") / F.col("n")).alias("amplitude"))


def cycle_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.resample_last(daily(spark, sf_dir)), 4)


def cycle_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.infer_step(daily(spark, sf_dir))


def cycle_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.between_dates(daily(spark, sf_dir), "1996-02-01", "1996-03-31"), 4)


def cycle_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.returns(daily(spark, sf_dir)))


def cycle_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.returns(daily(spark, sf_dir), "diff"), 4)


def cycle_detrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.detrend(daily(spark, sf_dir), 30), 4)


def cycle_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.build_signal(weekly(spark, sf_dir)))


def cycle_dft_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest bins of each priority's weekly log returns."""
    rows = rounded(S.dft(S.build_signal(weekly(spark, sf_dir))), 9).select("series", "k", "n", "amplitude", "power")
    place = F.row_number().over(S.by_series().orderBy(F.desc("power"), "k"))
    return rows.withColumn("place", place).where(F.col("place") <= TOP)


def cycle_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.periodogram(S.build_signal(weekly(spark, sf_dir)), 7.0, LOW, HIGH)
    return rounded(found.select("series", "k", "period_days", "norm_power"))


def cycle_band_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.in_band(spectrum(spark, sf_dir), LOW, HIGH, 7.0).select("series", "k", "period_days", "norm_power"))


def cycle_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.local_peaks(spectrum(spark, sf_dir)).select("series", "k", "power"), 9)


def cycle_band_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spectrum(spark, sf_dir)
    return rounded(S.band_metrics(S.local_peaks(bins), bins))


def cycle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    signal = S.build_signal(weekly(spark, sf_dir))
    return rounded(S.windowed_by_length(signal, [104, 156], 52).groupBy("series", "window", "n").agg(F.count(F.lit(1)).alias("rows"), F.sum("value").alias("total")))


LENGTHS, EVERY = [104, 156], 52  # weeks
LIMITS = T.Limits()


def whole_candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The weekly signal and its candidate cycles."""
    signal = S.build_signal(weekly(spark, sf_dir))
    band = T.in_periods(T.spectra(signal, ["series"], 7.0), ["series"], LOW, HIGH)
    return signal, T.candidates(band, ["series"])


def cycle_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks that keep their distance from stronger ones."""
    return rounded(whole_candidates(spark, sf_dir)[1].select("series", "k", "freq", "period_days", "power", "norm_power"), 9)


def cycle_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate cycle in every window."""
    signal, cycles = whole_candidates(spark, sf_dir)
    found = T.window_measures(S.windowed_by_length(signal, LENGTHS, EVERY), cycles, 7.0, LOW, HIGH, LIMITS)
    return rounded(found.select("series", "period_days", "start", "n", "start_date", "mid_date", "end_date", "band_ratio", "snr", "amplitude", "phase", "lag", F.col("r2").alias("fit"), "present"))


def cycle_nearest_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of each window's spectrum that is nearest to each candidate."""
    signal, cycles = whole_candidates(spark, sf_dir)
    keys = ["series", "window"]
    found = T.nearest_bins(cycles, T.spectra(S.windowed_by_length(signal, LENGTHS, EVERY), keys, 7.0), keys, ["series"])
    return rounded(found, 9)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.evaluate(S.build_signal(weekly(spark, sf_dir)), 7.0, LOW, HIGH, LENGTHS, EVERY, LIMITS)


def cycle_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measures of stability, and the ranks, of every candidate cycle."""
    rows = evaluated(spark, sf_dir)
    return rounded(rows.withColumn("window_ratios", F.array_join(F.transform("window_ratios", lambda x: F.format_string("%.6f", F.round(x, 6))), ",")))


def cycle_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection from all candidates, p-values not asked for."""
    chosen = T.select_cycles(evaluated(spark, sf_dir))
    return rounded(chosen.select("series", "chosen", "rung", "period_days", "rank_norm", "presence_ratio", "phase_locking_r", "snr_median", "norm_power"))


def cycle_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The p-value of each candidate among 100 surrogates of its series."""
    signal, cycles = whole_candidates(spark, sf_dir)
    own = T.band_snr(cycles, T.spectra(signal, ["series"], 7.0), ["series"], ["series"], LIMITS)
    maxima = T.band_maxima(T.surrogate_spectra(signal, 100, 7.0), LOW, HIGH, LIMITS)
    return rounded(T.p_values(own.withColumnRenamed("snr", "snr_global"), maxima))


def cycle_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = spectrum(spark, sf_dir)
    metrics = S.band_metrics(S.local_peaks(bins), bins)
    return rounded(S.rank_score(metrics, {"snr": 1.0, "band_ratio": 0.5}).select("series", "k", "rank_score", "rank_norm"))


def cycle_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest bins as a wave, 120 days past the end."""
    signal = S.build_signal(weekly(spark, sf_dir))
    bins = S.periodogram(signal, 7.0)
    best = bins.withColumn("p", F.row_number().over(S.by_series().orderBy(F.desc(F.round("power", 9)), "k"))).where("p <= 3")
    return rounded(S.reconstruct(best.select("series", "k", "n", "re", "im"), S.extended(signal, 7.0, 120)))


def cycle_scalogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(S.scalogram(S.build_signal(weekly(spark, sf_dir)), 4.0, 40.0, 12).groupBy("series", "period").agg(F.avg("amplitude").alias("mean"), F.max("amplitude").alias("most")))


def cycle_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cycles found again in a synthetic series with noise."""
    periods = [45.0, 90.0, 140.0, 220.0, 365.0]
    signal = S.synthetic(spark, 1460, periods, [1.0, 0.9, 0.8, 0.9, 1.0], [0.3, 1.1, 2.0, 0.7, 1.6])
    power = S.periodogram(signal, 1.0, 30.0, 500.0)
    best = S.spaced_top(S.local_peaks(power), [F.desc("power"), F.asc("k")], 8)
    truth = spark.createDataFrame([(p,) for p in periods], "period_days double")
    return rounded(S.recovered(best, truth))


WEEKLY = f"""{DAILY},
w AS (SELECT series, DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', ts) / 7) * 7 AS INTEGER) AS ts, arg_max(value, ts) AS value FROM s GROUP BY ALL),
b AS (SELECT series, min(ts) AS a, max(ts) AS z FROM w GROUP BY series),
g AS (SELECT series, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS ts FROM b),
r AS (SELECT g.series, g.ts, last_value(w.value IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS value FROM g LEFT JOIN w ON w.series = g.series AND w.ts = g.ts)"""
RETURNS = """x AS (SELECT series, ts, CASE WHEN min(value) OVER (PARTITION BY series) > 0 THEN ln(value) - ln(lag(value) OVER (PARTITION BY series ORDER BY ts)) ELSE value / nullif(lag(value) OVER (PARTITION BY series ORDER BY ts), 0) - 1 END AS value FROM {of}),
y AS (SELECT * FROM x WHERE value IS NOT NULL)"""
SIGNAL = f"""{WEEKLY},
{RETURNS.format(of="r")},
z AS (SELECT series, ts, CASE WHEN stddev_pop(value) OVER (PARTITION BY series) > 0 THEN (value - avg(value) OVER (PARTITION BY series)) / stddev_pop(value) OVER (PARTITION BY series) ELSE value - avg(value) OVER (PARTITION BY series) END AS value FROM y),
h AS (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY series) AS n, value FROM z),
t AS (SELECT series, ts, i, n, value * CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * i / (n - 1)) ELSE 1 END AS value FROM h)"""
SPECTRUM = f"""{SIGNAL},
k AS (SELECT *, unnest(generate_series(1, n // 2)) AS k FROM t),
f AS (SELECT series, k, n, sum(value * cos(2 * pi() * ((k * i) % n) / n)) AS re, sum(-value * sin(2 * pi() * ((k * i) % n) / n)) AS im FROM k GROUP BY series, k, n),
d AS (SELECT *, sqrt(re * re + im * im) / n AS amplitude, (re * re + im * im) / (n * n) AS power FROM f)"""
PEAKS = f"""{SPECTRUM},
q AS (SELECT *, coalesce(power > lag(power) OVER (PARTITION BY series ORDER BY k) AND power >= lead(power) OVER (PARTITION BY series ORDER BY k), false) AS peak, count(*) OVER (PARTITION BY series) AS bins, row_number() OVER (PARTITION BY series ORDER BY power DESC, k) AS place FROM d),
pk AS (SELECT * FROM (SELECT *, bool_or(peak) OVER (PARTITION BY series) AS any_peak FROM q) WHERE bins <= 2 OR peak OR (NOT any_peak AND place = 1))"""
METRICS = f"""{PEAKS},
tot AS (SELECT series, sum(power) AS total FROM d GROUP BY series),
bm AS (SELECT p.series, p.k, sum(CASE WHEN abs(d.k - p.k) <= 1 THEN d.power END) AS band, median(CASE WHEN abs(d.k - p.k) > 2 THEN d.power END) AS back FROM pk p JOIN d ON d.series = p.series AND abs(d.k - p.k) <= 8 GROUP BY p.series, p.k),
me AS (SELECT bm.series, k, band / greatest(total, 1e-12) AS band_ratio, band / greatest(back, 1e-18) AS snr FROM bm JOIN tot ON tot.series = bm.series)"""
BAND = f"""{SPECTRUM},
bd AS (SELECT series, k, n * 7.0 / k AS period_days, power / sum(power) OVER (PARTITION BY series) AS norm_power FROM d WHERE n * 7.0 / k BETWEEN {LOW} AND {HIGH})
SELECT series, k, round(CAST(period_days AS DOUBLE), 6) AS period_days, round(norm_power, 6) AS norm_power FROM bd"""
Z = "CASE WHEN stddev_pop(ln(1 + greatest({c}, 0))) OVER p > 1e-12 THEN (ln(1 + greatest({c}, 0)) - avg(ln(1 + greatest({c}, 0))) OVER p) / stddev_pop(ln(1 + greatest({c}, 0))) OVER p ELSE 0 END"
WINDOWS = """len_ AS (SELECT series, max(n) AS n FROM t GROUP BY series),
st AS (SELECT DISTINCT series, w, s0 FROM (SELECT series, n, w, unnest(list_append(generate_series(0, n - w, 52), n - w)) AS s0 FROM len_, (VALUES (104), (156)) AS l(w) WHERE w <= n)),
pl AS (SELECT series, w, s0, row_number() OVER (PARTITION BY series ORDER BY w, s0) - 1 AS win FROM (SELECT * FROM st UNION ALL SELECT series, n, 0 FROM len_ WHERE series NOT IN (SELECT series FROM st)))"""



def _bands(name: str, bins: str, cycles: str, keys: str) -> str:
    """CTE ``name``: band ratio and SNR of ``cycles`` (series, freq) in the
    spectra ``bins`` (keys, freq, power), by comparison with every bin."""
    on = " AND ".join(f"w.{k} = b.{k}" for k in keys.split(", "))
    return f"""{name}_g AS (SELECT {keys}, count(*) AS bins, sum(power) AS total, median(power) AS middle, max(freq) - min(freq) AS span FROM {bins} GROUP BY {keys}),
{name}_s AS (SELECT g.*, c.freq AS f0, greatest(CASE WHEN bins > 1 THEN span / (bins - 1) ELSE greatest(c.freq / 20, 1e-6) END, 1e-12) AS step FROM {name}_g g JOIN {cycles} c USING (series)),
{name}_w AS (SELECT *, greatest(near * 2, f0 * {LIMITS.background}) * (1 + 1e-9) AS far, greatest(near * 1.2, f0 * {LIMITS.apart}) * (1 + 1e-9) AS gap FROM (SELECT *, greatest(step * 1.5, f0 * {LIMITS.peak}) AS near FROM {name}_s)),
{name}_a AS (SELECT {", ".join(f"w.{k}" for k in keys.split(", "))}, f0, any_value(total) AS total, any_value(middle) AS middle, sum(CASE WHEN abs(freq - f0) <= near * (1 + 1e-9) THEN power END) AS band, count(CASE WHEN abs(freq - f0) <= near * (1 + 1e-9) THEN 1 END) AS held, median(CASE WHEN abs(freq - f0) <= far AND abs(freq - f0) > gap THEN power END) AS level FROM {name}_w w JOIN {bins} b ON {on} GROUP BY ALL),
{name} AS (SELECT {keys}, f0 AS freq, CASE WHEN held > 0 AND total > 0 THEN band / total ELSE 0 END AS band_ratio, CASE WHEN held > 0 AND total > 0 THEN band / greatest(coalesce(level, middle) * held, 1e-18) ELSE 0 END AS snr FROM {name}_a)"""


CANDIDATES = f"""{SPECTRUM},
fb AS (SELECT series, k, k * (1 / (n * CAST(7 AS DOUBLE))) AS freq, power FROM d UNION ALL SELECT series, 0, 0, sum(value) * sum(value) / (max(n) * max(n)) FROM t GROUP BY series),
bb AS (SELECT *, 1 / freq AS period_days, power / sum(power) OVER (PARTITION BY series) AS norm_power FROM fb WHERE k > 0 AND 1 / freq BETWEEN {LOW} AND {HIGH}),
bp AS (SELECT *, coalesce(power > lag(power) OVER v AND power >= lead(power) OVER v, false) AS peak, count(*) OVER (PARTITION BY series) AS bins, row_number() OVER (PARTITION BY series ORDER BY power DESC, period_days) AS place FROM bb WINDOW v AS (PARTITION BY series ORDER BY period_days)),
bq AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY series ORDER BY power DESC, period_days) AS place FROM (SELECT *, bool_or(peak) OVER (PARTITION BY series) AS any_peak FROM bp) WHERE bins <= 2 OR peak OR (NOT any_peak AND place = 1)),
gr AS (SELECT series, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[]) AS kept FROM (SELECT DISTINCT series FROM bq) UNION ALL
  SELECT gr.series, q.place, CASE WHEN len(kept) < 48 AND len([x FOR x IN kept IF abs(x - period_days) / greatest(x, period_days) < 0.1]) = 0 THEN list_append(kept, period_days) ELSE kept END FROM gr JOIN bq q ON q.series = gr.series AND q.place = gr.place + 1),
ca AS (SELECT q.series, k, freq, period_days, power, norm_power FROM bq q JOIN (SELECT series, arg_max(kept, place) AS kept FROM gr GROUP BY series) USING (series) WHERE list_contains(kept, period_days))"""
MEASURED = f"""{CANDIDATES},
{WINDOWS},
wt AS (SELECT t.series, win, w, s0, i - s0 AS i, ts, value FROM t JOIN pl ON pl.series = t.series AND i >= s0 AND i < s0 + w),
wf AS (SELECT series, win, k * (1 / (w * CAST(7 AS DOUBLE))) AS freq, (pow(sum(value * cos(2 * pi() * ((k * i) % w) / w)), 2) + pow(sum(value * sin(2 * pi() * ((k * i) % w) / w)), 2)) / (w * w) AS power FROM (SELECT *, unnest(range(1, w // 2 + 1)) AS k FROM wt) GROUP BY series, win, w, k),
wb AS (SELECT * FROM wf WHERE 1 / freq BETWEEN {LOW} AND {HIGH}),
{_bands("sn", "wb", "ca", "series, win")},
h0 AS (SELECT wt.series, win, freq, period_days, value AS y, 7 * (i - (w - 1) / 2) AS t, cos(2 * pi() * 7 * i / period_days) AS c, sin(2 * pi() * 7 * i / period_days) AS s FROM wt JOIN ca USING (series)),
h1 AS (SELECT series, win, freq, avg(y) AS my, avg(c) AS mc, avg(s) AS ms, sum(t * y) / sum(t * t) AS ty, sum(t * c) / sum(t * t) AS tc, sum(t * s) / sum(t * t) AS tn FROM h0 GROUP BY ALL),
h2 AS (SELECT h0.series, h0.win, h0.freq, sum(pow(c - mc - tc * t, 2)) AS cc, sum(pow(s - ms - tn * t, 2)) AS ss, sum((c - mc - tc * t) * (s - ms - tn * t)) AS cs, sum((c - mc - tc * t) * y) AS cy, sum((s - ms - tn * t) * y) AS sy, sum(pow(y - my - ty * t, 2)) AS yy, sum(pow(y - my, 2)) AS sst FROM h0 JOIN h1 ON h0.series = h1.series AND h0.win = h1.win AND h0.freq = h1.freq GROUP BY ALL),
h3 AS (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs * cs) AS a, (sy * cc - cy * cs) / (cc * ss - cs * cs) AS b FROM h2),
wd AS (SELECT series, win, min(s0) AS s0, max(w) AS w, min(ts) AS d0, max(CASE WHEN i = w // 2 THEN ts END) AS d1, max(ts) AS d2 FROM wt GROUP BY series, win),
wm AS (SELECT h3.series, h3.win, ca.freq, ca.period_days, s0, w, d0, d1, d2, coalesce(band_ratio, 0) AS band_ratio, coalesce(snr, 0) AS snr, sqrt(a * a + b * b) AS amplitude, atan2(-b, a) AS phase, atan2(-b, a) / (2 * pi()) * period_days AS lag, CASE WHEN sst > 0 THEN greatest(0, least(1, 1 - (yy - a * cy - b * sy) / sst)) ELSE 0 END AS fit,
  coalesce(snr >= {LIMITS.snr} AND band_ratio >= {LIMITS.ratio}, false) AS present FROM h3 JOIN ca USING (series, freq) JOIN wd ON wd.series = h3.series AND wd.win = h3.win LEFT JOIN sn ON sn.series = h3.series AND sn.win = h3.win AND sn.freq = h3.freq)"""
EVALUATED = f"""{MEASURED},
{_bands("sg", "fb", "ca", "series")},
st_ AS (SELECT series, freq, avg(CAST(present AS INTEGER)) AS presence_ratio, median(band_ratio) AS band_ratio_median, string_agg(printf('%.6f', round(band_ratio, 6)), ',' ORDER BY s0, w) AS window_ratios, median(amplitude) AS amp_median, quantile_cont(amplitude, 0.25) AS amp_p25, min(amplitude) AS amp_min, median(fit) AS fit_median,
  median(snr) AS snr_median, quantile_cont(snr, 0.25) AS snr_p25, median(lag) AS lag_median, quantile_cont(lag, 0.75) - quantile_cont(lag, 0.25) AS lag_iqr, sqrt(pow(avg(cos(phase)), 2) + pow(avg(sin(phase)), 2)) AS phase_locking_r FROM wm GROUP BY series, freq),
e0 AS (SELECT st_.*, ca.period_days, ca.power, ca.norm_power, sg.snr AS snr_global, snr_median - {LIMITS.snr} AS margin_median, presence_ratio * norm_power AS stability_score, presence_ratio >= {LIMITS.presence} AS stable FROM st_ JOIN ca USING (series, freq) JOIN sg USING (series, freq)),
e1 AS (SELECT *, {" + ".join(f"(CASE WHEN stddev_pop({x}) OVER p > 1e-12 THEN ({x} - avg({x}) OVER p) / stddev_pop({x}) OVER p ELSE 0 END)" for x in ("ln(1 + amp_median)", "ln(1 + snr_median)", "presence_ratio", "phase_locking_r"))} AS rank_score FROM e0 WINDOW p AS (PARTITION BY series)),
e2 AS (SELECT *, CASE WHEN max(rank_score) OVER p > min(rank_score) OVER p THEN (rank_score - min(rank_score) OVER p) / (max(rank_score) OVER p - min(rank_score) OVER p) ELSE 0 END AS rank_norm, CASE WHEN max(stability_score) OVER p > 0 THEN stability_score / max(stability_score) OVER p ELSE 0 END AS stability_norm FROM e1 WINDOW p AS (PARTITION BY series)),
ev AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY stable DESC, rank_norm DESC, presence_ratio DESC, snr_median DESC, period_days) AS place FROM e2)"""
CHOICE = T.Choice()
SELECTED = f"""{EVALUATED},
s1 AS (SELECT *, CASE WHEN presence_ratio >= {CHOICE.presence} AND phase_locking_r >= {CHOICE.locking} AND amp_median >= {CHOICE.amplitude} THEN 1 WHEN presence_ratio >= {CHOICE.presence} THEN 2 ELSE 3 END AS rung FROM ev WHERE stable),
s2 AS (SELECT * FROM (SELECT *, min(rung) OVER (PARTITION BY series) AS first FROM s1) WHERE rung = first),
s3 AS (SELECT * FROM (SELECT *, quantile_cont(norm_power, {CHOICE.percentile}) OVER (PARTITION BY series) AS least FROM s2) WHERE norm_power >= least),
s4 AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY series ORDER BY rank_norm DESC, presence_ratio DESC, phase_locking_r DESC, snr_median DESC, period_days) AS place FROM s3),
s5 AS (SELECT series, CAST(0 AS BIGINT) AS place, CAST([] AS DOUBLE[]) AS kept FROM (SELECT DISTINCT series FROM s4) UNION ALL
  SELECT s5.series, q.place, CASE WHEN len(kept) < {CHOICE.most} AND len([x FOR x IN kept IF abs(x - period_days) / greatest(x, period_days) < {CHOICE.distance}]) = 0 THEN list_append(kept, period_days) ELSE kept END FROM s5 JOIN s4 q ON q.series = s5.series AND q.place = s5.place + 1),
s6 AS (SELECT s4.*, row_number() OVER (PARTITION BY s4.series ORDER BY s4.place) AS chosen FROM s4 JOIN (SELECT series, arg_max(kept, place) AS kept FROM s5 GROUP BY series) k ON k.series = s4.series WHERE list_contains(kept, period_days))"""
_NUMBERS = lambda names: ", ".join(f"round(CAST({x} AS DOUBLE), 6) AS {x}" for x in names.split())

QUERIES = {
    "cycle_resample": cycle_resample, "cycle_step": cycle_step, "cycle_date_range": cycle_date_range, "cycle_returns": cycle_returns, "cycle_diff": cycle_diff, "cycle_detrend": cycle_detrend, "cycle_signal": cycle_signal,
    "cycle_dft_top": cycle_dft_top, "cycle_periodogram": cycle_periodogram, "cycle_band_filter": cycle_band_filter, "cycle_peaks": cycle_peaks, "cycle_band_metrics": cycle_band_metrics, "cycle_windows": cycle_windows,
    "cycle_candidates": cycle_candidates, "cycle_measures": cycle_measures, "cycle_nearest_bins": cycle_nearest_bins, "cycle_stability": cycle_stability, "cycle_select": cycle_select, "cycle_rank": cycle_rank, "cycle_reconstruct": cycle_reconstruct, "cycle_surrogates": cycle_surrogates, "cycle_scalogram": cycle_scalogram, "cycle_recovery": cycle_recovery,
}
ORACLES = {
    "cycle_resample": f"""WITH {DAILY}, b AS (SELECT series, min(ts) AS a, max(ts) AS z FROM s GROUP BY series),
g AS (SELECT series, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ts FROM b)
SELECT g.series, CAST(g.ts AS VARCHAR) AS ts, round(last_value(s.value IGNORE NULLS) OVER (PARTITION BY g.series ORDER BY g.ts ROWS UNBOUNDED PRECEDING), 4) AS value FROM g LEFT JOIN s ON s.series = g.series AND s.ts = g.ts""",
    "cycle_step": f"WITH {DAILY}, l AS (SELECT series, date_diff('day', lag(ts) OVER (PARTITION BY series ORDER BY ts), ts) AS gap FROM s) SELECT series, CAST(coalesce(median(CASE WHEN gap > 0 THEN gap END), 1) AS DOUBLE) AS step_days FROM l GROUP BY series",
    "cycle_date_range": f"WITH {DAILY} SELECT series, CAST(ts AS VARCHAR) AS ts, round(value, 4) AS value FROM s WHERE ts BETWEEN DATE '1996-02-01' AND DATE '1996-03-31'",
    "cycle_returns": f"WITH {DAILY}, {RETURNS.format(of='s')} SELECT series, CAST(ts AS VARCHAR) AS ts, round(value, 6) AS value FROM y",
    "cycle_diff": f"WITH {DAILY}, l AS (SELECT series, ts, value - lag(value) OVER (PARTITION BY series ORDER BY ts) AS value FROM s) SELECT series, CAST(ts AS VARCHAR) AS ts, round(value, 4) AS value FROM l WHERE value IS NOT NULL",
    "cycle_detrend": f"""WITH {DAILY}, l AS (SELECT series, ts, value, avg(value) OVER f AS m, count(value) OVER f AS held, count(*) OVER (PARTITION BY series) AS n FROM s WINDOW f AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT series, CAST(ts AS VARCHAR) AS ts, round(CASE WHEN n < 30 THEN value ELSE value - m END, 4) AS value FROM l WHERE n < 30 OR held >= 8""",
    "cycle_signal": f"WITH {SIGNAL} SELECT series, CAST(ts AS VARCHAR) AS ts, i, n, round(value, 6) AS value FROM t",
    "cycle_dft_top": f"WITH {SPECTRUM}, o AS (SELECT series, k, n, round(amplitude, 9) AS amplitude, round(power, 9) AS power FROM d), e AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY power DESC, k) AS place FROM o) SELECT * FROM e WHERE place <= {TOP}",
    "cycle_periodogram": f"WITH {BAND}",
    "cycle_band_filter": f"WITH {BAND}",
    "cycle_peaks": f"WITH {PEAKS} SELECT series, k, round(power, 9) AS power FROM pk",
    "cycle_band_metrics": f"WITH {METRICS} SELECT series, k, round(band_ratio, 6) AS band_ratio, round(snr, 6) AS snr FROM me",
    "cycle_windows": f'WITH {SIGNAL}, {WINDOWS} SELECT t.series, win AS "window", w AS n, count(*) AS rows, round(sum(value), 6) AS total FROM t JOIN pl ON pl.series = t.series AND i >= s0 AND i < s0 + w GROUP BY ALL',
    "cycle_candidates": f"WITH RECURSIVE {CANDIDATES} SELECT series, k, round(freq, 9) AS freq, round(period_days, 9) AS period_days, round(power, 9) AS power, round(norm_power, 9) AS norm_power FROM ca",
    "cycle_nearest_bins": f"""WITH RECURSIVE {CANDIDATES}, {WINDOWS}, nb AS (SELECT ca.series, win, freq AS f0, k AS k, k * (1 / (w * CAST(7 AS DOUBLE))) AS f FROM (SELECT *, unnest(range(0, w // 2 + 1)) AS k FROM pl) q JOIN (SELECT series, freq FROM ca) ca ON ca.series = q.series),
nr AS (SELECT *, row_number() OVER (PARTITION BY series, win, f0 ORDER BY round(abs(f - f0), 15), k) AS place FROM nb) SELECT series, CAST(win AS INTEGER) AS "window", round(f0, 9) AS f0, k, round(f, 9) AS freq FROM nr WHERE place = 1""",
    "cycle_stability": f"""WITH RECURSIVE {MEASURED} SELECT series, CAST(s0 AS BIGINT) AS start, CAST(w AS INTEGER) AS n, CAST(d0 AS VARCHAR) AS start_date, CAST(d1 AS VARCHAR) AS mid_date, CAST(d2 AS VARCHAR) AS end_date, present, {_NUMBERS("period_days band_ratio snr amplitude phase lag fit")} FROM wm""",
    "cycle_measures": f"""WITH RECURSIVE {EVALUATED} SELECT series, window_ratios, stable, CAST(place AS INTEGER) AS place, {_NUMBERS("freq period_days power norm_power presence_ratio band_ratio_median amp_median amp_p25 amp_min fit_median snr_median snr_p25 snr_global lag_median lag_iqr phase_locking_r margin_median stability_score rank_score rank_norm stability_norm")} FROM ev""",
    "cycle_select": f"""WITH RECURSIVE {SELECTED} SELECT series, CAST(chosen AS INTEGER) AS chosen, CAST(rung AS INTEGER) AS rung, {_NUMBERS("period_days rank_norm presence_ratio phase_locking_r snr_median norm_power")} FROM s6""",
    "cycle_rank": f"""WITH {METRICS}, sc AS (SELECT series, k, 1.0 * {Z.format(c="snr")} + 0.5 * {Z.format(c="band_ratio")} AS rank_score FROM me WINDOW p AS (PARTITION BY series))
SELECT series, k, round(CAST(rank_score AS DOUBLE), 6) AS rank_score, round(CAST(CASE WHEN max(rank_score) OVER q > min(rank_score) OVER q THEN (rank_score - min(rank_score) OVER q) / (max(rank_score) OVER q - min(rank_score) OVER q) ELSE 0 END AS DOUBLE), 6) AS rank_norm FROM sc WINDOW q AS (PARTITION BY series)""",
    "cycle_reconstruct": f"""WITH {SPECTRUM}, e AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(power, 9) DESC, k) AS place FROM d),
xd AS (SELECT series, i, ts, false AS projection FROM t UNION ALL SELECT series, n - 1 + s, z + CAST(7 * s AS INTEGER), true FROM (SELECT series, max(n) AS n, max(ts) AS z, unnest(range(1, 19)) AS s FROM t GROUP BY series))
SELECT series, xd.i, CAST(any_value(ts) AS VARCHAR) AS ts, any_value(projection) AS projection, round(sum(2.0 / n * (re * cos(2 * pi() * ((k * xd.i) % n) / n) - im * sin(2 * pi() * ((k * xd.i) % n) / n))), 6) AS value FROM xd JOIN e USING (series) WHERE place <= 3 GROUP BY series, xd.i""",
}
