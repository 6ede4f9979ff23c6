"""Periodic runs of words by a scan over all lags.

The word ids of a text are compared with themselves shifted by every lag up to
a third of the text; stretches of equal places are run-length encoded. A
stretch at lag q stands for a run with period q, q words longer. A run whose
smallest period divides q shows again at lag q with the same ends (Fine and
Wilf: it is three periods long at least), so of the lags that share both ends
the smallest is the run's period.

Lags are compared many at a time, as rows of one matrix. A run of at least
``MIN_WORDS`` words and three periods has 16 equal places in a row or more,
and so a whole aligned word of eight: only where there is one is the stretch
measured. Texts whose comparisons pass ``RANGE`` are split into ranges of lags
that Spark deals over the tasks; their stretches meet again by text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm._shared import read_table, stored

MIN_WORDS = 24
MIN_EXPONENT = 3
RANGE = 1 << 31
BLOCK = 1 << 20
WORD = "[^\\x20\\x09-\\x0D]+"
FULL = np.uint64(0x0101010101010101)

Run = tuple[int, int, int]  # start, length, period

DIGESTS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def word_ids(words: list[bytes]) -> np.ndarray:
    """Numbers in order of first appearance, in the narrowest type that has
    one to spare for the padding."""
    seen: dict[bytes, int] = {}
    ids = [seen.setdefault(w, len(seen)) for w in words]
    return np.array(ids, np.uint16 if len(seen) < 0xFFFF else np.uint32)


def stretches(ids: np.ndarray, first: int, last: int) -> Iterator[Run]:
    """(start, length, lag) of the stretches with a lag of ``first`` to
    ``last`` that are long enough for a run, by ascending lag."""
    n = len(ids)
    width = -(-n // 8) * 8
    none = np.iinfo(ids.dtype).max
    shifted = np.full(width + last + 1, none, ids.dtype)
    shifted[:n] = ids
    here = shifted[:width].copy()
    here[n:] = none - 1
    rows = max(1, BLOCK // width)
    for low in range(first, last + 1, rows):
        lags = min(rows, last + 1 - low)
        there = np.lib.stride_tricks.as_strided(shifted[low:], (lags, width), (ids.itemsize, ids.itemsize))
        same = here == there
        full = np.flatnonzero(same.view(np.uint64).ravel() == FULL)
        if not len(full):
            continue
        # The last word of a row is never full, so no group of neighbours crosses rows.
        cuts = np.flatnonzero(np.diff(full) != 1)
        begins, ends = full[np.r_[0, cuts + 1]], full[np.r_[cuts, len(full) - 1]]
        row = begins * 8 // width
        lag = low + row
        likely = (ends - begins + 1) * 8 + 14 + lag >= np.maximum(MIN_WORDS, MIN_EXPONENT * lag)
        for r, q, a, b in zip(row[likely].tolist(), lag[likely].tolist(), begins[likely].tolist(), ends[likely].tolist(), strict=True):
            line = same[r]
            a, b = a * 8 - r * width, (b + 1) * 8 - r * width
            while a and line[a - 1]:
                a -= 1
            while line[b]:
                b += 1
            if b - a + q >= max(MIN_WORDS, MIN_EXPONENT * q):
                yield a, b - a + q, q


def smallest_periods(found: Iterator[Run]) -> list[Run]:
    """Runs by start and period: of equal ends, the smallest lag."""
    least: dict[tuple[int, int], int] = {}
    for start, length, lag in found:
        least[start, length] = min(lag, least.get((start, length), lag))
    return sorted(((s, n, q) for (s, n), q in least.items()), key=lambda r: (r[0], r[2]))


def largest_lag(n: int) -> int:
    return n // MIN_EXPONENT if n >= MIN_WORDS else 0


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, for every tenth id with a tail that repeats its beginning."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * ((n - a) // p + 1))[: n - a]


def digests(words: list[bytes], runs: list[Run]) -> tuple:
    """The values of ``DIGESTS``."""
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    kept = b" ".join([w for w, out in zip(words, gone.tolist(), strict=True) if not out] if runs else words)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (None, None, None, None) if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def _words(doc_id: int | None, text: bytes | None, tails: bool) -> list[bytes]:
    words = (text or b"").split()  # at ASCII white space only
    return repeated_tail(doc_id, words) if tails else words


def comparisons(n: Column) -> Column:
    """Places compared for a text of ``n`` words: each lag q up to n/3 has n-q."""
    return n * n * (5 / 18)


def find_runs(docs: DataFrame, tails: bool = False, range_size: int = RANGE, runs_column: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id and the columns of ``DIGESTS``.

    A run is a stretch of words with smallest period q, at least ``MIN_WORDS``
    words and ``MIN_EXPONENT`` periods long, that no neighbouring word extends.
    ``start, length, period, exponent_milli`` are those of the run with the
    greatest length/period (ties: smallest start, then period), null without a
    run. ``collapsed_sha256`` is of the text without what repeats: a word goes
    if any run holds it after that run's first period. ``tails`` first repeats
    the tails of every tenth id (``repeated_tail``). ``runs_column`` adds all
    runs as an array of (start, length, period).

    Null and empty texts, and texts of fewer words, have no runs. Null doc_ids
    keep their text as it is. Rows that repeat a doc_id are rows of their own.
    Other columns are not carried, so their names don't matter.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.ceil(comparisons(words.cast("double")) / range_size).alias("ranges"))
    kind = "array<struct<start:long,length:long,period:long>>"
    schema = f"doc_id long, {DIGESTS}" + (f", `{runs_column}` {kind}" if runs_column else "")
    arrow = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
    types = [pa.int64()] * 6 + [pa.string()] * 2 + [arrow] * bool(runs_column)

    def rows_of(batch: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) if made else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f"c{i}" for i in range(len(types))])

    def finished(doc_id: int | None, words: list[bytes], runs: list[Run]) -> tuple:
        own = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]] if runs_column else []
        return (doc_id, *digests(words, runs), *own)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(doc_id, text.as_py(), tails)
                most = largest_lag(len(words))
                made.append(finished(doc_id, words, smallest_periods(stretches(word_ids(words), 1, most)) if most else []))
            yield rows_of(batch, made)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc_id, text, k, ranges in zip(*(batch.column(i) for i in range(5)), strict=True):
                words = _words(doc_id.as_py(), text.as_py(), tails)
                most = largest_lag(len(words))
                first, last = (most * x // ranges.as_py() for x in (k.as_py(), k.as_py() + 1))
                found = list(stretches(word_ids(words), first + 1, last)) if last > first else []
                columns = [[key.as_py()] * len(found), *(zip(*found, strict=True) if found else [()] * 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "start", "length", "lag"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for doc_id, text, runs in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []]
                made.append(finished(doc_id.as_py(), _words(doc_id.as_py(), text.as_py(), tails), sorted(found, key=lambda r: (r[0], r[2]))))
            yield rows_of(batch, made)

    short = base.where("ranges <= 1").select("doc_id", "text").mapInArrow(whole, schema)
    # Written once, so that the numbers of the rows hold in all that follows.
    long = stored(base.where("ranges > 1").withColumn("key", F.monotonically_increasing_id()), "long-texts")
    dealt = long.select("key", "doc_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1)).alias("k"), "ranges").repartition("key", "k")
    least = dealt.mapInArrow(part, "key long, start long, length long, lag long").groupBy("key", "start", "length").agg(F.min("lag").alias("period"))
    runs = least.groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    return short.unionByName(long.join(runs, "key", "left").select("doc_id", "text", "runs").mapInArrow(joined, schema))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of ``documents``, tails repeated by the contract.

    One row a row of the table. Null and empty texts have n = 0 and no run; an
    empty table gives no rows. See ``find_runs``.
    """
    return find_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tails=True)
