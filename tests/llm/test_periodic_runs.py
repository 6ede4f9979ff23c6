import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from tests.compare import connection
from tests.llm.helpers import LONG, clashing, empty, odd_documents
from tidewell.llm import periodic_runs


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if all(words[i] == words[i + q] for i in range(len(words) - q)))


def brute(words):
    """Every maximal stretch of every period, checked by its definition."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and smallest_period(words[i : i + length]) == q:
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def contract(doc_id, text):
    """The result of a row, straight from the contract."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = sorted(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))[:1]
    shown = (*best[0], 1000 * best[0][1] // best[0][2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def random_text(rng):
    words = []
    while len(words) < rng.randrange(1, 400):
        unit = [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 13, 16, 40]))]
        words += (unit * rng.choice([1, 1, 2, 3, 4, 12, 30]))[: rng.randrange(1, 300)]
    return " ".join(words)


def test_scan_equals_brute_force():
    rng = random.Random(7)
    for _ in range(250):
        words = random_text(rng).encode().split()
        ids = periodic_runs.word_ids(words)
        most = periodic_runs.largest_lag(len(words))
        found = periodic_runs.smallest_periods(periodic_runs.stretches(ids, 1, most)) if most else []
        assert found == brute(words)


def test_blocks_of_lags(monkeypatch):
    """Many blocks a text, and both widths of ids, find the same."""
    rng = random.Random(8)
    texts = [random_text(rng).encode().split() for _ in range(30)]
    monkeypatch.setattr(periodic_runs, "BLOCK", 1024)
    for words in texts:
        ids = periodic_runs.word_ids(words)
        most = periodic_runs.largest_lag(len(words))
        for kind in (ids, ids.astype("uint32")):
            assert (periodic_runs.smallest_periods(periodic_runs.stretches(kind, 1, most)) if most else []) == brute(words)


@pytest.mark.parametrize("range_size", [periodic_runs.RANGE, 2000])
def test_rows_equal_the_contract(spark, range_size):
    """Whole and split into ranges of lags, ids with repeated tails included."""
    rng = random.Random(9)
    rows = [(k, random_text(rng)) for k in range(120)] + [(k, "one two \t three\x0b four é " * rng.randrange(40)) for k in range(200, 230)]
    rows += [(5, "a " * 23), (5, "a " * 24), (6, None), (7, ""), (8, " \n "), (None, "x y z " * 9), (5, "a " * 24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [tuple(r) for r in periodic_runs.find_runs(docs, tails=True, range_size=range_size).collect()]
    assert sorted(found, key=repr) == sorted((contract(*r) for r in rows), key=repr)


def test_query_equals_the_contract(spark, tmp_path):
    rows = connection().sql("SELECT doc_id, text FROM documents WHERE length(text) < 2500").fetchall()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in periodic_runs.op12_periodic(spark, str(tmp_path)).collect()]
    assert len(found) > 50 and sum(r[1] > 0 for r in found) > 5
    assert sorted(found) == sorted(contract(*r) for r in rows)


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    found = periodic_runs.find_runs(docs, runs_column="runs").collect()
    assert len(found) == 11
    by_id = {r["doc_id"]: r for r in found}
    n = len(LONG.split())
    assert [tuple(x) for x in by_id[7]["runs"]] == [(0, n, 4)] and by_id[7]["exponent_milli"] == 250 * n
    assert [tuple(x) for x in by_id[9]["runs"]] == [(0, n, 4)]
    assert by_id[1]["n_runs"] == 0 and by_id[1]["start"] is None and by_id[1]["runs"] == []
    assert periodic_runs.find_runs(empty(spark)).count() == 0
