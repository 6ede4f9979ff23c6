import math
import random
import re
from collections import Counter

import pytest

from tests.compare import SMALL, assert_same
from tests.llm.helpers import clashing, empty, odd_documents
from tidewell.llm import lexical

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = "item_id long, text string"


def terms(text):
    return [t.translate(UPPER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, best):
    """Every document scored for every item, straight from the formula."""
    docs = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs]
    docs = [x for x in docs if x[2]]
    total, length = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scores = []
        for doc, c, n in docs:
            m = 100 - 50 + (50 * n * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)
    return sorted((tuple(r) for r in lexical.search(d, i, **more).collect()), key=repr)


def made(seed):
    """Terms from rare to very common, documents that repeat, ties."""
    rng = random.Random(seed)
    text = lambda n: " ".join(f"T{int(rng.paretovariate(0.6))}" for _ in range(n))
    docs = [(k, text(rng.choice([1, 3, 20, 60, 300]))) for k in range(300)]
    docs += [(1000 + k, docs[k % 4][1]) for k in range(40)] + [(5, text(30)), (5, text(30)), (None, text(40)), (2000, None), (2001, " ,;")]
    items = [(k, text(rng.choice([1, 2, 5, 12]))) for k in range(15)] + [(3, "t1 T2"), (None, "t1 t4"), (50, None), (51, "?"), (52, "nowhere")]
    return docs, items


@pytest.mark.parametrize(("best", "first", "step"), [(5, 4, 2), (10, 20, 3), (50, 512, 8)])
def test_equals_brute_force(spark, best, first, step):
    docs, items = made(best)
    proven = []
    assert found(spark, docs, items, best=best, first=first, step=step, proven=proven) == brute(docs, items, best)
    if first < 10:  # some are proven early, some fall through
        assert len(proven) > 2 and sum(x > 0 for x in proven) > 1


def test_blocks_of_items(spark, monkeypatch):
    docs, items = made(3)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 120)
    assert found(spark, docs, items, best=7, first=16) == brute(docs, items, 7)


def test_early_tiers_read_few_postings(spark):
    """With high impacts in few documents the first tiers suffice."""
    docs = [(k, "rare " * 5 + "plain") for k in range(20)] + [(100 + k, "common " + "filler " * 30) for k in range(400)]
    proven = []
    got = found(spark, docs, [(1, "rare common")], best=5, first=8, step=4, proven=proven)
    assert got == brute(docs, [(1, "rare common")], 5) and sum(proven[:2]) == 1


def test_query_equals_sql(spark):
    assert assert_same(lexical.op13_lexical(spark, SMALL), lexical.OP13_SQL) > 0


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    items = clashing(spark.createDataFrame([(1, "beta SINGLE"), (2, "naïve 𝒳"), (3, None)], ITEMS))
    rows = [tuple(r) for r in lexical.search(docs, items).select("item_id", "rank", "doc_id").orderBy("item_id", "rank").collect()]
    assert sorted(r[2] for r in rows if r[0] == 1) == [4, 4, 5, 7, 9] and [r for r in rows if r[0] == 2] == [(2, 1, 8)]
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(docs, empty(spark, ITEMS)).count() == 0
