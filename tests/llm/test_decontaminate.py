import random
import re

from tests.compare import SMALL, assert_same
from tests.llm.helpers import assert_clashes_kept, clashing, empty, odd_documents
from tidewell.llm import _shared, decontaminate

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, window=10):
    """(doc_id, words, hit words, item ids) of each document, by comparison of
    every place with every window."""
    wins = {}
    for item, text in items:
        ws = words(text)
        w = min(len(ws), window)
        for k in range(len(ws) - w + 1 if w else 0):
            wins.setdefault(tuple(ws[k : k + w]), set()).add(item)
    out = []
    for doc, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for win, ids in wins.items():
            for k in range(len(ws) - len(win) + 1):
                if tuple(ws[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found |= ids
        out.append((doc, len(ws), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_leaks(d, i, **more).select("doc_id", "text", decontaminate.covered("leak_hits").alias("n"), "leak_items").collect()
    return sorted(((r["doc_id"], len(words(r["text"])), r["n"], tuple(r["leak_items"])) for r in rows), key=repr)


def made(seed, few):
    """Documents of few different words, so that shingles repeat and windows overlap."""
    rng = random.Random(seed)
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(["A", "b", "é", "É", "x9"][:few]) for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 4, 5, 6, 9, 10, 11, 14, 30]))) for k in range(25)] + [(3, text(12)), (None, text(11)), (90, None), (91, " - ")]
    docs = [(k, text(rng.randrange(60))) for k in range(60)]
    docs += [(100 + k, f"{text(5)} {items[k][1].upper()} {text(9)} {items[k + 1][1]}") for k in range(20)] + [(1, text(20)), (1, docs[1][1]), (None, items[5][1])]
    return docs, items


def test_equals_brute_force(spark):
    for seed, few in ((1, 2), (2, 4), (3, 5)):
        docs, items = made(seed, few)
        assert found(spark, docs, items) == brute(docs, items)


def test_other_sizes(spark):
    docs, items = made(4, 3)
    assert found(spark, docs, items, window=4, shingle=2) == brute(docs, items, 4)


def test_blocks_of_windows(spark, monkeypatch):
    docs, items = made(5, 4)
    monkeypatch.setattr(_shared.broadcast_blocks, "__defaults__", (400,))
    assert found(spark, docs, items) == brute(docs, items)


def test_query_equals_sql(spark):
    assert assert_same(decontaminate.op11_decontaminate(spark, SMALL), decontaminate.OP11_SQL) > 0


def test_no_shuffle_of_texts(spark):
    """Shingles meet the windows inside the scan: no exchange below the join."""
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    index = decontaminate.prefixes(decontaminate.item_windows(items), docs.select(decontaminate.words("text").alias("ws")))
    met = decontaminate.document_shingles(docs.select(decontaminate.words("text").alias("ws")), 5, 10).join(_shared.broadcast_blocks(_shared.stored(index, "t"), "win")[0], "h")
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    items = clashing(spark.createDataFrame([(1, "one SINGLE line of words"), (2, "beta gamma delta alpha beta gamma delta alpha beta gamma delta"), (None, None)], "item_id long, text string"))
    out = decontaminate.find_leaks(docs, items)
    assert_clashes_kept(out.drop("leak_hits", "leak_items"), docs.columns)
    rows = out.collect()
    assert len(rows) == 11
    got = {(r["doc_id"], tuple(r["leak_items"])) for r in rows}
    assert got == {(1, ()), (2, ()), (3, ()), (4, ("1",)), (5, ("1",)), (None, ()), (7, ("2",)), (8, ()), (9, ("2",))}
    assert decontaminate.find_leaks(empty(spark), items).count() == 0
    none = decontaminate.find_leaks(docs, empty(spark, "item_id long, text string")).collect()
    assert len(none) == 11 and not any(r["leak_hits"] or r["leak_items"] for r in none)
