import math
import random
import re
import zlib

import numpy as np

from tests.llm.helpers import assert_clashes_kept, clashing, empty, odd_documents
from tidewell.llm import toxicity

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable")) + 1
    ones = labels == 1
    return (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_rows_are_told_apart(spark):
    found = {r["doc_id"]: r for r in toxicity.op3_toxicity(spark, FOLDER).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    held = [d for d in labels if d in found and found[d]["held_out"]]
    y = np.array([labels[d] for d in held])
    assert auc(np.array([found[d]["score"] for d in held]), y) > 0.95
    wrong = np.array([found[d]["predicted"] for d in held]) != y
    print(f"{len(held)} held-out labels, wrong {wrong.mean():.4f}, false alarms {(wrong & (y == 0)).sum()}, missed {(wrong & (y == 1)).sum()}")
    assert wrong.mean() < 0.025


def test_held_out_labels_are_not_learned(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    used = {r["doc_id"] for r in toxicity.training_rows(docs, labels).collect()}
    assert used and not any(zlib.crc32(str(d).encode()) % 4 == 2 for d in used)
    assert toxicity.training_rows(docs, labels, max_examples=10).count() <= 10


def plain_vectors(index, texts):
    """Dense rows of the stated weights, made without the index's own code."""
    dense = np.zeros((len(texts), len(index.terms)))
    for row, text in zip(dense, texts, strict=True):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        for w in set(words) & set(index.terms):
            row[index.terms[w]] = (1 + math.log(words.count(w))) * index.weight[index.terms[w]]
        row /= np.linalg.norm(row) or 1
    return dense


def plain_nearest(index, examples, vector, skip=-1):
    exact = np.round(examples @ vector, 12)
    order = [r for r in np.lexsort((np.arange(len(exact)), -exact)) if r != skip][: toxicity.NEAREST]
    return np.array(order), exact[order]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(5)
    names = ["term" + chr(97 + k % 26) + chr(97 + k // 26) for k in range(60)]
    index = toxicity.Index({w: k for k, w in enumerate(names)}, rng.uniform(0, 3, 60), np.arange(500), (rng.random(500) < 0.3).astype(float))
    texts = [" ".join(names[k] for k in rng.choice(60, rng.integers(1, 12))) + " other" * int(rng.integers(0, 30)) for _ in range(499)] + [""]
    vectors = [index.vector(toxicity.word_counts(t)) for t in texts]
    index.build(vectors)
    dense = plain_vectors(index, texts)
    for i in [*range(0, 499, 7), 499]:
        for skip in (-1, i):
            rows, sims = index.nearest(vectors[i], skip=skip)
            order, exact = plain_nearest(index, dense, dense[i], skip)
            assert np.allclose(sims, exact) and rows.tolist() == order.tolist()


def test_query_equals_brute_force(spark):
    """Scores of the table, with all examples compared and pooled plainly."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    index = toxicity.fit(docs, labels)
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert dict(zip(index.ids.tolist(), index.labels.tolist(), strict=True)) == known
    words = {d: set(re.findall(r"[^\W\d_]+", (texts[d] or "").lower())) for d in known}
    assert set(index.terms) == set().union(*words.values())  # every word is a term

    def entropy(a, n):
        return sum(-x / n * math.log2(x / n) for x in (a, n - a) if x) if n else 0.0

    total, ones = len(known), sum(known.values())
    for w in random.Random(2).sample(sorted(index.terms), 300):
        n, n1 = (sum(w in words[d] for d in known if known[d] or not one) for one in (False, True))
        gain = entropy(ones, total) - n / total * entropy(n1, n) - (total - n) / total * entropy(ones - n1, total - n)
        assert math.isclose(index.weight[index.terms[w]], math.log((1 + total) / (1 + n)) * max(gain, 0) ** 2, rel_tol=1e-6, abs_tol=1e-9)
    examples = plain_vectors(index, [texts[d] for d in index.ids.tolist()])

    def vote(rows, sims):
        w = [1 / (1.02 - min(s, 1)) if s > 0 else 0 for s in sims]
        return sum(a * index.labels[r] for a, r in zip(w, rows, strict=True)) / sum(w) if sum(w) else ones / total

    words_of = [(d, *map(list, zip(*toxicity.word_counts(texts[d]).items(), strict=True))) for d in index.ids.tolist()]
    found = toxicity._votes(spark.createDataFrame(words_of, "doc_id long, words array<string>, counts array<long>"), index.ids, index)
    assert np.allclose(found, [vote(*plain_nearest(index, examples, v)) for v in examples])
    for r in toxicity.op3_toxicity(spark, folder).collect():
        v = plain_vectors(index, [texts[r["doc_id"]]])[0]
        assert math.isclose(r["score"], np.interp(vote(*plain_nearest(index, examples, v)), index.levels, index.chances), abs_tol=1e-6)


def test_calibration_never_falls(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    assert (np.diff(index.chances) >= 0).all() and (np.diff(index.levels) >= 0).all()
    rows = toxicity.score_documents(docs.limit(5), index, with_evidence=True).collect()
    assert all(len(r["tw_evidence"]) == toxicity.NEAREST for r in rows)


def test_texts_without_telling_words_share_the_label_rate(spark):
    """Equal votes are one level, so that few labels don't reject every text."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.fit(docs, labels)
    assert toxicity.fit(docs, labels, 20).labels.size <= 20
    assert len(np.unique(index.levels)) == len(index.levels)
    assert toxicity.drop_toxic(docs, labels).count() >= 0.8 * docs.count()


def test_odd_rows_and_clashing_names(spark):
    docs = clashing(odd_documents(spark))
    labels = spark.createDataFrame([(4, 1, 1), (4, 1, 0), (2, 0, None), (None, 1, 1), (99, 1, 1)], LABELS)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert_clashes_kept(kept, docs.columns)
    assert toxicity.score_documents(docs, toxicity.fit(docs, labels)).where("tw_score > 0").count() == 0  # one label only
    none = toxicity.drop_toxic(docs, empty(spark, LABELS))
    assert none.count() == 11
    assert toxicity.drop_toxic(empty(spark), labels).count() == 0
    assert toxicity.drop_toxic(empty(spark), empty(spark, LABELS)).count() == 0


def test_texts_go_to_python_once(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    plan = toxicity.drop_toxic(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.split("\n") if "Project [struct(" in line)
    assert sent.count("text#") == 1
