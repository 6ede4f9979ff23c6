import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import SMALL
from tests.llm.helpers import assert_clashes_kept, clashing, empty, odd_documents
from tidewell.llm import simhash

RNG = random.Random(4)


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Smallest position reachable, by comparing all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@given(st.text(st.characters(codec="utf-8"), max_size=80))
@settings(max_examples=150, deadline=None)
def test_fingerprint_is_the_plain_rule(text):
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    docs.sort(key=lambda r: r["doc_id"])
    fps = [plain_fingerprint(r["text"]) for r in docs]
    label = components(fps)
    wanted = {r["doc_id"]: (f"{fp:016x}", docs[k]["doc_id"]) for r, fp, k in zip(docs, fps, label, strict=True)}
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, SMALL).collect()}
    assert found == wanted


def test_links_of_planted_fingerprints_in_hot_groups(spark):
    base = RNG.getrandbits(64)
    fps = {base}
    for _ in range(300):  # chains of two bits within one hot group, and strangers
        x = RNG.choice(sorted(fps))
        fps.add(x ^ (1 << RNG.randrange(64)) ^ (1 << RNG.randrange(64)))
    fps |= {RNG.getrandbits(64) for _ in range(300)}
    values = sorted(fps)
    signed = [(x - 2**64 if x >> 63 else x,) for x in values]
    for hot in (16, 100_000):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), hot)
        roots = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.connected(links).collect()}
        label = components(values)
        groups = {}
        for x, k in zip(values, label, strict=True):
            groups.setdefault(k, set()).add(roots.get(x, x))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_sliced_hits_equal_plain_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)[0]
    fps = np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 30)), replace=False))) for _ in range(64)], np.uint64)
    planes = simhash.bit_planes(fps, np.arange(64, dtype=np.uint64), np.array([0]))
    for radius in (0, 1, 2, 3, 7, 24):
        hits = simhash.sliced_hits(planes, fps, np.zeros(64, int), np.full(64, simhash.ALL), radius)
        for i in range(64):
            assert [bool(int(hits[i]) >> j & 1) for j in range(64)] == [(int(fps[i]) ^ int(fps[j])).bit_count() <= radius for j in range(64)]


def test_odd_rows(spark):
    found = simhash.near_duplicates(odd_documents(spark)).collect()
    assert len(found) == 11
    assert {r["component_id"] for r in found if r["fp"] == 0} == {1}
    assert {r["component_id"] for r in found if r["doc_id"] in (4, 5)} == {4}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def words(n):
    return [f"w{RNG.randrange(5000)}" for _ in range(n)]


def jaccard(a, b):
    x, y = set(simhash.shingle_hashes(a, 5).tolist()), set(simhash.shingle_hashes(b, 5).tolist())
    return 1.0 if not x | y else len(x & y) / len(x | y)


def changed(text, n):
    parts = text.split()
    for _ in range(n):
        parts[RNG.randrange(len(parts))] = f"z{RNG.randrange(10**6)}"
    return " ".join(parts)


def similar_fixture():
    texts = [" ".join(words(RNG.randrange(40, 300))) for _ in range(30)]
    hub = " ".join(words(200))
    texts += [changed(hub, RNG.randrange(1, 5)) for _ in range(150)]  # a large group, not all pairs similar
    for t in list(texts[:15]):
        texts += [changed(t, 1), changed(t, 3), t]
    return texts + ["", "", "one word", "one  word"]


def test_similar_texts_equal_brute_force(spark):
    texts = similar_fixture()
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot, most in ((40, 1 << 20), (1 << 17, 2000), (1 << 17, 1 << 20)):
        found = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, hot=hot, most=most).collect()}
        assert found == {i: root(i) for i in range(len(texts))}


def test_representatives_keep_columns_and_odd_rows(spark):
    docs = clashing(odd_documents(spark))
    kept = simhash.keep_representatives(docs)
    assert_clashes_kept(kept, docs.columns)
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    assert ids == [1, 4, 7, 8, None]  # 1: texts without words; None: a text of its own
    assert simhash.keep_representatives(empty(spark)).count() == 0


def test_pairs_at_the_limit_share_a_key():
    rng, pairs = np.random.default_rng(9), 10_000
    for own in (1, 5):
        missed = 0
        for _ in range(pairs):
            h = rng.integers(0, 2**64, 10 * own, np.uint64, endpoint=False)  # 8 of 10 parts are shared
            a, b = simhash.band_keys(h[: 9 * own], 16), simhash.band_keys(np.delete(h, slice(8 * own, 9 * own)), 16)
            missed += not (a == b).any()
        assert missed <= 10  # 2.2 are expected of independent hashes


def test_alike_rows_equal_plain_comparison():
    rng = np.random.default_rng(3)
    for n in (1, 2, 40, 300):
        base = rng.integers(0, 2**62, 60)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.5]), rng.integers(0, 2**62, 60), base)) for _ in range(n)]
        label = simhash.alike_rows(np.concatenate(sets), np.array([len(x) for x in sets]), 0.8)
        wanted = np.arange(n)
        pairs = [(i, j) for j in range(n) for i in range(j) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        wanted = simhash._unite(wanted, *(np.array(x, int) for x in zip(*pairs, strict=True))) if pairs else wanted
        assert (label == wanted).all()


def test_links_grow_with_the_texts_not_with_their_pairs(spark):
    """A chain of near copies of one text, most of them unlike each other."""
    rows = {}
    for n in (500, 4000):
        parts, texts = words(60), []
        for k in range(n):
            parts = list(parts)
            parts[RNG.randrange(60)] = f"y{k}"
            texts.append((" ".join(parts),))
        docs = spark.createDataFrame(texts, "text string").selectExpr("monotonically_increasing_id() AS doc_id", "text")
        signed = [(simhash._signature(t, 5, 16), t) for (t,) in texts]
        nodes = spark.createDataFrame([(s[0], (None, 0), s[1], s[2], s[3]) for s, _ in signed], "node long, one struct<doc_id: long, text_hash: long>, fp long, size long, keys array<long>")
        rows[n] = simhash.candidate_clusters(nodes, 24).count()
        assert rows[n] <= 16 * n * 2
        found = [r["component_id"] for r in simhash.similar_texts(docs).collect()]
        assert len(found) == n and len(set(found)) < n / 4
    assert rows[4000] <= 16 * rows[500]


def test_classes_and_cells_equal_brute_force(spark, monkeypatch):
    """Several families of near copies that hang together by their bits, few
    leaders a round and small parts: every branch of the classes."""
    monkeypatch.setattr(simhash, "CELL_SETS", 7)
    for leaders in (1, 3):
        monkeypatch.setattr(simhash, "LEADERS", leaders)
        base, texts = words(150), []
        for k in range(5):
            own = base[: 150 - 3 * k] + words(3 * k)
            texts += [changed(" ".join(own), RNG.randrange(1, 5)) for _ in range(25)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        label = np.arange(len(texts))
        pairs = [(j, i) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
        label = simhash._unite(label, *(np.array(x, int) for x in zip(*pairs, strict=True)))
        found = {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, hot=64, radius=64).collect()}
        groups = lambda labels: sorted(sorted(k for k in range(len(texts)) if labels[k] == x) for x in {labels[k] for k in range(len(texts))})
        assert groups(found) == groups(label)


def test_sets_of_one_large_class_travel_few_times(spark):
    """Near copies of one text: what is dealt grows with them, not with their
    square (cells of two parts each would deal every set 20 times at the end)."""
    base, dealt = words(120), {}
    for n in (5_000, 20_000):
        rows = []
        for k in range(n):
            parts = list(base)
            parts[RNG.randrange(120)] = f"y{k}"
            rows.append((1, k, np.sort(simhash.shingle_hashes(" ".join(parts), 5).view(np.int64)).tolist(), -(-n // 1024)))
        sets = simhash.stored(spark.createDataFrame(rows, "cluster long, node long, shingles array<long>, parts long"), "t")
        classes = simhash.stored(simhash.join_leaders(sets, 0.8), "t")
        assert classes.count() == n
        dealt[n] = simhash.class_cells(sets, classes, 0.8).count()
        assert dealt[n] <= 3 * n
    assert dealt[20_000] <= 5 * max(dealt[5_000], 5_000)


def test_near_duplicates_with_clashing_names(spark):
    plain, odd = (sorted(map(str, simhash.near_duplicates(d).collect())) for d in (odd_documents(spark), clashing(odd_documents(spark))))
    assert plain == odd


def test_repeated_rows_leave_one_in_a_stated_order(spark):
    docs = spark.createDataFrame([(1, "a b c", "y"), (1, "a b c", "x"), (1, "other text", "z"), (2, "a b c", "w")], "doc_id long, text string, lang string")
    kept = simhash.keep_representatives(docs).collect()
    assert [tuple(r) for r in kept] in ([(1, "a b c", "x")], [(1, "other text", "z")])
    assert kept == simhash.keep_representatives(docs.repartition(3)).collect()
