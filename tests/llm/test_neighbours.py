import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tests.llm.helpers import empty
from tidewell.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node string, q string"


def brute(rows, queries, k=5):
    """Exact answers in double precision; ties to the smaller id."""
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    norm = np.linalg.norm(x, axis=1)
    out = {}
    for q in queries:
        i = int(np.flatnonzero(ids == q)[0])
        sims = x @ x[i] / (norm * norm[i])
        order = [j for j in np.lexsort((ids, -np.round(sims, 12))) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(sims[j])) for j in order]
    return out


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, wanted):
    hits = sum(len({v for v, _ in found.get(q, [])} & {v for v, _ in w}) for q, w in wanted.items())
    return hits / sum(map(len, wanted.values()))


def test_query_recall_and_scores(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted = brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
    found = answers(neighbours.op10_neighbours(spark, folder))
    assert found.keys() == wanted.keys() and all(len(f) == 5 for f in found.values())
    assert recall(found, wanted) >= 0.9
    for q, f in found.items():
        exact = dict(brute(rows, [q], len(rows))[q])
        assert [s for _, s in f] == pytest.approx([exact[v] for v, _ in f], abs=1e-12)


def test_small_table_is_exact(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    wanted = brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
    found = answers(neighbours.op10_neighbours(spark, SMALL))
    assert {q: [v for v, _ in w] for q, w in wanted.items()} == {q: [v for v, _ in f] for q, f in found.items()}


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, v), (2, v), (3, None), (50, [0.0] * 3), (100, [float("nan"), 1.0, 1.0]), (150, [None, 1.0, 1.0]), (200, [2.0, 4.0, 6.0]), (None, v), (4, [3.0, 2.0, 1.0]), (5, [-1.0, 0.0, 1.0]), (6, [float("inf"), 1.0, 0.0]), (7, [1.0])]
    table = spark.createDataFrame([(*r, 1, "n", "q") for r in rows], SCHEMA)
    found = answers(neighbours.nearest(table, lambda c: F.col(c) % 50 == 0))
    assert {q: [x for x, _ in f] for q, f in found.items()} == {0: [1, 2, 200, 4, 5], 200: [0, 1, 2, 4, 5]}


def test_tiny_and_huge_components(spark):
    """Squares of these vanish or overflow in double precision."""
    base = np.random.default_rng(2).standard_normal((60, 4))
    sizes = np.array([1e-170, 1e170, 1.0, 5e-324 * 2**40])[np.arange(60) % 4]
    rows = [(i, (x * s).tolist()) for i, (x, s) in enumerate(zip(base, sizes, strict=True))]
    found = answers(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda c: F.col(c) % 10 == 0))
    plain = [(i, (np.array(v) / 2.0 ** np.floor(np.log2(np.abs(v).max()))).tolist()) for i, v in rows]
    wanted = brute(plain, found)
    assert len(found) == 6 and {q: [v for v, _ in f] for q, f in found.items()} == {q: [v for v, _ in w] for q, w in wanted.items()}


def test_empty_table(spark):
    assert neighbours.nearest(empty(spark, SCHEMA), lambda c: F.col(c) % 50 == 0).count() == 0


def cluster(n=10_000, hot=2_500, noise=1e-5):
    """Vectors with a shared mean direction, the first ``hot`` near copies."""
    rng = np.random.default_rng(3)
    mean = 2 * rng.standard_normal(32)
    x = rng.standard_normal((n, 32)) + mean
    x[:hot] = rng.standard_normal(32) + noise * rng.standard_normal((hot, 32))
    return x.astype(np.float32), mean


def table_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(4)


@pytest.mark.parametrize(("n", "hot", "noise"), [(10_000, 2_500, 1e-5), (8_000, 6_000, 0.02), (2_000, 1_500, 0.02)])
def test_recall_among_near_copies(spark, n, hot, noise):
    x, _ = cluster(n, hot, noise)
    found = answers(neighbours.nearest(table_of(spark, x), lambda c: F.col(c) % 50 == 0))
    rows = list(enumerate(x.tolist()))
    for ids in (range(0, hot, 50), range(-(-hot // 50) * 50, n, 50)):
        assert recall({q: found[q] for q in ids}, brute(rows, ids)) >= 0.9


def test_recall_with_hubs(spark):
    """A few vectors that are near to all others of their half."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((2, 16)) * 3
    x = np.concatenate([centres[k] + rng.standard_normal((1_500, 16)) for k in (0, 1)] + [centres + 0.01 * rng.standard_normal((2, 16)) for _ in range(5)]).astype(np.float32)
    found = answers(neighbours.nearest(table_of(spark, x), lambda c: F.col(c) % 30 == 0))
    assert recall(found, brute(list(enumerate(x.tolist())), found)) >= 0.9


def test_equal_and_parallel_vectors_over_a_leaf(spark):
    """600 copies of a vector and 600 multiples of another one."""
    x = np.random.default_rng(1).standard_normal((1_500, 8))
    x[:600], x[600:1_200] = x[0], x[600] * 2.0 ** np.arange(600)[:, None].__mod__(40)
    found = answers(neighbours.nearest(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), lambda c: F.col(c) % 100 == 0))
    assert [v for v, _ in found[100]] == [0, 1, 2, 3, 4]
    assert len(found) == 15 and all(abs(s - 1) < 1e-12 for q in range(0, 1_200, 100) for _, s in found[q])


def test_leaves_hold_every_node_and_few_of_them(spark):
    x, _ = cluster(3_000, 2_000, 1e-4)
    small = neighbours._small_vectors(table_of(spark, x).selectExpr("vec_id AS node", "CAST(embedding AS array<double>) AS v"))
    leaves = neighbours.dealt_leaves(small, 2, 100)
    assert leaves.groupBy("tree").agg(F.count_distinct("node").alias("n"), F.count("node").alias("m")).select("n", "m").distinct().collect() == [(3_000, 3_000)]
    assert leaves.groupBy("tree", "key").count().agg(F.max("count")).first()[0] <= 100


def test_outlier_of_a_large_table_has_neighbours(spark):
    x, mean = cluster(40_000, 0)
    x[-1] = -mean
    small = neighbours._small_vectors(table_of(spark, x).selectExpr("vec_id AS node", "CAST(embedding AS array<double>) AS v"))
    lists = neighbours.first_lists(small, neighbours.DEGREE, neighbours.TREES, neighbours.LEAF)
    lengths = lists.groupBy("node").agg(F.count_distinct("nbr").alias("n"))
    assert lengths.where("node = 39999 AND n >= 48").count() == 1
    assert lengths.where("n >= 5").count() == len(x)


def test_queries_without_enough_results_are_compared_with_all(spark, monkeypatch):
    x, mean = cluster(300, 0)
    monkeypatch.setattr(neighbours, "search_graph", lambda lists, small, starts, **search: neighbours._start(starts))
    found = answers(neighbours.nearest(table_of(spark, x), lambda c: F.col(c) % 100 == 0))
    assert {q: [v for v, _ in f] for q, f in found.items()} == {q: [v for v, _ in w] for q, w in brute(list(enumerate(x.tolist())), (0, 100, 200)).items()}
