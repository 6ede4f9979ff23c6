"""Approximate nearest neighbours: an NN-descent graph and greedy search.

Equal vectors are one node. The graph starts from leaves of random trees,
compared within each leaf (a leaf is split by the nearest of a few of its own
members, so tight groups are split as well as the whole), and improves by
rounds of Spark joins until hardly a list changes: each node's neighbours meet
at the node (local join), pairs of which one is new to the list are compared,
and those nearer than what they know are passed on. Queries then walk the
graph from their own node, a beam of nodes a round, until all nodes of the beam
are expanded, and the best found are ranked again by exact cosine in double
precision. Vectors travel in single precision, which holds components of float
tables exactly, and are compared in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import arrow_batches, broadcast_blocks, read_table, stored
from tidewell.llm._shared import small as small_table

DEGREE = 48
TREES = 4
LEAF = 256  # nodes that are compared with each other at the start, at most
PIVOTS = 8
PARTNERS = 4
SETTLED = 0.05  # share of new list entries at which the graph is done
BEAM = 32
POOL = 96
RERANK = 48
ENTRIES = 256
ROUNDING = 1e-6  # of a cosine, by single precision of tables of doubles
LISTS = "node long, ids binary, sims binary, fresh binary"
ENTRIES_OF = "node long, nbr long, sim double, new boolean"


def valid_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, v`` (array of double) of vectors that take part: not null,
    all components finite, not zero; of rows that repeat an id, the one with
    the least vector; of other lengths than the most frequent (of equally
    frequent ones the shortest), none. Each is scaled by a power of two, which
    changes no cosine, so that squares neither vanish nor overflow."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    kept = rows.where(F.size("v") == (usual["n"] if usual else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))
    scale = F.pow(F.lit(2.0), F.floor(F.log2(F.array_max(F.transform("v", F.abs)))))
    return kept.withColumn("scale", scale).select("vec_id", F.transform("v", lambda x: x / F.col("scale")).alias("v"))


def nodes_of(vectors: DataFrame, most: int) -> DataFrame:
    """``node, members, v``: one row for each different vector; members are
    its ``most`` smallest ids, the first of them names the node."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = vectors.withColumn("r", rank).where(F.col("r") <= most)
    members = F.array_sort(F.collect_list("vec_id"))
    return few.groupBy("v").agg(members.alias("members")).select(F.col("members")[0].alias("node"), "members", "v")


def _packed(values: list[np.ndarray] | np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


def _small_vectors(nodes: DataFrame) -> DataFrame:
    """``node, q``: components in single precision, scaled by a power of two."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            v = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(n, -1) if n else np.zeros((0, 1))
            q = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True, initial=0))[1]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), _packed(q)], names=["node", "q"])

    return nodes.select("node", "v").mapInArrow(pack, "node long, q binary")


def _unit(packed: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), "<f4").reshape(len(packed), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int = 1) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys (the first columns) from sorted
    batches; the last run of a batch waits for the next."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if kept is not None:
            table = pa.concat_tables([kept, table])
        same = np.ones(table.num_rows, bool)
        for k in range(n_keys):
            key = table.column(k).to_numpy()
            same &= key == key[-1]
        first = 0 if same.all() else len(same) - int(np.argmin(same[::-1]))
        if first:
            yield table.slice(0, first)
        kept = table.slice(first)
    if kept is not None:
        yield kept


def _runs(table: pa.Table, n_keys: int) -> list[tuple[int, int]]:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for k in range(n_keys):
        key = table.column(k).to_numpy()
        new[1:] |= key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True))


def _best(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner its ``most`` best different ids, best first; an id that
    was known before stays known."""
    order = np.lexsort((-sims, fresh, ids, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    first = np.ones(len(ids), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sims, fresh = owner[first], ids[first], sims[first], fresh[first]
    order = np.lexsort((ids, -sims, owner))
    owner, ids, sims, fresh = owner[order], ids[order], sims[order], fresh[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = place < most
    return owner[keep], ids[keep], sims[keep], fresh[keep]


def _lists(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """Rows of ``LISTS`` from entries sorted by owner."""
    nodes, starts = np.unique(owner, return_index=True)
    packed = [_packed(np.split(x.astype(t), starts[1:]) if len(nodes) else []) for x, t in ((ids, "<i8"), (sims, "<f8"), (fresh, "u1"))]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *packed], names=["node", "ids", "sims", "fresh"])


def _flat(owner: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """New entries, a row for each."""
    columns = [pa.array(owner, pa.int64()), pa.array(ids, pa.int64()), pa.array(sims, pa.float64()), pa.array(np.ones(len(ids), bool))]
    return pa.RecordBatch.from_arrays(columns, names=["node", "nbr", "sim", "new"])


def _entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    parts = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("ids", "<i8"), ("sims", "<f8"), ("fresh", "u1"))]
    return np.repeat(table.column("node").to_numpy(), [len(x) for x in parts[0]]), *(np.concatenate(x) for x in parts)


def merge_lists(entries: DataFrame, most: int) -> DataFrame:
    """``node, nbr, sim, new`` of each node's ``most`` nearest. An entry that was known
    before stays known. Equal entries are one before they are ranked, and Spark
    cuts the ranks before it deals entries by node, so a node that very many
    others know does not gather all of them in one task."""
    each = entries.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return each.withColumn("r", rank).where(F.col("r") <= most).drop("r")


def dealt_leaves(small: DataFrame, trees: int, leaf: int, seed: int = 5) -> DataFrame:
    """``tree, key, node, q``: nodes in the leaves of random trees. While a
    leaf holds over ``leaf`` nodes, each of them goes with the nearest of
    ``PIVOTS`` of its members, chosen by a hash. Where that parts nothing (nodes
    of one direction), members go by hash alone."""
    tree = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(trees - 1).cast("long")))
    rows = small.select(tree.alias("tree"), F.lit(0).cast("long").alias("key"), "node", "q")
    done: list[DataFrame] = []
    level = 0

    def nearest_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, pivots = _unit(batch.column(3).to_pylist()), batch.column(4)
            counts = pivots.value_lengths().to_numpy()
            p = _unit(pivots.flatten().to_pylist())
            owner = np.repeat(np.arange(len(x)), counts)
            sims = np.round((x[owner] * p).sum(axis=1), 12)
            order = np.lexsort((-sims, owner))
            first = order[np.concatenate([[0], np.cumsum(counts)[:-1]])]
            turn = first - (np.cumsum(counts) - counts)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(turn, pa.int64())], names=["tree", "key", "node", "q", "turn"])

    while True:
        sizes = stored(rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
        large = sizes.where(F.col("n") > leaf)
        done.append(rows.join(large, ["tree", "key"], "left_anti"))
        if large.isEmpty():
            break
        rest = rows.join(large, ["tree", "key"])
        chance = F.row_number().over(Window.partitionBy("tree", "key").orderBy(F.xxhash64("node", F.col("tree") + seed * level), "node"))
        pivots = rest.withColumn("r", chance).where(F.col("r") <= PIVOTS).groupBy("tree", "key").agg(F.collect_list("q").alias("pivots"))
        split = rest.select("tree", "key", "node", "q").join(pivots, ["tree", "key"]).mapInArrow(nearest_pivot, "tree long, key long, node long, q binary, turn long")
        split = stored(split, "leaves")
        parts = split.groupBy("tree", "key").agg(F.count_distinct("turn").alias("parts"), F.count(F.lit(1)).alias("n"))
        by_hash = F.pmod(F.xxhash64("node", F.lit(level)), F.ceil(F.col("n") / leaf).cast("long"))
        turn = F.when(F.col("parts") > 1, F.col("turn")).otherwise(by_hash)
        rows = stored(split.join(parts, ["tree", "key"]).select("tree", F.xxhash64("tree", "key", turn).alias("key"), "node", "q"), "leaves")
        level += 1
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    return leaves


def first_lists(small: DataFrame, degree: int, trees: int, leaf: int, seed: int = 5) -> DataFrame:
    """Lists from the leaves of random trees. Nodes of leaves too small to fill
    a list also meet each other and ``ENTRIES`` random nodes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, 3):
            for a, b in _runs(table, 3):
                part = table.slice(a, b - a)
                x, ids = _unit(part.column("q").to_pylist()), part.column("node").to_numpy()
                k = min(degree, len(ids) - 1)
                if k < 1:
                    continue
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield _flat(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(sims, at, 1).ravel())

    leaves = stored(dealt_leaves(small, trees, leaf, seed), "leaves")
    least = leaves.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= degree).select("tree", "key")
    lone = stored(leaves.join(least, ["tree", "key"], "left_semi").select("node").distinct(), "lone")
    groups = max(1, -(-lone.count() // leaf))
    entries = small.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(ENTRIES)
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    meet = small.join(lone, "node", "left_semi").select(F.pmod(F.xxhash64("node"), F.lit(groups)).cast("long").alias("part"), "node", "q")
    meet = meet.unionByName(entries.select(part.alias("part"), "node", "q")).dropDuplicates(["part", "node"])
    split = leaves.select("tree", "key", F.lit(0).cast("long").alias("part"), "node", "q")
    split = split.unionByName(meet.select(F.lit(trees).cast("long").alias("tree"), F.lit(0).cast("long").alias("key"), "part", "node", "q"))
    met = split.repartition("tree", "key", "part").sortWithinPartitions("tree", "key", "part", "node").mapInArrow(compare, ENTRIES_OF)
    return merge_lists(met, degree)


def _edges(lists: DataFrame) -> DataFrame:
    """``node, nbr, sim, new``: a row for each entry."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, ids, sims, fresh = _entries(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(sims), pa.array(fresh > 0)], names=["node", "nbr", "sim", "new"])

    return lists.select("node", "ids", "sims", "fresh").mapInArrow(spread, "node long, nbr long, sim double, new boolean")


def descend(lists: DataFrame, small: DataFrame, degree: int, partners: int) -> DataFrame:
    """One round of NN-descent: a node's list members are compared with each
    other, unless both were in the list before, and pass on to each its nearest
    ``partners`` there that are nearer than the farthest it knows; lists then
    take these and reversed entries. Nodes with known members only are passed
    over before vectors are dealt to them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            x_all, ids_all, least_all = _unit(table.column("q").to_pylist()), table.column("nbr").to_numpy(), table.column("least").to_numpy()
            new_all = table.column("new").to_numpy()
            for a, b in _runs(table, 1):
                x, ids, least, new = x_all[a:b], ids_all[a:b], least_all[a:b], new_all[a:b]
                k = min(partners, len(ids) - 1)
                if k < 1:
                    continue
                sims = np.where(new[:, None] | new[None, :], x @ x.T, -3)
                np.fill_diagonal(sims, -3)
                at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(sims, at, 1)
                good = near > least[:, None]
                out.append((np.repeat(ids, good.sum(axis=1)), ids[at[good]], near[good]))
            if out:
                yield _flat(*(np.concatenate(c) for c in zip(*out, strict=True)))

    of_node = lists.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("m"), F.max("new").alias("any"))
    known = small.join(of_node, "node", "left")
    known = known.select(F.col("node").alias("nbr"), "q", F.when(F.col("n") >= degree, F.col("m")).otherwise(F.lit(-2.0)).alias("least"))
    active = lists.select("node", "nbr", "new").join(of_node.where("any").select("node"), "node", "left_semi")
    gathered = active.join(known, "nbr").select("node", "nbr", "least", "q", "new")
    found = gathered.repartition("node").sortWithinPartitions("node").mapInArrow(meet, ENTRIES_OF)
    before = lists.select("node", "nbr", "sim", F.lit(False).alias("new"))
    turned = lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", F.lit(True).alias("new"))
    return merge_lists(before.unionByName(found).unionByName(turned), degree)


def build_graph(small: DataFrame, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, partners: int = PARTNERS, settled: float = SETTLED) -> DataFrame:
    """``node, nbr, sim, new``: the nearest ``degree`` neighbours found of each
    node. Rounds go on, at every size, until at most ``settled`` of all entries
    are new; the sum of similarities only rises, so they end."""
    lists = stored(first_lists(small, degree, trees, leaf), "graph")
    while True:
        lists = stored(descend(lists, small, degree, partners), "graph")
        made, entries = lists.agg(F.count_if("new"), F.count(F.lit(1))).first()
        if made <= settled * entries:
            return lists


def search_graph(lists: DataFrame, small: DataFrame, starts: DataFrame, beam: int = BEAM, pool: int = POOL) -> DataFrame:
    """``node, ids, sims``: the best ``pool`` found from each start node.

    A round expands those of each query's ``beam`` best nodes that are not yet
    expanded, all queries side by side; it ends when no query has any.
    """
    near = lists.join(small.withColumnRenamed("node", "nbr"), "nbr").select("node", "nbr", "q")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            ids, q = table.column("nbr").to_numpy().astype("<i8"), table.column("q").to_pylist()
            runs = _runs(table, 1)
            yield pa.RecordBatch.from_arrays([pa.array([table.column("node")[a].as_py() for a, _ in runs], pa.int64()), _packed([ids[a:b] for a, b in runs]), pa.array([b"".join(q[a:b]) for a, b in runs], pa.binary())], names=["at", "nbrs", "qs"])

    table = stored(near.repartition("node").sortWithinPartitions("node").mapInArrow(gather, "at long, nbrs binary, qs binary"), "adjacency")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for q, nbrs, qs in zip(batch.column("q").to_pylist(), batch.column("nbrs").to_pylist(), batch.column("qs").to_pylist(), strict=True):
                n = len(nbrs) // 8
                sims.append((_unit([qs[k * len(q) : (k + 1) * len(q)] for k in range(n)]) @ _unit([q])[0]).astype("<f8"))
            none = pa.array([b""] * len(sims), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("nbrs"), _packed(sims), _packed([np.ones(len(x), "u1") for x in sims]), none], names=["node", "ids", "sims", "fresh", "done"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches):
            owner, ids, sims, fresh = _entries(table)
            done = [np.frombuffer(x, "<i8") for x in table.column("done").to_pylist()]
            expanded = {}
            for node, d in zip(table.column("node").to_pylist(), done, strict=True):
                if len(d):
                    expanded[node] = d
            owner, ids, sims, _ = _best(owner, ids, sims, fresh, pool)
            nodes, at = np.unique(owner, return_index=True)
            rows = []
            for node, a, b in zip(nodes.tolist(), at, [*at[1:], len(owner)], strict=True):
                before = expanded.get(node, np.zeros(0, "<i8"))
                ahead = ids[a:b][:beam]
                ahead = ahead[~np.isin(ahead, before)]
                rows.append((node, ids[a:b].astype("<i8").tobytes(), sims[a:b].astype("<f8").tobytes(), bytes(int(b - a)), np.concatenate([before, ahead]).astype("<i8").tobytes(), ahead.tolist()))
            cols = [*zip(*rows, strict=True)]
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["node", "ids", "sims", "fresh", "done", "next"])

    empty = F.lit(b"")
    state = _start(starts).withColumn("done", empty)
    queries = stored(small.join(starts, "node", "left_semi"), "query-vectors")
    while True:
        state = stored(state.repartition("node").sortWithinPartitions("node").mapInArrow(advance, LISTS + ", done binary, next array<long>"), "search")
        steps = state.select("node", F.explode("next").alias("at"))
        if steps.isEmpty():
            return state.select("node", "ids", "sims", "fresh")
        ahead = small_table(steps.join(queries, "node")).join(table, "at")
        found = ahead.select("node", "q", "nbrs", "qs").mapInArrow(measure, LISTS + ", done binary")
        state = state.drop("next").unionByName(found)


def _start(starts: DataFrame) -> DataFrame:
    """The first state: each query's pool holds its own node."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy()
            if len(node):
                yield _lists(*(x[np.argsort(node)] for x in (node, node, np.ones(len(node)), np.zeros(len(node)))))

    return starts.select("node").mapInArrow(pack, LISTS)


def nearest(table: DataFrame, is_query: Callable[[str], object], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", **search: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query its k nearest found.

    ``is_query`` makes the condition on the id column that marks queries.
    Vectors without direction take no part (``valid_vectors``). A query's own
    row is no candidate; rows with an equal vector are. Ties go to the
    smaller id; an empty table gives an empty result. Queries with fewer than k
    results are compared with all vectors.
    """
    vectors = stored(valid_vectors(table, id_col, vec_col), "vectors")
    nodes = stored(nodes_of(vectors, k + 1), "nodes")
    small = stored(_small_vectors(nodes), "small")
    queries = vectors.where(is_query("vec_id")).join(nodes.select("node", "v"), "v").select(F.col("vec_id").alias("query_id"), "node", F.col("v").alias("qv"))
    queries = stored(queries, "queries")
    with arrow_batches(table.sparkSession):
        lists = build_graph(small)
        found = stored(search_graph(lists, small, queries.select("node").distinct(), **search), "found")
    of_node = Window.partitionBy("node")
    best = _edges(found).withColumn("r", F.row_number().over(of_node.orderBy(F.desc("sim"), "nbr")))
    limit = F.max(F.when(F.col("r") == k + 1, F.col("sim"))).over(of_node) - ROUNDING
    best = best.withColumn("limit", limit).where((F.col("r") <= RERANK) | (F.col("sim") >= F.col("limit")))
    pairs = queries.join(best.select("node", "nbr"), "node").join(nodes.select(F.col("node").alias("nbr"), "members", "v"), "nbr")

    def dot(a: str, b: str) -> object:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    score = dot("qv", "v") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("v", "v")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def first(pairs: DataFrame) -> DataFrame:
        each = pairs.select("query_id", score.alias("score"), F.explode("members").alias("vec_id")).where("vec_id <> query_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    answers = stored(first(pairs), "answers")
    full = answers.where(F.col("rank") == k).select("query_id")
    short = stored(queries.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return answers
    out = answers.join(full, "query_id", "left_semi")
    for block in broadcast_blocks(short, "query_id"):  # the stated queries against all rows
        out = out.unionByName(first(nodes.select("members", "v").join(block, F.lit(True))))
    return out


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector of ``embeddings``; null, zero
    and non-finite vectors take no part, for repeats, ties and empty tables see
    ``nearest``."""
    return nearest(read_table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 50 == 0)
