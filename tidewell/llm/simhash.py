"""SimHash near-duplicates with bit-sliced comparison.

Candidates come from the pigeonhole principle: of four 16-bit blocks of two
fingerprints that differ in two bits at most, two blocks are equal. Each
fingerprint is dealt to six groups, one for each pair of blocks. A group is
compared exactly: its fingerprints stand as 64 bit planes, a machine word
holds one bit of 64 of them, and carry-save counters take all distances of a
word at once; words whose 64 distances all exceed the radius are abandoned.
Groups over ``HOT`` rows are dealt once more by the 32 bits left, after which
no group can hold over 65,536 different fingerprints.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm._shared import cut, read_table, small, stored

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
HOT = 4096
HOT_TEXTS = 8192  # sets compared in one task by fingerprint
CELL_SHINGLES = 1 << 20  # in each of the two parts that a task compares exactly
CELL_SETS = 1024  # in each of these parts
LEADERS = 16  # of a cluster, asked in one round
PAIRS = list(combinations(range(4), 2))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BAND = 4


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles of a whole text, as a signed long.

    Only A-Z are lower-cased; words are runs of other than ASCII white space;
    repeated shingles count each time. A text of fewer words is one shingle;
    a text without words (or null) has fingerprint 0.
    """
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(parts) - k + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        block = h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp`` of each row; only doc_id and text are read."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fp], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(compute, "doc_id long, text_hash long, fp long")


def _bits(fp: Column, block: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, block * width).bitwiseAND(F.lit((1 << width) - 1))


def _pair_key(value: Column, pair: tuple[int, int], width: int) -> Column:
    return F.shiftleft(_bits(value, pair[0], width), width).bitwiseOR(_bits(value, pair[1], width))


def candidate_groups(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``t, k1, k2, fp``: distinct fingerprints dealt to their groups."""
    fp = F.col("fp")
    first = F.array(*[F.struct(F.lit(i).alias("t"), _pair_key(fp, p, 16).alias("k1")) for i, p in enumerate(PAIRS)])
    dealt = fps.select("fp", F.explode(first).alias("g")).select("fp", "g.t", "g.k1")
    large = dealt.groupBy("t", "k1").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).drop("n")
    large = cut(large)
    if large.isEmpty():
        return dealt.select("t", "k1", F.lit(0).cast("long").alias("k2"), "fp")
    plain = dealt.join(large, ["t", "k1"], "left_anti").select("t", "k1", F.lit(0).cast("long").alias("k2"), "fp")
    rest = F.lit(None).cast("long")
    for i, (a, b) in enumerate(PAIRS):
        c, d = (x for x in range(4) if x not in (a, b))
        rest = F.when(F.col("t") == i, _pair_key(fp, (c, d), 16)).otherwise(rest)
    again = F.array(*[F.struct(F.lit(i).alias("s"), _pair_key(F.col("rest"), p, 8).alias("k2")) for i, p in enumerate(PAIRS)])
    deep = (
        dealt.join(large, ["t", "k1"], "left_semi")
        .withColumn("rest", rest)
        .select("t", "k1", "fp", F.explode(again).alias("g"))
        .select((F.col("t") * 10 + 100 + F.col("g.s")).alias("t"), "k1", "g.k2", "fp")
    )
    return plain.unionByName(deep)


def sliced_hits(planes: np.ndarray, fp: np.ndarray, block: np.ndarray, valid: np.ndarray, radius: int = 2) -> np.ndarray:
    """For each item, a word of which of a block's 64 fingerprints lie within
    ``radius`` of ``fp``. ``planes[p, b]`` is bit p of block b's fingerprints.

    The counters start so that a distance over the radius runs over their top
    bit, which is kept.
    """
    width = max(1, int(radius).bit_length())
    bias = (1 << width) - 1 - radius
    out = np.zeros(len(fp), np.uint64)
    items, over = np.arange(len(fp)), np.zeros(len(fp), np.uint64)
    counters = [np.full(len(fp), ALL if bias >> k & 1 else np.uint64(0)) for k in range(width)]
    for p in range(64):
        carry = planes[p][block] ^ (np.uint64(0) - ((fp >> np.uint64(p)) & np.uint64(1)))
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry
        if p % 8 == 7:
            left = ~over & valid
            if p == 63:
                out[items] = left
                break
            keep = np.flatnonzero(left)
            if len(keep) < 0.7 * len(items):  # blocks without a fingerprint in reach are abandoned
                items, block, fp, valid, over = (x[keep] for x in (items, block, fp, valid, over))
                counters = [c[keep] for c in counters]
    return out


def bit_planes(values: np.ndarray, lane: np.ndarray, head: np.ndarray) -> np.ndarray:
    """``planes[p, b]``: bit p of the values of block b, which starts at row
    ``head[b]``; each value stands at its lane of the word."""
    if not len(head):
        return np.zeros((64, 0), np.uint64)
    return np.stack([np.bitwise_or.reduceat(((values >> np.uint64(p)) & np.uint64(1)) << lane, head) for p in range(64)])


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of each pair; a label is the class's smallest row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def link_groups(fp: np.ndarray, group: np.ndarray, radius: int = 2) -> np.ndarray:
    """Rows sorted by group; for each row the first row that it is linked to,
    through rows of its group, or itself."""
    n = len(fp)
    label = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    start_of, size_of = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    rows = np.flatnonzero(size_of > 1)
    if not len(rows):
        return label
    within = rows - start_of[rows]
    head = np.flatnonzero(within % 64 == 0)  # first rows of blocks
    block = np.cumsum(within % 64 == 0) - 1
    lane = (within % 64).astype(np.uint64)
    filled = np.diff(np.append(head, len(rows))).astype(np.uint64)
    full = np.where(filled == 64, ALL, (np.uint64(1) << (filled % np.uint64(64))) - np.uint64(1))
    values = fp[rows]
    planes = bit_planes(values, lane, head)
    last = block - within // 64 + (size_of[rows] - 1) // 64
    todo = last - block + 1
    ends = np.cumsum(todo)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 65536, "right")))
        n_items = todo[at:stop]
        q = np.repeat(np.arange(at, stop), n_items)
        b = block[q] + np.arange(len(q)) - np.repeat(np.cumsum(n_items) - n_items, n_items)
        later = np.where(lane[q] == 63, np.uint64(0), ALL << ((lane[q] + np.uint64(1)) % np.uint64(64)))
        valid = full[b] & np.where(b == block[q], later, ALL)
        hits = sliced_hits(planes, values[q], b, valid, radius)
        found = np.flatnonzero(hits)
        for k in range(64) if len(found) else ():
            hit = found[(hits[found] >> np.uint64(k)) & np.uint64(1) == 1]
            if len(hit):
                label = _unite(label, rows[q[hit]], rows[head[b[hit]] + k])
        at = stop
    return label


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of sorted groups, as (first, other); the last, perhaps open group
    of a batch waits for the next one."""
    kept: list[np.ndarray] | None = None

    def links(cols: list[np.ndarray]) -> pa.RecordBatch:
        t, k1, k2, fp = cols
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        label = link_groups(fp.astype(np.uint64), np.cumsum(new))
        rows = np.flatnonzero(label != np.arange(len(label)))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[rows]]), pa.array(fp[rows])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        same = np.logical_and.reduce([c == c[-1] for c in cols[:3]])
        first = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        kept = [c[first:] for c in cols]
        if first:
            yield links([c[:first] for c in cols])
    if kept is not None:
        yield links(kept)


def near_links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, b``: links between different fingerprints, enough to connect all
    that lie within two bits of each other (a spanning forest per group)."""
    groups = candidate_groups(fps, hot).select(F.col("t").cast("long").alias("t"), "k1", "k2", "fp")
    return groups.repartition("t", "k1", "k2").sortWithinPartitions("t", "k1", "k2").mapInArrow(_link, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node: large-star and small-star rounds,
    each checkpointed, until nothing changes. Roots are smallest nodes."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            break
        seen = state
        both = edges.union(edges.select("b", "a"))  # large star: link greater neighbours to the least
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))  # small star: and the smaller ones
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = cut(small.select("e.a", "e.b").where("a <> b").distinct())
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, hot: int = HOT) -> DataFrame:
    """``doc_id, text_hash, fp, component_id`` per row of ``doc_id, text``.

    Rows with equal fingerprints, or linked through fingerprints that differ
    in two bits at most, form a component; its id is the smallest doc_id in
    it (null if all are null). Texts without words, null or empty, share
    fingerprint 0. Rows with the same id stay separate rows.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = cut(connected(near_links(fps.select("fp"), hot)))
    member = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = member.join(least, "root").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "text_hash", "fp", "component_id")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted different hashes of a text's word shingles; none without words."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, len(parts) - k + 1))


@functools.cache
def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """A random xor and a random odd factor for each of ``n`` least hashes."""
    x, factors = np.random.default_rng(2).integers(0, 2**64, (2, n), np.uint64, endpoint=False)
    return x[:, None], factors[:, None] | np.uint64(1)


def least_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The least of ``h`` under ``n`` mixings that don't depend on each other."""
    xors, factors = _seeds(n)
    least = np.full(n, ALL)
    for at in range(0, len(h), 4096):
        mixed = (h[None, at : at + 4096] ^ xors) * factors
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        np.minimum(least, mixed.min(axis=1), out=least)
    return least


def band_keys(h: np.ndarray, bands: int) -> np.ndarray:
    """One key for each band of ``BAND`` least hashes."""
    return (least_hashes(h, BAND * bands).reshape(bands, BAND) * _seeds(BAND)[1].T).sum(axis=1, dtype=np.uint64)


def _signature(text: str | None, words: int, bands: int) -> tuple[int, int, int, list[int]]:
    """Hash, SimHash, size and band keys of a text's set of shingles; no keys
    without words: all such texts have the one empty set."""
    h = shingle_hashes(text, words)
    node = xxhash.xxh64_intdigest(h.astype("<u8").tobytes(), 42)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0])
    keys = band_keys(h, bands).astype(np.int64).tolist() if len(h) else []
    return node - (1 << 64 if node >> 63 else 0), fp, len(h), keys


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal first ``n_keys`` columns) of sorted
    batches, with each row's group number; the last, perhaps open group of a
    batch waits for the next one."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if kept is None else pa.concat_tables([kept, table])
        keys = [table.column(k).to_numpy() for k in range(n_keys)]
        new = np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
        last = int(np.flatnonzero(new)[-1])
        kept = table.slice(last)
        if last:
            yield table.slice(0, last), np.cumsum(new[:last])
    if kept is not None:
        yield kept, np.ones(kept.num_rows, np.int64)


def _clusters(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """``band, key, cell, lead, node, size``: of the sorted groups ``band, key,
    cell`` those rows that lie within ``radius`` bits of others, with the first
    row that they are linked to."""
    for table, group in _whole_groups(batches, 3):
        node, fp = (table.column(k).to_numpy() for k in ("node", "fp"))
        label = link_groups(fp.astype(np.uint64), group, radius)
        linked = label != np.arange(len(label))
        linked[label[linked]] = True
        rows = np.flatnonzero(linked)
        if len(rows):
            lead = pa.array(node[label[rows]], pa.int64())
            picked = table.select(["band", "key", "cell", "node", "size"]).take(pa.array(rows)).combine_chunks()
            band, key, cell, node, size = (c.chunk(0) for c in picked.columns)
            yield pa.RecordBatch.from_arrays([band, key, cell, lead, node, size], names=["band", "key", "cell", "lead", "node", "size"])


def alike_rows(values: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """For each of some sets (``values`` one after another, by ``sizes``) the
    first one that it is linked to by a Jaccard similarity of ``similarity`` or
    more, through others, or itself. Common elements are counted along the
    postings of each element, some rows at a time."""
    n, owner = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    new = np.concatenate([[True], values[order][1:] != values[order][:-1]]) if len(values) else np.zeros(0, bool)
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    posted, held = owner[order], np.diff(np.append(starts, len(values)))
    work = np.cumsum(held[number]) if len(values) else np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    done = np.concatenate([[0], work])[np.concatenate([[0], ends])]  # postings read up to each row
    label, at = np.arange(n), 0
    while at < n:
        stop = max(at + 1, min(n, at + max(1, (1 << 22) // n), int(np.searchsorted(done, done[at] + (1 << 21), "right")) - 1))
        mine = slice(ends[at] - sizes[at], ends[stop - 1])
        count = held[number[mine]]
        posting = np.arange(count.sum()) + np.repeat(starts[number[mine]] - np.cumsum(count) + count, count)
        common = np.bincount(np.repeat(owner[mine] - at, count) * n + posted[posting], minlength=(stop - at) * n).reshape(-1, n)
        a, b = np.nonzero(common)
        same = common[a, b]
        good = (same / (sizes[a + at] + sizes[b] - same) >= similarity) & (b > a + at)
        label = _unite(label, a[good] + at, b[good])
        at = stop
    return label


def _alike(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``a, b``: links of the sorted groups ``cluster, cell`` of whole sets."""
    for table, group in _whole_groups(batches, 2):
        node = table.column("node").to_numpy()
        sets = table.column("shingles").combine_chunks()
        values, sizes = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group))
        found_a, found_b = [], []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            label = alike_rows(values[begin[a] : begin[b]], sizes[a:b], similarity)
            rows = np.flatnonzero(label != np.arange(b - a))
            found_a.append(node[a + label[rows]])
            found_b.append(node[a + rows])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (found_a, found_b)], names=["a", "b"])


def _cells(parts: Column, node: Column) -> Column:
    """The cells of a row of a group that is cut into ``parts`` by a hash of
    ``node``: each two parts meet in a cell of their own, so all pairs of the
    group still meet."""
    mine = F.pmod(F.xxhash64(node), parts)
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: F.least(mine, other) * parts + F.greatest(mine, other))


def band_groups(nodes: DataFrame, hot: int = HOT_TEXTS) -> DataFrame:
    """``band, key, cell, node, fp, size``: sets dealt to a group for each of
    their keys; groups over ``hot`` sets are cut into cells."""
    dealt = nodes.select(F.posexplode("keys").alias("band", "key"), "node", "fp", "size")
    large = cut(dealt.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    if large.isEmpty():
        return dealt.select("band", "key", F.lit(0).cast("long").alias("cell"), "node", "fp", "size")
    rows = dealt.join(large, ["band", "key"], "left")
    parts = F.coalesce(F.ceil(F.col("n") / hot), F.lit(1)).cast("long")
    return rows.select("band", "key", F.explode(_cells(parts, F.col("node"))).alias("cell"), "node", "fp", "size")


def candidate_clusters(nodes: DataFrame, radius: int, hot: int = HOT_TEXTS, most: int = CELL_SHINGLES) -> DataFrame:
    """``cluster, node, parts``: sets that agree in a key and hang together by
    fingerprints within ``radius`` bits. Of clusters with the same members one
    is left. ``parts`` says into how many parts the cluster is to be cut, so
    that none has much over ``most`` shingles or an eighth of ``hot`` sets."""
    found = (
        band_groups(nodes, hot)
        .repartition("band", "key", "cell")
        .sortWithinPartitions("band", "key", "cell", "node")
        .mapInArrow(lambda batches: _clusters(batches, radius), "band int, key long, cell long, lead long, node long, size long")
    )
    found = stored(found.select(F.xxhash64("band", "key", "cell", "lead").alias("cluster"), "node", "size"), "clusters")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), F.col("node"))).alias(f"mark{k}") for k in (1, 2)]
    each = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), *marks)
    one = each.groupBy("n", "shingles", "mark1", "mark2").agg(F.min("cluster").alias("cluster"))
    parts = F.greatest(F.ceil(F.col("shingles") / most), F.ceil(F.col("n") * 8 / hot)).cast("long")
    return found.join(one.select("cluster", parts.alias("parts")), "cluster").select("cluster", "node", "parts")


def _joining(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``cluster, node, leader``: of the sorted groups ``cluster, part`` each
    row's first leader (by ``place``, null for other rows) that is alike, or
    none. Leaders come first in their group."""
    for table, group in _whole_groups(batches, 2):
        cluster, node = (table.column(k).to_numpy() for k in ("cluster", "node"))
        place = table.column("place").to_pylist()
        sets = table.column("shingles").combine_chunks()
        values, sizes = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.append(np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), len(group)).tolist()
        leader: list[int | None] = [None] * len(node)
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            asked = np.arange(first, last)
            for k in range(first, last):
                if place[k] is None or not len(asked):
                    break
                own = values[begin[k] : begin[k + 1]]
                spans = np.arange(sizes[asked].sum()) + np.repeat(begin[asked] - np.cumsum(sizes[asked]) + sizes[asked], sizes[asked])
                at = np.minimum(np.searchsorted(own, values[spans]), len(own) - 1)
                owner = np.repeat(np.arange(len(asked)), sizes[asked])
                common = np.bincount(owner, own[at] == values[spans], len(asked))
                alike = common / (len(own) + sizes[asked] - common) >= similarity
                for row in asked[alike].tolist():
                    leader[row] = int(node[k])
                asked = asked[~alike]
        mine = [k for k in range(len(node)) if place[k] is None]
        yield pa.RecordBatch.from_arrays([pa.array(cluster[mine], pa.int64()), pa.array(node[mine], pa.int64()), pa.array([leader[k] for k in mine], pa.int64())], names=["cluster", "node", "leader"])


def join_leaders(sets: DataFrame, similarity: float) -> DataFrame:
    """``cluster, node, leader`` of all rows of ``sets`` (``cluster, node,
    shingles, parts``): a class of each cluster are the sets that are alike to
    one leader.

    Each round every set without a class meets ``LEADERS`` of those, chosen by
    a hash, and joins the first that it is alike to; a leader at least joins
    itself or an earlier one. Sets travel once a round, leaders once a part.
    Rounds end when a tenth or less of the asked found a class; the rest have
    none (null).
    """
    classes, rest = None, sets
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    asked = rest.count()
    while asked:
        turn = F.row_number().over(Window.partitionBy("cluster").orderBy(F.xxhash64("node", F.lit(asked)), "node"))
        leaders = rest.withColumn("place", turn).where(F.col("place") <= LEADERS)
        leaders = leaders.select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "place", "node", "shingles")
        both = leaders.unionByName(rest.select("cluster", part.alias("part"), F.lit(None).cast("int").alias("place"), "node", "shingles"))
        met = both.repartition("cluster", "part").sortWithinPartitions("cluster", "part", F.asc_nulls_last("place"), "node")
        met = stored(met.mapInArrow(lambda batches: _joining(batches, similarity), "cluster long, node long, leader long"), "classes")
        new = met.where("leader IS NOT NULL")
        classes = new if classes is None else classes.unionByName(new)
        left = met.where("leader IS NULL").select("cluster", "node")
        before, asked = asked, left.count()
        if before - asked <= before / 10:
            return classes.unionByName(met.where("leader IS NULL"))
        rest = sets.join(left, ["cluster", "node"])
    return classes if classes is not None else sets.select("cluster", "node", F.lit(None).cast("long").alias("leader"))


def _near_leaders(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """``cluster, a, b``: pairs of a cluster's leaders, a before b, whose
    classes may hold alike sets: by the triangle inequality of the Jaccard
    distance, leaders no farther apart than three times the greatest distance."""
    least = 1 - 3 * (1 - similarity) - 1e-9
    for table, group in _whole_groups(batches, 1):
        cluster, node = (table.column(k).to_numpy() for k in ("cluster", "node"))
        sets = [np.asarray(x) for x in table.column("shingles").to_pylist()]
        found = []
        for b in range(len(node)):
            for a in range(b - 1, -1, -1):
                if group[a] != group[b]:
                    break
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common / (len(sets[a]) + len(sets[b]) - common) >= least:
                    found.append((cluster[a], *sorted((int(node[a]), int(node[b])))))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["cluster", "a", "b"])


def class_cells(sets: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """``cluster, cell, node``: where the sets of large clusters still meet.

    Sets of one class hang together by their leader and need not meet. Parts of
    two classes meet if their leaders are near enough; the sets without a class
    meet all classes and each other. So with one class that holds nearly all,
    its sets travel once for each part of the few others.
    """
    rows = classes.select("cluster", "node", F.coalesce("leader", F.lit(0).cast("long")).alias("leader"), F.col("leader").isNull().alias("lone"))
    held = rows.join(sets.select("cluster", "node", F.size("shingles").alias("size")), ["cluster", "node"])
    kinds = held.groupBy("cluster", "leader", "lone").agg(F.greatest(F.ceil(F.count("*") / CELL_SETS), F.ceil(F.sum("size") / CELL_SHINGLES)).cast("long").alias("parts"))
    kinds = stored(kinds, "class-parts")
    heads = sets.join(kinds.where("NOT lone").select("cluster", F.col("leader").alias("node")), ["cluster", "node"]).select("cluster", "node", "shingles")
    near = heads.repartition("cluster").sortWithinPartitions("cluster", "node").mapInArrow(lambda batches: _near_leaders(batches, similarity), "cluster long, a long, b long")
    near = near.select("cluster", "a", F.lit(False).alias("a_lone"), "b", F.lit(False).alias("b_lone"))
    lone = kinds.where("lone").select("cluster")
    with_lone = kinds.join(lone, "cluster").select("cluster", F.lit(0).cast("long").alias("a"), F.lit(True).alias("a_lone"), F.col("leader").alias("b"), F.col("lone").alias("b_lone"))
    pairs = near.unionByName(with_lone)
    # Either side of a pair goes to all parts of the other side.
    sides = []
    for x, y, first in (("a", "b", True), ("b", "a", False)):
        other = kinds.select("cluster", F.col("leader").alias(y), F.col("lone").alias(f"{y}_lone"), F.col("parts").alias("others"))
        own = kinds.select("cluster", F.col("leader").alias(x), F.col("lone").alias(f"{x}_lone"), "parts")
        sides.append(pairs.join(other, ["cluster", y, f"{y}_lone"]).join(own, ["cluster", x, f"{x}_lone"]).select("cluster", F.col(x).alias("leader"), F.col(f"{x}_lone").alias("lone"), "a", "a_lone", "b", "b_lone", "parts", "others", F.lit(first).alias("first")))
    dealt = rows.join(small(stored(sides[0].unionByName(sides[1]), "class-pairs")), ["cluster", "leader", "lone"])
    mine = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts"))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    within = F.col("a_lone") & F.col("b_lone")  # parts of one kind: the smaller number first
    i = F.when(within, F.least("mine", "other")).when(F.col("first"), F.col("mine")).otherwise(F.col("other"))
    j = F.when(within, F.greatest("mine", "other")).when(F.col("first"), F.col("other")).otherwise(F.col("mine"))
    return dealt.select("cluster", F.xxhash64("a", "a_lone", "b", "b_lone", i, j).alias("cell"), "node").distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, hot: int = HOT_TEXTS, most: int = CELL_SHINGLES) -> DataFrame:
    """``a, b``: links that connect all candidates whose whole shingle sets
    are alike: a spanning forest for each cluster or cell, and in clusters of
    several parts each set with its class's leader. A set is made again from
    one row of its texts, so copies of a text don't travel."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shingle_hashes(t, words).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["node", "shingles"])

    members = stored(candidate_clusters(nodes, radius, hot, most), "members")

    def whole(rows: DataFrame) -> DataFrame:
        wanted = rows.select("node").distinct().join(nodes, "node").select("node", F.col("one.doc_id").alias("one_id"), F.col("one.text_hash").alias("one_hash"))
        on = texts["doc_id"].eqNullSafe(wanted["one_id"]) & (texts["text_hash"] == wanted["one_hash"])
        chosen = texts.join(wanted, on).select("node", "text").mapInArrow(sets, "node long, shingles array<long>")
        return rows.join(chosen.dropDuplicates(["node"]), "node")

    def linked(cells: DataFrame) -> DataFrame:
        return cells.repartition("cluster", "cell").sortWithinPartitions("cluster", "cell").mapInArrow(lambda batches: _alike(batches, similarity), "a long, b long")

    one_part = whole(members.where("parts = 1")).select("cluster", F.lit(0).cast("long").alias("cell"), "node", "shingles")
    links = linked(one_part)
    large = members.where("parts > 1")
    if large.isEmpty():
        return links
    # Sets are sorted as signed numbers from here on.
    held = stored(whole(large).select("cluster", "node", "parts", F.array_sort("shingles").alias("shingles")), "large-sets")
    classes = stored(join_leaders(held, similarity), "joined")
    links = links.unionByName(classes.where("leader IS NOT NULL AND leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")))
    cells = class_cells(held, classes, similarity).join(held.select("cluster", "node", "shingles"), ["cluster", "node"])
    return links.unionByName(linked(cells.select("cluster", "cell", "node", "shingles")))


def similar_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 16, radius: int = 24, hot: int = HOT_TEXTS, most: int = CELL_SHINGLES) -> DataFrame:
    """``doc_id, text_hash, component_id``: rows joined by texts whose sets of
    word shingles have a Jaccard similarity of ``similarity`` or more.

    Texts with equal sets are one node. A similarity of 0.8 lets SimHash
    fingerprints differ in some 15 of 64 bits, too many for keys made of their
    bits. Candidates agree in one of ``bands`` keys of four least hashes (of
    160,000 random pairs at 0.8, 37 had no common key: 0.0002); within these
    groups fingerprints are compared bit-sliced, and what hangs together is
    compared exactly, in the same task, on the whole sets: no pairs leave a
    task, only the links that connect it.

    Texts without words, null or empty, are alike; repeated rows stay rows;
    null doc_ids count for a component's id only where all are null; an empty
    table gives an empty result. Columns other than doc_id and text are not
    read.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signature(t, words, bands) for t in batch.column(2).to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["doc_id", "text_hash", "node", "fp", "size", "keys"])

    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    rows = stored(texts.mapInArrow(sign, "doc_id long, text_hash long, node long, fp long, size long, keys array<long>"), "signatures")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.max("keys").alias("keys"))
    nodes = stored(nodes, "sets")
    links = stored(similar_links(nodes, texts, words, similarity, radius, hot, most), "links")
    roots = cut(connected(links)).withColumnRenamed("node", "linked")
    member = nodes.join(roots, nodes.node == roots.linked, "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    least = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = member.join(least, "root").select("node", "component_id")
    return rows.select("doc_id", "text_hash", "node").join(classes, "node").select("doc_id", "text_hash", "component_id")


def keep_representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs`` that represent their component of similar texts: the
    one with the smallest doc_id (null only where all are null); of rows that
    repeat this id, the one with the smallest hash of its text, then the first
    by its JSON form. Other columns pass through, whatever their names."""
    found = similar_texts(docs, words, similarity)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.groupBy("doc_id").agg(F.min(F.struct("text_hash", "n")).alias("one")).select(F.col("doc_id").alias("kept_id"), F.col("one.text_hash").alias("kept_hash"), F.col("one.n").alias("copies"))
    kept = stored(kept, "kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["kept_id"]) & (rows["hash"] == kept["kept_hash"]))
    alone = rows.where("copies = 1").select("row.*")
    if kept.where("copies > 1").isEmpty():
        return alone
    first = rows.where("copies > 1").groupBy("id", "hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return alone.unionByName(first.select("row.*"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all of ``documents``; for nulls, empty
    texts, repeats, ties and empty tables see ``near_duplicates``."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
