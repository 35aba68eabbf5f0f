"""Exact n-gram Jaccard self-join with a count-vector R-tree.

A document is the set of its distinct 5-word shingles, hashed. Shingles are dealt into groups by their hash; the counts of
the groups are a point, and the overlap of two documents is at most the sum over groups of the smaller count. Points that
may link are found in R-trees: leaves of neighbouring points with the largest count of each group, so that a whole leaf is
passed over when even its bound falls short. Pairs that the bound can't exclude are verified on the shingle sets.

One R-tree of everything would not fit a machine, so points meet in blocks: two sets with a Jaccard similarity of at least
`num / den` share a shingle among the first n - ceil(n * num / den) + 1 of each in any one order of all shingles. The order
puts shingles that many documents share last (by counts over all documents), so that common passages don't make large
blocks. The order decides the speed only; the result is exact for the hashed sets (48 bits a shingle: two documents of
400 shingles get a false common one with a chance below one in a thousand million).

Equal sets are one node from the start. Inside a block and inside a group of possible links only as many pairs are looked
at as it takes to connect it; no task emits pairs, only trees. Large blocks are dealt to tasks in pairs of parts.

Edge cases: null or empty texts and texts without words have no shingle and are components of their own. Fewer than five
words are one shingle. Null doc_ids don't name components: they belong to the smallest doc_id linked with them, or null.
Rows with equal doc_id and different texts are different nodes. Empty tables give an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_memory, regrouped, settled, slices, small_batches, tables_written, trim
from .components import components

SHINGLE = 5
#: Shingles whose place in the order is known to all tasks (16 bytes each).
COMMON = 500_000
#: Pairs of a shingle and a node that a task sorts at once (16 bytes each), about.
SHARD_PAIRS = 1_000_000
#: Points of a block, or sets of a group, that one task takes at once.
PART = 1024
LEAF = 32
#: Nodes with a possible link, broadcast to the scan of the sets up to this number.
BROADCAST_NODES = 1_000_000
_MULS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]


class _Words(dict):
    """Hash of each word; forgets all when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: bytes | None, words: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 48-bit hashes of the shingles of a text in UTF-8."""
    split = (text or b"").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.array([words[w] for w in split], np.uint64)
    size = min(SHINGLE, len(h))
    count = len(h) - size + 1
    s = np.full(count, size, np.uint64)
    for j in range(size):
        s += h[j : j + count] * np.uint64(_MULS[j])
    s ^= s >> np.uint64(29)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(32)
    return np.unique(s >> np.uint64(16))


def groups_for(n: int) -> int:
    """Number of groups for a set of n shingles: enough that unrelated sets differ by more than the bound allows."""
    return 64 if n < 400 else 256 if n < 2000 else 1024 if n < 16_000 else 4096


def count_vector(shingles: np.ndarray) -> np.ndarray:
    g = groups_for(len(shingles))
    return np.bincount((shingles & np.uint64(g - 1)).astype(np.int64), minlength=g).astype(np.uint16)


def squeeze(shingles: np.ndarray) -> bytes:
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def expand(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1).astype(np.uint64)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, node (64-bit hash of the set; null if empty), n, shingles, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        own_memory("shingles")
        words = _Words()
        for batch in batches:
            for part in slices(batch, "text", 500, 4 << 20):
                nodes, sizes, blobs, vectors = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingle_hashes(text, words)
                    blob = squeeze(s)
                    h = xxhash.xxh3_64_intdigest(blob)
                    nodes.append((h - (1 << 64) if h >> 63 else h) if len(s) else None)
                    sizes.append(len(s))
                    blobs.append(blob)
                    vectors.append(count_vector(s).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary()), pa.array(vectors, pa.binary())], ["doc_id", "node", "n", "shingles", "vector"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, node long, n long, shingles binary, vector binary")


def _distinct_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each node of a batch, without those of empty sets."""
    batch = batch.filter(pa.compute.is_valid(batch.column("node")))
    _, at = np.unique(batch.column("node").to_numpy(), return_index=True)
    return batch.take(pa.array(at))


def common_shingles(sets: DataFrame, at_least: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON shingles of the highest counts, sorted by shingle, and their counts. Counted over all documents; within
    a batch of documents those that occur less than at_least times are left out, which a common one doesn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("common shingles")
        for part in regrouped(batches, "shingles", 4000, 8 << 20):
            values, counts = np.unique(expand(b"".join(_distinct_rows(part).column("shingles").to_pylist())), return_counts=True)
            keep = counts >= at_least
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))], ["shingle", "n"])

    counted = sets.select("node", "shingles").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    shingle, n = rows.column("shingle").to_numpy().astype(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(shingle)
    return shingle[order], n[order]


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, maybe: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(n * num / den) + 1 shingles in the order: rare ones by value, then common ones by count."""
    n = len(shingles)
    p = n - -(-n * num // den) + 1
    seen = maybe[(shingles & np.uint64(len(maybe) - 1)).astype(np.int64)]
    if not seen.any() or not len(common):
        return shingles[:p]
    at = np.flatnonzero(seen)
    place = np.minimum(np.searchsorted(common, shingles[at]), len(common) - 1)
    found = common[place] == shingles[at]
    at, place = at[found], place[found]
    weight = np.zeros(n, np.int64)
    weight[at] = counts[place]
    if p <= n - len(at):
        return shingles[weight == 0][:p]
    return shingles[np.lexsort((shingles, weight))[:p]]


def blocks(sets: DataFrame, num: int, den: int, shards: int) -> DataFrame:
    """(block, node): nodes that share a shingle of their prefixes. Blocks with the same nodes are one."""
    spark = sets.sparkSession
    common, counts = common_shingles(sets)
    maybe = np.zeros(1 << 22, bool)
    maybe[(common & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    sent = spark.sparkContext.broadcast((common, counts, maybe))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("prefixes")
        common, counts, maybe = sent.value
        for part in map(_distinct_rows, regrouped(batches, "shingles", 2500, 8 << 20)):
            trim()
            if not part.num_rows:
                continue
            own = [prefix(expand(b), common, counts, maybe, num, den) for b in part.column("shingles").to_pylist()]
            tokens = np.concatenate(own)
            nodes = np.repeat(part.column("node").to_numpy(), [len(x) for x in own])
            shard = (tokens >> np.uint64(20)).astype(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            pairs = np.empty((len(order), 2), np.int64)
            pairs[:, 0], pairs[:, 1] = tokens[order].astype(np.int64), nodes[order]
            values, first = np.unique(shard[order], return_index=True)
            ends = [*first[1:].tolist(), len(order)]
            yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int32)), pa.array([pairs[a:b].tobytes() for a, b in zip(first.tolist(), ends, strict=True)], pa.binary())], ["shard", "pairs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("blocks")
        blobs = [b for batch in batches for b in batch.column("pairs").to_pylist()]
        if not blobs:
            return
        pairs = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2)
        del blobs
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[np.r_[True, (pairs[1:] != pairs[:-1]).any(1)]]
        first = np.flatnonzero(np.r_[True, pairs[1:, 0] != pairs[:-1, 0]])
        size = np.diff(np.r_[first, len(pairs)])
        many = size > 1
        first, size = first[many], size[many]
        if not len(first):
            return
        mixed = _mix(pairs[:, 1].astype(np.uint64))
        total = np.add.reduceat(mixed, np.stack([first, first + size], 1).ravel().clip(max=len(mixed) - 1))[::2] if len(first) else first
        # The last run may end at the end of the array, where reduceat needs no second edge.
        if first[-1] + size[-1] == len(mixed):
            total[-1] = mixed[first[-1] :].sum(dtype=np.uint64)
        name, once = np.unique(_mix(total ^ size.astype(np.uint64)), return_index=True)
        out_block, out_node = [], []
        for key, k in zip(name.tolist(), once.tolist(), strict=True):
            own = pairs[first[k] : first[k] + size[k], 1]
            if len(own) <= PART:
                out_block.append(np.full(len(own), key, np.uint64))
                out_node.append(own)
                continue
            parts = np.array_split(own, -(-len(own) // (PART // 2)))
            for i, a in enumerate(parts):
                for j in range(i + 1, len(parts)):
                    both = np.concatenate([a, parts[j]])
                    out_block.append(np.full(len(both), _mix(np.array([key ^ (i << 32 | j)], np.uint64))[0], np.uint64))
                    out_node.append(both)
                    if len(out_block) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_block).astype(np.int64)), pa.array(np.concatenate(out_node))], ["block", "node"])
                        out_block, out_node = [], []
        if out_block:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_block).astype(np.int64)), pa.array(np.concatenate(out_node))], ["block", "node"])

    routed = sets.select("node", "shingles").mapInArrow(route, "shard int, pairs binary")
    # Few shards are dealt out by the session's settings; where the data asks for more, each has its own task.
    few = shards <= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    routed = routed.repartition("shard") if few else routed.repartition(shards, "shard")
    return routed.mapInArrow(meet, "block long, node long").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class CountTree:
    """An R-tree of count vectors over points sorted by size: leaves of LEAF neighbours, each with its largest counts.

    Points of different sizes may have different numbers of groups; a pair is compared with those of the smaller one.
    """

    def __init__(self, sizes: np.ndarray, vectors: list[bytes], num: int, den: int):
        self.n, self.num, self.den = sizes, num, den
        self.raw = [np.frombuffer(v, np.uint16) for v in vectors]
        self.folded: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}

    def _fold(self, groups: int) -> tuple[int, np.ndarray, np.ndarray]:
        """First point with at least so many groups; counts and leaf maxima from there on."""
        if groups not in self.folded:
            start = next(i for i, v in enumerate(self.raw) if len(v) >= groups)
            points = np.stack([v.reshape(-1, groups).sum(0, dtype=np.int32) for v in self.raw[start:]])
            leaves = np.maximum.reduceat(points, np.arange(0, len(points), LEAF), axis=0)
            self.folded[groups] = (start, points, leaves)
        return self.folded[groups]

    def enough(self, a: int, b: np.ndarray) -> np.ndarray:
        """Least overlap of sets of sizes a and b: o * den >= num * (a + b - o)."""
        return -(-(self.num * (a + b)) // (self.num + self.den))

    def above(self, i: int, wanted: np.ndarray) -> np.ndarray:
        """Points after i, of those wanted (mask), that may link with it."""
        end = int(np.searchsorted(self.n, self.n[i] * self.den // self.num, "right"))
        if end <= i + 1:
            return np.zeros(0, np.int64)
        start, points, leaves = self._fold(len(self.raw[i]))
        mine = points[i - start]
        need = self.enough(int(self.n[i]), self.n[i + 1 : end])
        at = np.arange(i + 1, end)
        keep = wanted[at]
        if end - i > 2 * LEAF:
            lo, hi = (i + 1 - start) // LEAF, (end - 1 - start) // LEAF + 1
            bound = np.minimum(leaves[lo:hi], mine).sum(1)
            leaf = (at - start) // LEAF - lo
            keep &= bound[leaf] >= need
        at, need = at[keep], need[keep]
        if not len(at):
            return at
        return at[np.minimum(points[at - start], mine).sum(1) >= need]


class Forest:
    """Union-find over 0..n-1 with the component of each as an array."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: int, b: int) -> None:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)


def possible_links(sizes: np.ndarray, vectors: list[bytes], num: int, den: int) -> np.ndarray:
    """Component of each point (sorted by size) under links that the count vectors can't exclude."""
    tree, forest = CountTree(sizes, vectors, num, den), Forest(len(sizes))
    for i in range(len(sizes) - 1):
        for j in tree.above(i, forest.of != forest.of[i]).tolist():
            forest.join(i, j)
    return forest.of


def verified_links(sizes: np.ndarray, vectors: list[bytes], shingles: list[bytes], num: int, den: int) -> np.ndarray:
    """Component of each set (sorted by size) under exact links."""
    tree, forest = CountTree(sizes, vectors, num, den), Forest(len(sizes))
    sets: dict[int, np.ndarray] = {}
    held = 0

    def of(i: int) -> np.ndarray:
        nonlocal held
        if i not in sets:
            if held > 4 << 20:
                sets.clear()
                held = 0
            sets[i] = expand(shingles[i])
            held += len(sets[i])
        return sets[i]

    for i in range(len(sizes) - 1):
        mine = of(i)
        for j in tree.above(i, forest.of != forest.of[i]).tolist():
            if forest.of[i] == forest.of[j]:
                continue
            theirs = of(j)
            place = np.minimum(np.searchsorted(theirs, mine), len(theirs) - 1)
            both = int((theirs[place] == mine).sum())
            if both * den >= num * (len(mine) + len(theirs) - both):
                forest.join(i, j)
    return forest.of


def _grouped(rows: DataFrame, key: str, solve: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    """(a, b) star edges within each group of `key`. Groups stream by in the order of (key, n); one is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("groups")
        held: list[pa.RecordBatch] = []

        def out(t: pa.Table) -> pa.RecordBatch | None:
            keys = t.column(key).to_numpy()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            a, b = [], []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
                if hi - lo > 1:
                    own = t.slice(lo, hi - lo)
                    nodes, of = own.column("node").to_numpy(), solve(own)
                    linked = of != np.arange(len(of))
                    a.append(nodes[linked])
                    b.append(nodes[of[linked]])
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            tail = int(np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])[-1])
            if tail or (held and held[-1].column(key)[-1].as_py() != keys[0]):
                done = pa.Table.from_batches([*held, batch.slice(0, tail)])
                held = [batch.slice(tail)]
                if done.num_rows and (edges := out(done)) is not None:
                    yield edges
            else:
                held.append(batch)
        if held and (edges := out(pa.Table.from_batches(held))) is not None:
            yield edges

    return rows.repartition(key).sortWithinPartitions(key, "n", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * intersection >= num * union of their shingle sets."""
    spark = docs.sparkSession
    small_batches(spark)
    mark = tables_written()
    sets = materialize(shingle_sets(docs), "shingle-sets")
    # A shard's pairs are sorted in one task: their number follows the data, about a fifth of the shingles at 80 %.
    prefixes = (sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 0) * (den - num) // den
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-prefixes // SHARD_PAIRS))
    met = materialize(blocks(sets, num, den, shards), "jaccard-blocks")
    nodes = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"), F.first("vector").alias("vector"))
    points = met.join(nodes.select("node", "n", "vector"), "node")

    def may(t: pa.Table) -> np.ndarray:
        return possible_links(t.column("n").to_numpy(), t.column("vector").to_pylist(), num, den)

    rough = materialize(components(_grouped(points, "block", may)), "jaccard-rough")
    # Sets of the nodes that may link, each read from one of its documents.
    sized = rough.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    firsts = sets.where("node is not null").select("node", "doc_id").join(F.broadcast(rough.select("node")) if (few := rough.count() <= BROADCAST_NODES) else rough.select("node"), "node", "left_semi")
    chosen = firsts.groupBy("node").agg(F.min("doc_id").alias("chosen"), F.count(F.lit(1)).alias("copies")).join(rough, "node").join(sized, "root").withColumnRenamed("node", "chosen_node")
    chosen = materialize(chosen, "jaccard-chosen")
    taken = sets.join(F.broadcast(chosen) if few else chosen, (F.col("node") == F.col("chosen_node")) & F.col("doc_id").eqNullSafe(F.col("chosen")))
    taken = taken.select("root", "members", "node", "n", "vector", "shingles")
    # A group of more than PART sets is dealt out in pairs of parts.
    parts = F.ceil(F.col("members") / (PART // 2)).cast("int")
    mine = F.pmod(F.xxhash64("node"), parts).cast("int")
    keys = F.when(F.col("members") <= PART, F.array(F.col("root"))).otherwise(F.transform(F.sequence(F.lit(0), parts - 1), lambda other: F.xxhash64(F.col("root"), F.least(mine, other), F.greatest(mine, other))))
    dealt = taken.withColumn("task", F.explode(keys)).select("task", "node", "n", "vector", "shingles")

    def links(t: pa.Table) -> np.ndarray:
        return verified_links(t.column("n").to_numpy(), t.column("vector").to_pylist(), t.column("shingles").to_pylist(), num, den)

    edges = materialize(_grouped(dealt, "task", links), "jaccard-links")
    final = components(edges) if not sized.where(F.col("members") > PART).isEmpty() else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    linked = nodes.select("node", "first_doc").join(final, "node", "left").select("node", "first_doc", F.coalesce("root", "node").alias("root"))
    named = linked.join(linked.groupBy("root").agg(F.min("first_doc").alias("component")), "root").select(F.col("node").alias("of"), "component")
    rows = sets.select("doc_id", "n", "node")
    named_rows = rows.join(named, F.col("node") == F.col("of"), "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return settled(named_rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")), "jaccard", mark)


def keep_one(docs: DataFrame, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each component: that with the smallest doc_id, or one of its rows if there are several."""
    found = materialize(near_duplicates(docs, num, den).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("gone")).distinct(), "jaccard-gone")
    few = found.count() <= BROADCAST_NODES
    return docs.join(F.broadcast(found) if few else found, docs["doc_id"] == found["gone"], "left_anti")
