"""Reversible line dedup: exact reference counts and sharded cuckoo filters.

`LineStore` keeps, for each line key, the exact number of documents that hold it (the reference-count table, as Parquet
in the shared folder), and for each shard of keys a cuckoo filter of the keys whose count has reached `min_docs`.
Inserting documents raises counts, deleting documents lowers them, and only keys that cross the threshold enter or leave
the filters. A line is dropped when its key is in the filter and isn't one of the filter's false positives, which are
found exactly by probing the filters with the table's other keys.

Edge cases: null or empty text is one empty line, which stays. Keys of no characters are never dropped. A line that a
document repeats counts once for that document. Repeated rows count as documents of their own. An empty table gives an
empty result. Extra columns are kept; a column named n_lines or n_dropped is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, materialize, own_memory, slices, small_batches

_SPACE = ASCII_SPACE.encode()
#: Filters and exceptions together are broadcast up to this size; beyond it lines are matched by a shuffled join.
BROADCAST_BYTES = 128 << 20


def line_keys(text: str | None, min_chars: int = 1) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and the 16-byte key of each (None: too short to count)."""
    import xxhash

    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    digest = xxhash.xxh3_128_digest
    bare = [x.strip(_SPACE).lower() for x in lines]
    if min_chars <= 1:
        return lines, [digest(b) if b else None for b in bare]
    return lines, [digest(b) if len(b.decode("utf-8", "surrogatepass")) >= min_chars else None for b in bare]


class CuckooFilter:
    """A set of 16-byte keys with deletion: buckets of four 32-bit fingerprints, 0 for empty."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.mask = slots, len(slots) - 1

    @classmethod
    def sized(cls, n: int) -> CuckooFilter:
        buckets = 1
        while buckets * 4 * 0.85 < max(n, 1):
            buckets *= 2
        return cls(np.zeros((buckets, 4), np.uint32))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        return cls(np.frombuffer(blob, np.uint32).reshape(-1, 4).copy())

    def dump(self) -> bytes:
        return self.slots.tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys: n x 2 uint64. Fingerprint, first and second bucket of each."""
        mark = (keys[:, 1] >> np.uint64(32)).astype(np.uint32)
        mark = np.where(mark == 0, np.uint32(1), mark)
        one = (keys[:, 1] & np.uint64(self.mask)).astype(np.int64)
        return mark, one, one ^ self._hop(mark)

    def _hop(self, mark: np.ndarray) -> np.ndarray:
        return ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)).astype(np.int64) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if the filter is too full; the caller then builds a larger one."""
        for mark, one, two in zip(*self._place(keys), strict=True):
            for at in (one, two):
                if len(free := np.flatnonzero(self.slots[at] == 0)):
                    self.slots[at, free[0]] = mark
                    break
            else:
                at = two
                for k in range(500):
                    mark, self.slots[at, k & 3] = self.slots[at, k & 3], mark
                    at ^= int(self._hop(np.array([mark], np.uint32))[0])
                    if len(free := np.flatnonzero(self.slots[at] == 0)):
                        self.slots[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        for mark, one, two in zip(*self._place(keys), strict=True):
            for at in (one, two):
                if len(held := np.flatnonzero(self.slots[at] == mark)):
                    self.slots[at, held[0]] = 0
                    break


def as_pairs(keys: list[bytes] | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(k if isinstance(k, bytes) else k.as_py() for k in keys), np.uint64).reshape(-1, 2)


def build_filter(keys: list[bytes]) -> CuckooFilter:
    room = len(keys)
    while True:
        made = CuckooFilter.sized(room)
        if made.insert(as_pairs(keys)):
            return made
        room = max(4, room * 2)


def _counted(docs: DataFrame, min_chars: int, sign: int) -> DataFrame:
    """(key, n): documents that hold each key, summed within a task before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("line counts")
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([sign * v for v in held.values()], pa.int64())], ["key", "n"])

        for batch in (p for b in batches for p in slices(b, "text", 2000, 8 << 20)):
            for text in batch.column(0).to_pylist():
                for key in set(line_keys(text, min_chars)[1]):
                    if key is not None:
                        held[key] = held.get(key, 0) + 1
            if len(held) > 300_000:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class LineStore:
    """Reference counts and filters; insert() and delete() return a new store and leave this one as it is."""

    def __init__(self, spark: SparkSession, refs: DataFrame | None = None, filters: DataFrame | None = None, min_docs: int = 10, min_chars: int = 1, shards: int | None = None):
        """shards: of the filters; None: chosen at the first insertion, one for each 200,000 keys over the threshold."""
        small_batches(spark)
        self.spark, self.min_docs, self.min_chars, self.shards = spark, min_docs, min_chars, shards
        self.refs, self.filters = refs, filters

    def insert(self, docs: DataFrame) -> LineStore:
        return self._changed(_counted(docs, self.min_chars, 1))

    def delete(self, docs: DataFrame) -> LineStore:
        """docs: documents, whole, that were inserted before."""
        return self._changed(_counted(docs, self.min_chars, -1))

    def _changed(self, delta: DataFrame) -> LineStore:
        hot = self.min_docs
        if self.refs is None:
            both = delta.select("key", F.lit(0).cast("long").alias("was"), "n")
        else:
            old = self.refs.select("key", F.col("n").alias("was"), F.lit(0).cast("long").alias("change"))
            new = delta.select("key", F.lit(0).cast("long").alias("was"), F.col("n").alias("change"))
            summed = old.unionByName(new).groupBy("key").agg(F.sum("was").alias("was"), F.sum("change").alias("change"))
            both = summed.select("key", "was", (F.col("was") + F.col("change")).alias("n"))
        counts = materialize(both.where("n > 0 or was > 0"), "line-refs")
        shards = self.shards or max(16, -(-counts.where(F.col("n") >= hot).count() // 200_000))
        counts = counts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
        crossed = counts.where((F.col("was") >= hot) != (F.col("n") >= hot)).select("shard", "key", (F.col("n") >= hot).alias("enters"))
        before = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, blob binary, held long")
        filters = materialize(crossed.groupBy("shard").cogroup(before.groupBy("shard")).applyInArrow(_update, "shard int, blob binary, held long"), "line-filters")
        full = filters.where("blob is null").select("shard")
        if not full.isEmpty():
            again = counts.where(F.col("n") >= hot).join(full, "shard", "left_semi").select("shard", "key", F.lit(True).alias("enters"))
            empty = self.spark.createDataFrame([], "shard int, blob binary, held long")
            made = again.groupBy("shard").cogroup(empty.groupBy("shard")).applyInArrow(_update, "shard int, blob binary, held long")
            filters = materialize(filters.where("blob is not null").unionByName(made), "line-filters")
        return LineStore(self.spark, counts.where("n > 0").select("shard", "key", "n"), filters, hot, self.min_chars, shards)

    def false_positives(self) -> DataFrame:
        """Keys below the threshold that their shard's filter nevertheless holds."""
        blobs = self._blobs()
        probe = _prober(blobs)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    hit = probe(batch.column("shard").to_numpy(), as_pairs(batch.column("key").to_pylist()))
                    yield batch.select(["key"]).filter(pa.array(hit))

        return self.refs.where(F.col("n") < self.min_docs).select("shard", "key").mapInArrow(find, "key binary")

    def _blobs(self) -> dict[int, bytes]:
        return {r["shard"]: bytes(r["blob"]) for r in self.filters.select("shard", "blob").collect()}

    def apply(self, docs: DataFrame) -> DataFrame:
        """docs (all inserted before) with their text rewritten, and n_lines and n_dropped."""
        held = self.filters.agg(F.coalesce(F.sum(F.octet_length("blob")), F.lit(0))).first()[0] if self.filters is not None else 0
        if held > BROADCAST_BYTES:
            return self._apply_joined(docs)
        blobs = self._blobs() if held else {}
        wrong = materialize(self.false_positives(), "line-false") if held else None
        if wrong is not None and held + 80 * wrong.count() > BROADCAST_BYTES:
            return self._apply_joined(docs)
        spared = frozenset(bytes(r[0]) for r in wrong.collect()) if wrong is not None else frozenset()
        sent = self.spark.sparkContext.broadcast((blobs, spared))
        min_chars, shards = self.min_chars, self.shards

        def choose() -> object:
            blobs, spared = sent.value
            probe = _prober(blobs)

            def dropped(keys: list[bytes]) -> set[bytes]:
                if not keys or not blobs:
                    return set()
                pairs = as_pairs(keys)
                hit = probe(_shard_of(keys, shards), pairs)
                return {keys[i] for i in np.flatnonzero(hit)} - spared

            return dropped

        return _rewritten(docs, choose, min_chars)

    def _apply_joined(self, docs: DataFrame) -> DataFrame:
        """The way for filters that are too large to broadcast: keys meet the exact table in a shuffled join."""
        min_chars = self.min_chars

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (p for b in batches for p in slices(b, "text", 2000, 8 << 20)):
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                own = [list({k for k in line_keys(t, min_chars)[1] if k is not None}) for t in texts]
                at = np.repeat(np.arange(len(own)), [len(k) for k in own])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([k for ks in own for k in ks], pa.binary())], ["doc_id", "key"])

        held = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(keys, "doc_id long, key binary")
        hits = held.join(self.refs.where(F.col("n") >= self.min_docs).select("key"), "key").groupBy(F.col("doc_id").alias("hit_doc")).agg(F.collect_set("key").alias("hit_keys"))
        docs = docs.drop("hit_doc", "hit_keys")
        joined = docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["hit_doc"]), "left").drop("hit_doc")
        return _rewritten(joined, None, min_chars)


def _shard_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.fromiter((_xx64(k) % shards for k in keys), np.int64, len(keys))


def _xx64(key: bytes) -> int:
    """Spark's xxhash64 of a binary value, as a signed number."""
    import xxhash

    h = xxhash.xxh64_intdigest(key, 42)
    return h - (1 << 64) if h >> 63 else h


def _prober(blobs: dict[int, bytes]):
    made = {s: CuckooFilter.load(b) for s, b in blobs.items()}

    def probe(shard: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(pairs), bool)
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, edges):
            if len(part) and (f := made.get(int(shard[part[0]]))) is not None:
                out[part] = f.contains(pairs[part])
        return out

    return probe


def _update(changed: pa.Table, old: pa.Table) -> pa.Table:
    """One shard's filter after keys have entered and left (null: full). Equal fingerprints are held once for each key."""
    keys, enters = changed.column("key").to_pylist(), changed.column("enters").to_pylist()
    come, go = [k for k, e in zip(keys, enters, strict=True) if e], [k for k, e in zip(keys, enters, strict=True) if not e]
    shard = (changed if changed.num_rows else old).column("shard")[0].as_py()
    if old.num_rows == 0:
        made, held = build_filter(come), len(come)
    else:
        made, held = CuckooFilter.load(old.column("blob")[0].as_py()), old.column("held")[0].as_py()
        if go:
            made.delete(as_pairs(go))
        held += len(come) - len(go)
        if come and (held > made.slots.size * 0.95 or not made.insert(as_pairs(come))):
            made = None
    schema = pa.schema([("shard", pa.int32()), ("blob", pa.binary()), ("held", pa.int64())])
    return pa.table([[shard], [made.dump() if made else None], [held]], schema=schema)


def _rewritten(docs: DataFrame, choose, min_chars: int) -> DataFrame:
    """choose: makes, in the task, a function from a batch's keys to those to drop. None: docs has them in hit_keys."""
    keep = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped", "hit_keys")]
    names = [f.name for f in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in keep] + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_memory("line rewriting")
        dropped = choose() if choose else None
        for batch in (p for b in batches for p in slices(b, "text", 2000, 8 << 20)):
            split = [line_keys(t, min_chars) for t in batch.column("text").to_pylist()]
            if dropped:
                gone = dropped(list({k for _, keys in split for k in keys if k is not None}))
                gones = [gone] * len(split)
            else:
                gones = [set(x or ()) for x in batch.column("hit_keys").to_pylist()]
            kept = [[x for x, k in zip(lines, keys, strict=True) if k is None or k not in gone] for (lines, keys), gone in zip(split, gones, strict=True)]
            total = [len(lines) for lines, _ in split]
            text = pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string())
            arrays = [text if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(total, pa.int64()), pa.array([a - len(b) for a, b in zip(total, kept, strict=True)], pa.int64())], [*names, "n_lines", "n_dropped"])

    return docs.select(*names, *([] if choose else ["hit_keys"])).mapInArrow(rewrite, schema)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One-shot form: every document is inserted, then rewritten."""
    return LineStore(docs.sparkSession, min_docs=min_docs, min_chars=min_chars).insert(docs).apply(docs)
