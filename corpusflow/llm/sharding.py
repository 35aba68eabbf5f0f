"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id). Exact bytes below candidate boundaries are counted across all
partitions; the intervals that hold a wanted splitter are divided again until every splitter lies within the tolerance,
then rows move once, to their shard. Equal texts share a hash, so a group of copies stays in one shard unless the group
alone is larger than the tolerance allows; then it is divided by doc_id.

What the driver holds is bounded: at most `shards - 1` intervals of 4096 counts a round.

Edge cases: a null text has size 1 and crc 0 and is a group of its own; empty text likewise has size 1. Null doc_ids sort
first. Repeated rows each get a slot. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialize

_BITS, _LOW, _ALL = 12, -(1 << 63), (1 << 64) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, and the sort key pair (key, tie)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("tie"),
    )


def _prefix(column: str, bits: int) -> F.Column:
    return F.shiftrightunsigned(F.col(column).bitwiseXOR(F.lit(_LOW)), 64 - bits)


def _refine(rows: DataFrame, column: str, wanted: dict[int, tuple[int, int]], tolerance: float, last: bool) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """Boundaries in one column. wanted: splitter -> (target bytes, bytes below the rows given).

    Returns (settled: splitter -> first value of its upper side) and, where one value alone is too large and it isn't the
    last column, (open: splitter -> (that value, bytes below it))."""
    settled: dict[int, int] = {}
    inside = {i: (0, below) for i, (_, below) in wanted.items()}  # splitter -> (prefix of its interval, bytes below it)
    depth = 0
    while inside:
        bits = min(depth + _BITS, 64)
        part = rows if depth == 0 else rows.where(_prefix(column, depth).isin([p - (1 << 64) if p >> 63 else p for p in {p for p, _ in inside.values()}]))
        counted = part.groupBy(_prefix(column, bits).alias("p")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
        bins: dict[int, list[tuple[int, int, int]]] = {}
        for p, b, n in counted:
            p &= _ALL
            bins.setdefault(p >> (bits - depth), []).append((p, b, n))
        after: dict[int, tuple[int, int]] = {}
        for i, (prefix, below) in inside.items():
            target, edge = wanted[i][0], below
            found = sorted(bins.get(prefix, []))
            for j, (p, b, n) in enumerate(found):
                if edge + b < target and j + 1 < len(found):
                    edge += b
                    continue
                upper = found[j + 1][0] if j + 1 < len(found) else (p + 1)
                gap_low, gap_high = target - edge, edge + b - target
                best = min(abs(gap_low), abs(gap_high))
                if best > tolerance and n > 1 and bits < 64:
                    after[i] = (p, edge)
                elif best > tolerance and n > 1 and not last:
                    after[i] = (p, edge)
                else:
                    at = p if abs(gap_low) <= abs(gap_high) else upper
                    settled[i] = (at << (64 - bits)) - (1 << 63)
                break
            else:
                settled[i] = (prefix << (64 - depth) if depth else 0) - (1 << 63)
        if bits == 64:
            return settled, {i: (p - (1 << 63), edge) for i, (p, edge) in after.items()}
        inside, depth = after, bits
    return settled, {}


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.01) -> tuple[list[tuple[int, int]], int]:
    """`shards - 1` boundaries (key, tie), and the number of rows. tolerance: a boundary's distance in bytes from its
    place, as a part of an equal share."""
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return [], 0
    share = total / shards
    settled, unsettled = _refine(rows, "key", {i: (share * i, 0) for i in range(1, shards)}, tolerance * share, False)
    found = {i: (v, _LOW) for i, v in settled.items()}
    for value in {v for v, _ in unsettled.values()}:
        own = {i: (share * i, below) for i, (v, below) in unsettled.items() if v == value}
        ties, _ = _refine(rows.where(F.col("key") == value), "tie", own, tolerance * share, True)
        found |= {i: (value, t) for i, t in ties.items()}
    return sorted(found.values()), n


def shard(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, rows_per_task: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard, slot (gapless from 0 in each shard), grown_shard (null).

    Inside a shard rows come in the order of a hash of doc_id and text, counted in bins of about rows_per_task rows, so that
    neither a large shard nor a large group of copies meets in one task.
    """
    rows = materialize(keyed(docs), "shard-keys")
    bounds, n = splitters(rows, shards, tolerance)
    place = F.lit(0)
    for key, tie in bounds:
        below = F.col("key") < F.lit(key) if tie == _LOW else (F.col("key") < F.lit(key)) | ((F.col("key") == F.lit(key)) & (F.col("tie") < F.lit(tie)))
        place = place + F.when(below, 0).otherwise(1)
    bins = max(1, -(-n // (shards * rows_per_task)))
    placed = rows.withColumn("shard", place.cast("int")).withColumn("mixed", F.xxhash64("doc_id", "text_crc32")).withColumn("bin", F.pmod("mixed", F.lit(bins)).cast("int"))
    before = W.Window.partitionBy("shard").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "bin").count().select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.Window.partitionBy("shard", "bin").orderBy("mixed", "tie"))
    return (
        placed.withColumn("within", within)
        .join(base, ["shard", "bin"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within") - 1).cast("long").alias("slot"), F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
    )
