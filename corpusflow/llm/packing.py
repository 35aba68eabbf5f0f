"""Packing documents into fixed windows by non-negative least squares on the histogram of lengths.

A document's ids are cut at multiples of the window; only its last piece is shorter. Lengths are counted in units
(window / 256, rounded up). All combinations of up to three lengths that fill a window exactly are enumerated; repeat
counts that best reproduce the histogram are the solution of a non-negative least-squares problem (Lawson and Hanson's
active-set method), rounded down; what remains is packed greedily, largest first, again as patterns with repeat counts.
The plan depends on the histogram alone, so the driver holds at most 256 counts and a few hundred patterns at any scale.

Pieces get their place from their rank among the pieces of equal length, counted in bins of a hash of doc_id and ids, so
that neither one very common length nor many null ids meet in one task.

Edge cases: a null or empty text is the end id alone. Repeated rows are packed each. Null doc_ids are packed like others.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import WordCoder, materialize, regrouped, small_batches, trim

UNITS = 256


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids (binary)."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end, step = WordCoder.of(tokenizer, 60_000), end_id.to_bytes(4, "little"), 4 * window
        for part in regrouped(batches, "text", 800, 3 << 20):
            trim()
            rows: list[list] = [[] for _ in names]
            for doc, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    for column, value in zip(rows, (doc, at >> 2, len(piece) >> 2, zlib.crc32(piece), len(ids) >> 2, piece), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(rows, names, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


@dataclass
class Pattern:
    """A way to fill a window: how often each length (in units) occurs in it, and how many windows are filled so."""

    parts: dict[int, int]
    repeats: int


def combinations(units: int = UNITS) -> list[tuple[int, ...]]:
    """All ways to fill `units` with one, two or three lengths."""
    found: list[tuple[int, ...]] = [(units,)]
    found += [(a, units - a) for a in range(1, units // 2 + 1)]
    found += [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return found


def nnls(matrix: np.ndarray, wanted: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """Lawson and Hanson: x >= 0 that minimises |matrix x - wanted|."""
    x, active = np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1], bool)
    slack = 1e-9 * max(1.0, float(np.abs(matrix.T @ wanted).max(initial=0)))
    for _ in range(rounds or 3 * matrix.shape[0]):
        slope = matrix.T @ (wanted - matrix @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= slack:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            part = matrix[:, on]
            y = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(on)), part.T @ wanted)
            if (y > 0).all():
                x[:] = 0
                x[on] = y
                break
            low = y <= 0
            now = x[on]
            step = float((now[low] / np.maximum(now[low] - y[low], 1e-300)).min())
            x[on] = now + step * (y - now)
            active[on[(x[on] <= 1e-12)]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def plan(counts: dict[int, int], units: int = UNITS) -> list[Pattern]:
    """Patterns that hold every piece of the histogram (length in units -> pieces)."""
    left = np.zeros(units + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    patterns = []
    if left[units]:
        patterns.append(Pattern({units: 1}, int(left[units])))
        left[units] = 0
    present = set(np.flatnonzero(left).tolist())
    shallow = [c for c in combinations(units) if set(c) <= present]
    if shallow:
        matrix = np.zeros((units + 1, len(shallow)))
        for j, c in enumerate(shallow):
            for length in c:
                matrix[length, j] += 1
        solved = nnls(matrix, left.astype(float))
        for j in np.argsort(-solved, kind="stable"):
            parts: dict[int, int] = {}
            for length in shallow[j]:
                parts[length] = parts.get(length, 0) + 1
            repeats = min([int(solved[j] + 1e-6), *(int(left[length]) // m for length, m in parts.items())])
            if repeats > 0:
                patterns.append(Pattern(parts, repeats))
                for length, m in parts.items():
                    left[length] -= repeats * m
    while left.any():
        room, parts = units, {}
        while room and len(fits := np.flatnonzero(left[1 : room + 1])):
            length = int(fits[-1]) + 1
            free = int(left[length]) - parts.get(length, 0)
            take = min(free, room // length)
            if take <= 0:
                # All of this length is in use already: the next shorter one.
                shorter = [f + 1 for f in fits[:-1].tolist() if left[f + 1] > parts.get(f + 1, 0)]
                if not shorter:
                    break
                length = shorter[-1]
                take = min(int(left[length]) - parts.get(length, 0), room // length)
            parts[length] = parts.get(length, 0) + take
            room -= take * length
        repeats = min(int(left[length]) // m for length, m in parts.items())
        patterns.append(Pattern(parts, repeats))
        for length, m in parts.items():
            left[length] -= repeats * m
    return patterns


def runs(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(units, first rank, end rank, first sequence, multiplicity, first position) of every length in every pattern: the
    piece of rank r goes to sequence `first + (r - first rank) // multiplicity`."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p in patterns:
        position = 0
        for length, m in sorted(p.parts.items(), reverse=True):
            rank = used.get(length, 0)
            out.append((length, rank, rank + m * p.repeats, sequence, m, position))
            used[length] = rank + m * p.repeats
            position += m
        sequence += p.repeats
    return out


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, rows_per_task: int = 20_000, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    small_batches(spark)
    cut = materialize(pieces(docs, tokenizer, window, end_id, with_ids), "pack-pieces")
    units = F.ceil(F.col("length") * UNITS / window).cast("int")
    counts = {r["units"]: r["n"] for r in cut.groupBy(units.alias("units")).agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(runs(plan(counts)), "units int, low long, high long, first long, times long, place long")
    total = sum(counts.values())
    # Ranks by length: a bin holds about rows_per_task rows however common one length is.
    bins = max(1, -(-total // rows_per_task))
    marked = cut.withColumn("units", units).withColumn("mixed", F.xxhash64("doc_id", "start", "ids_crc32")).withColumn("bin", F.pmod("mixed", F.lit(bins)).cast("int"))
    before = W.Window.partitionBy("units").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    base = marked.groupBy("units", "bin").count().select("units", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(W.Window.partitionBy("units", "bin").orderBy("mixed", "doc_id", "start")) - 1
    ranked = marked.withColumn("within", within).join(base, ["units", "bin"]).withColumn("rank", F.col("base") + F.col("within"))
    # The plan has at most 2 * UNITS patterns of at most 22 different lengths, whatever the input.
    placed = ranked.join(F.broadcast(table), (ranked["units"] == table["units"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor(step / F.col("times")).cast("long")).withColumn("at", F.col("place") + step % F.col("times"))
    earlier = W.Window.partitionBy("sequence_id").orderBy("at").rowsBetween(W.Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset, *["ids"] * with_ids)
