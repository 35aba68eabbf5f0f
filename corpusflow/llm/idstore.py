"""A content-addressed store of token ids.

Layout of a store folder:
  packs/pNNNNN.pack    unique chunks in the order of their digests, in zstd-compressed blocks
  recipes/rNNNNN.rec   documents in ascending doc_id order: doc_id, number of ids, digests of their chunks
  manifest.json        width of an id, the files with their Merkle roots, the first id and document of each recipe file,
                       and the root over all files

A document's ids are cut where a rolling hash of the last 16 ids has its low bits zero, so equal passages give equal
chunks wherever they stand. A chunk's name is the 128-bit hash of its bytes; each is stored once. Reading verifies every
chunk against its name and every file against its root; a document's crc follows from those of its chunks.

Files are written under a name of the attempt and then renamed, so a task that runs again after a lost executor leaves
the same files.

Edge cases: null or empty text is the end id alone. Null doc_ids come first; repeated rows are documents of their own. An
empty table gives a store without documents. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordCoder, file_system, fresh_dir, materialize, put_in_place, regrouped, release, small_batches, tables_written

#: Cut where the low bits of the rolling hash are zero: 512 ids on average, within these bounds.
MEAN_BITS, LEAST, MOST, REACH = 9, 64, 4096, 16
_BLOCK = 256 << 10
_REC, _REC_SIZE = "<?qII", struct.calcsize("<?qII")


def _gear(n: int = 1 << 16) -> np.ndarray:
    """A fixed pseudo-random number for each value that an id can have modulo n."""
    x = np.arange(n, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return x ^ (x >> np.uint64(31))


def cut_points(ids: np.ndarray, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    h = gear[ids & 0xFFFF]
    width = 1
    while width < REACH:  # the hash of 2w ids from two of w ids
        h = h.copy()
        h[width:] += h[:-width] << np.uint64(width)
        width *= 2
    marks = np.flatnonzero((h >> np.uint64(REACH - 1)) & np.uint64((1 << MEAN_BITS) - 1) == 0) + 1
    ends, last = [], 0
    for m in marks.tolist():
        if m - last < LEAST:
            continue
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def _write_once(folder: str, name: str, write) -> None:
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = f"{root}/.{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(attempt) as out:
        write(out)
    put_in_place(fs, attempt, f"{root}/{name}")


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; the odd node of a level moves up."""
    level = leaves or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return hashlib.sha256(level[0]).digest()


def _spool(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Rows of documents (doc_id, n, digests) and of chunks (digest, payload), each chunk once a task at most."""
    import xxhash

    schema = "is_doc boolean, doc_id long, n long, digests binary, digest binary, payload binary"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, gear, end = WordCoder.of(tokenizer, 200_000), _gear(), end_id.to_bytes(4, "little")
        sent: set[bytes] = set()
        for part in regrouped(batches, "text"):
            rows, fresh = [], {}
            if len(sent) > 500_000:
                sent.clear()
            for raw in coder.encode(part.column(1)):
                ids = np.frombuffer(raw + end, "<u4")
                small, own, at = ids.astype("<u2").tobytes() if width == 2 else ids.tobytes(), [], 0
                for stop in cut_points(ids, gear):
                    chunk = small[at * width : stop * width]
                    own.append(name := xxhash.xxh3_128_digest(chunk))
                    if name not in sent:
                        sent.add(name)
                        fresh[name] = chunk
                    at = stop
                rows.append((len(ids), b"".join(own)))
            a, b = len(rows), len(fresh)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([True] * a + [False] * b),
                    pa.concat_arrays([part.column(0), pa.nulls(b, pa.int64())]),
                    pa.array([n for n, _ in rows] + [None] * b, pa.int64()),
                    pa.array([d for _, d in rows] + [None] * b, pa.binary()),
                    pa.array([None] * a + list(fresh), pa.binary()),
                    pa.array([None] * a + list(fresh.values()), pa.binary()),
                ],
                [x.split()[0] for x in schema.split(", ")],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, schema)


def _write_packs(chunks: DataFrame, folder: str) -> DataFrame:
    """One pack a partition. Rows: file, root, n."""
    import zstandard

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, names, n = f"p{TaskContext.get().partitionId():05d}.pack", [], 0

        def fill(out) -> None:
            nonlocal n
            last, block, head = None, [], []
            size = 0
            press = zstandard.ZstdCompressor(level=1)

            def flush() -> None:
                nonlocal size
                if head:
                    body = press.compress(b"".join(block))
                    index = b"".join(head)
                    out.write(struct.pack("<III", len(head), len(body), zlib.crc32(index)) + index + body)
                    names.append(hashlib.sha256(index).digest())
                    block.clear()
                    head.clear()
                    size = 0

            for batch in batches:
                for digest, payload in zip(batch.column("digest").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    if digest == last:
                        continue
                    last = digest
                    head.append(digest + struct.pack("<I", len(payload)))
                    block.append(payload)
                    size += len(payload)
                    n += 1
                    if size >= _BLOCK:
                        flush()
            flush()

        _write_once(f"{folder}/packs", name, fill)
        yield pa.RecordBatch.from_pydict({"file": [name], "root": [_merkle(names)], "n": pa.array([n], pa.int64())})

    return chunks.mapInArrow(write, "file string, root binary, n long")


def _write_recipes(docs: DataFrame, folder: str) -> DataFrame:
    """One recipe file a partition. Rows: file, part, root, docs, ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, names, n, ids = f"r{part:05d}.rec", [], 0, 0

        def fill(out) -> None:
            nonlocal n, ids
            for batch in batches:
                for doc, count, digests in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "digests")), strict=True):
                    record = struct.pack(_REC, doc is not None, doc or 0, count, len(digests) // 16) + digests
                    out.write(record)
                    names.append(hashlib.sha256(record).digest())
                    n, ids = n + 1, ids + count

        _write_once(f"{folder}/recipes", name, fill)
        yield pa.RecordBatch.from_pydict({"file": [name], "part": pa.array([part], pa.int32()), "root": [_merkle(names)], "docs": pa.array([n], pa.int64()), "ids": pa.array([ids], pa.int64())})

    return docs.mapInArrow(write, "file string, part int, root binary, docs long, ids long")


def write_store(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> str:
    """Encodes docs and writes a store; returns its folder. What reaches the driver is a row a file."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_dir(spark, "id-store")
    mark = tables_written()
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    spool = materialize(_spool(docs, tokenizer, end_id, width), "id-spool", compression="zstd")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = spool.where(~F.col("is_doc")).select("digest", "payload").repartition(parts, "digest").sortWithinPartitions("digest")
    packs = _write_packs(chunks, folder).collect()
    recipes = _write_recipes(spool.where("is_doc").select("doc_id", "n", "digests").repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("digests")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digests"), folder).collect()
    release(spark, mark)
    first_doc = first_id = 0
    listed = []
    for r in sorted(recipes, key=lambda r: r["part"]):
        listed.append({"file": r["file"], "root": bytes(r["root"]).hex(), "docs": r["docs"], "ids": r["ids"], "first_doc": first_doc, "first_id": first_id})
        first_doc, first_id = first_doc + r["docs"], first_id + r["ids"]
    manifest = {"width": width, "packs": sorted(({"file": p["file"], "root": bytes(p["root"]).hex(), "chunks": p["n"]} for p in packs), key=lambda p: p["file"]), "recipes": listed, "ids": first_id}
    manifest["root"] = _merkle([bytes.fromhex(x["root"]) for x in manifest["packs"] + listed]).hex()
    _write_once(folder, "manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return folder


def read_manifest(folder: str) -> dict:
    fs, root = file_system(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    if _merkle([bytes.fromhex(x["root"]) for x in manifest["packs"] + manifest["recipes"]]).hex() != manifest["root"]:
        raise ValueError("the manifest's root doesn't match its files")
    return manifest


def _files(spark: SparkSession, rows: list[dict], columns: str, tasks: int) -> DataFrame:
    """A small table of files, dealt to at most so many tasks."""
    names = [x.split()[0] for x in columns.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], columns).repartition(max(1, min(tasks, len(rows))))


def read_chunks(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """digest, n, crc (of the ids as little-endian unsigned 32-bit numbers) and, if wanted, payload (as stored). Verified."""
    manifest, width = read_manifest(folder), read_manifest(folder)["width"]
    schema = "digest binary, n long, crc long" + ", payload binary" * payload

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        fs, root = file_system(folder)
        for batch in batches:
            for file, wanted in zip(batch.column("file").to_pylist(), batch.column("root").to_pylist(), strict=True):
                names = []
                with fs.open_input_stream(f"{root}/packs/{file}") as f:
                    while top := f.read(12):
                        n, size, crc = struct.unpack("<III", top)
                        index = f.read(20 * n)
                        if zlib.crc32(index) != crc:
                            raise ValueError(f"{file}: a block's index is damaged")
                        names.append(hashlib.sha256(index).digest())
                        body, at = zstandard.ZstdDecompressor().decompress(f.read(size)), 0
                        digests, counts, crcs, bodies = [], [], [], []
                        for i in range(n):
                            name, long = index[20 * i : 20 * i + 16], int.from_bytes(index[20 * i + 16 : 20 * i + 20], "little")
                            chunk = body[at : at + long]
                            at += long
                            if xxhash.xxh3_128_digest(chunk) != name:
                                raise ValueError(f"{file}: a chunk doesn't match its name")
                            digests.append(name)
                            counts.append(long // width)
                            crcs.append(zlib.crc32(np.frombuffer(chunk, f"<u{width}").astype("<u4").tobytes()))
                            bodies.append(chunk)
                        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), *[pa.array(bodies, pa.binary())] * payload], ["digest", "n", "crc", *["payload"] * payload])
                if _merkle(names) != bytes.fromhex(wanted):
                    raise ValueError(f"{file} doesn't match its root")

    return _files(spark, manifest["packs"], "file string, root string", 10_000).mapInArrow(read, schema)


def read_recipes(spark: SparkSession, folder: str) -> DataFrame:
    """row (place in ascending doc_id order), doc_id, start, n_tokens, digests (16 bytes a chunk). Verified."""
    manifest = read_manifest(folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for file, wanted, row, start in zip(*(batch.column(c).to_pylist() for c in ("file", "root", "first_doc", "first_id")), strict=True):
                names, rows = [], []
                schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary())])
                with fs.open_input_stream(f"{root}/recipes/{file}", buffer_size=1 << 20) as f:
                    while top := f.read(_REC_SIZE):
                        there, doc, n, chunks = struct.unpack(_REC, top)
                        digests = f.read(16 * chunks)
                        names.append(hashlib.sha256(top + digests).digest())
                        rows.append((row, doc if there else None, start, n, digests))
                        row, start = row + 1, start + n
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows.clear()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                if _merkle(names) != bytes.fromhex(wanted):
                    raise ValueError(f"{file} doesn't match its root")

    return _files(spark, manifest["recipes"], "file string, root string, first_doc long, first_id long", 10_000).mapInArrow(read, "row long, doc_id long, start long, n_tokens long, digests binary")


def _shift_tables(steps: int = 40) -> np.ndarray:
    """For each power of two, tables that advance a crc over so many zero bytes: steps x 4 x 256."""
    one = np.zeros(32, np.uint64)  # images of the 32 bits under one zero bit
    one[0] = 0xEDB88320
    one[1:] = np.uint64(1) << np.arange(31, dtype=np.uint64)

    def apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for bit in range(32):
            out ^= np.where((v >> np.uint64(bit)) & np.uint64(1), m[bit], np.uint64(0))
        return out

    for _ in range(3):
        one = apply(one, one)  # 2, 4, 8 bits: one byte
    tables = np.zeros((steps, 4, 256), np.uint64)
    for k in range(steps):
        for byte in range(4):
            tables[k, byte] = apply(one, np.arange(256, dtype=np.uint64) << np.uint64(8 * byte))
        one = apply(one, one)
    return tables


def shifted(crc: np.ndarray, zeros: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """What each crc adds to the crc of a text that goes on for so many bytes after its part."""
    v = crc.astype(np.uint64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        t, low = tables[k], np.uint64(255)
        moved = t[0][v & low] ^ t[1][(v >> np.uint64(8)) & low] ^ t[2][(v >> np.uint64(16)) & low] ^ t[3][(v >> np.uint64(24)) & low]
        v = np.where((zeros >> k) & 1, moved, v)
    return v


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: chunk crcs, each advanced over the bytes that
    follow it in its document, combined by exclusive or."""
    recipes = read_recipes(spark, folder)
    each = F.transform(F.sequence(F.lit(0), F.expr("cast(length(digests) / 16 as int) - 1")), lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16)))
    parts = recipes.select("row", "doc_id", "start", "n_tokens", F.posexplode(each).alias("at", "digest"))
    # The planner knows the number of files only, so it must be told that neither side is small.
    joined = parts.join(read_chunks(spark, folder, payload=False).hint("merge"), "digest")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents come whole and in order of their parts; the last of a batch waits for the next batch."""
        tables, held = _shift_tables(), None

        def out(t: pa.Table) -> pa.RecordBatch:
            row, n = t.column("row").to_numpy(), t.column("n").to_numpy()
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            run = np.cumsum(n)
            ends = np.r_[first[1:], len(row)]
            after = np.repeat(run[ends - 1], ends - first) - run
            crc = np.bitwise_xor.reduceat(shifted(t.column("crc").to_numpy(), 4 * after, tables), first)
            whole = np.add.reduceat(n, first)
            if (whole != t.column("n_tokens").to_numpy()[first]).any():
                raise ValueError("a document's chunks don't add up to its length")
            heads = t.take(pa.array(first))
            return pa.RecordBatch.from_arrays([heads.column("doc_id").combine_chunks(), heads.column("start").combine_chunks(), pa.array(whole, pa.int64()), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            row = t.column("row").to_numpy()
            tail = int(np.searchsorted(row, row[-1]))
            held = t.slice(tail)
            if tail:
                yield out(t.slice(0, tail))
        if held is not None and held.num_rows:
            yield out(held)

    columns = ["row", "at", "doc_id", "start", "n_tokens", "n", "crc"]
    return joined.select(*columns).repartition("row").sortWithinPartitions("row", "at").mapInArrow(gather, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, folder: str, doc_ids: DataFrame | None = None) -> DataFrame:
    """doc_id, start, ids array<long>: documents put together again from their chunks (doc_ids: only those)."""
    manifest = read_manifest(folder)
    recipes = read_recipes(spark, folder)
    if doc_ids is not None:
        recipes = recipes.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    each = F.transform(F.sequence(F.lit(0), F.expr("cast(length(digests) / 16 as int) - 1")), lambda i: F.substring(F.col("digests"), i * 16 + 1, F.lit(16)))
    parts = recipes.select("row", "doc_id", "start", F.posexplode(each).alias("at", "digest")).join(read_chunks(spark, folder).select("digest", "payload").hint("merge"), "digest")
    whole = parts.groupBy("row", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))
    width = manifest["width"]

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(parts):
        return parts.map(lambda ps: np.concatenate([np.frombuffer(bytes(p["payload"]), f"<u{width}") for p in ps]).astype(np.int64))

    return whole.select("doc_id", "start", ids("parts").alias("ids"))
