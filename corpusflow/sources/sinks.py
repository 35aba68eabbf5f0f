"""What prepared documents look like as files, and writing them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Formats and the endings of their files.
ENDINGS = {"markdown": ".md", "json": ".json", "chunks": ".jsonl"}


def front_matter(meta: Column) -> Column:
    """A struct as YAML between lines of dashes, keys in order."""

    @F.arrow_udf("string")
    def run(metas: pa.Array) -> pa.Array:
        import datetime

        import yaml

        plain = lambda v: v.isoformat() if isinstance(v, datetime.datetime) else v
        return pa.array(["---\n" + yaml.safe_dump({k: plain(v) for k, v in m.items()}, sort_keys=True, allow_unicode=True).strip() + "\n---\n\n" for m in metas.to_pylist()], pa.string())

    return run(meta)


def document_files(docs: DataFrame, fmt: str, chunks: DataFrame | None = None) -> DataFrame:
    """url, doc_id, path, content. docs: schemas.DOC and markdown; chunks: schemas.CHUNK, for that format."""
    if fmt not in ENDINGS:
        raise ValueError(f"format must be one of {sorted(ENDINGS)}")
    path = F.concat(F.lit("docs/"), "doc_id", F.lit(ENDINGS[fmt])).alias("path")
    meta = [c for c in docs.columns if c != "markdown"]
    if fmt == "markdown":
        content = F.concat(front_matter(F.struct(*meta)), F.col("markdown"))
    elif fmt == "json":
        content = F.to_json(F.struct(*meta, "markdown"), {"ignoreNullFields": "false"})
    else:
        line = F.to_json(F.struct(*chunks.columns), {"ignoreNullFields": "false"})
        ordered = F.array_sort(F.collect_list(F.struct("position", (F.col("role") == "child").alias("child"), line.alias("line"))))
        lines = chunks.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("lines"))
        return docs.join(lines, "doc_id", "left").select("url", "doc_id", path, F.coalesce(F.concat("lines", F.lit("\n")), F.lit("")).alias("content"))
    return docs.select("url", "doc_id", path, content.alias("content"))


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes path/content (string or binary) below a folder that all executors reach: beside, then renamed. path, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = file_system(folder)
        for batch in batches:
            sizes = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                body = content if isinstance(content, bytes) else content.encode()
                where = f"{root}/{path}"
                fs.create_dir(where.rpartition("/")[0], recursive=True)
                temporary = f"{where}.{TaskContext.get().taskAttemptId()}.tmp"
                with fs.open_output_stream(temporary) as out:
                    out.write(body)
                try:
                    fs.move(temporary, where)
                except OSError:
                    # A file system that doesn't replace what is there. Lost in between, the task runs again and writes it.
                    fs.delete_file(where)
                    fs.move(temporary, where)
                sizes.append(len(body))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(sizes, pa.int64())], ["path", "bytes"])

    return files.select("path", "content").mapInArrow(run, "path string, bytes long")


def delete_files(paths: DataFrame, folder: str) -> DataFrame:
    """Deletes files; those that aren't there count too. path, there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            there = []
            for path in batch.column("path").to_pylist():
                try:
                    fs.delete_file(f"{root}/{path}")
                    there.append(True)
                except FileNotFoundError:
                    there.append(False)
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(there)], ["path", "there"])

    return paths.select("path").mapInArrow(run, "path string, there boolean")


def index_rows(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """What a vector index would be fed: its key, the text to embed, and the columns it carries."""
    return chunks.select(*dict.fromkeys(["chunk_id", "text_to_embed", *columns]))


def sync_index(chunks: DataFrame, known: DataFrame, columns: list[str], upsert: Callable[[DataFrame], None], delete: Callable[[DataFrame], None]) -> DataFrame:
    """A triggered update of an index of any kind: upsert() gets the rows that are new or differ from those known to it,
    delete() the chunk_id of those gone. known: chunk_id, fingerprint; gives what is known afterwards."""
    rows = index_rows(chunks, columns)
    now = rows.withColumn("fingerprint", F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256))
    before = known.select("chunk_id", F.col("fingerprint").alias("was"))
    upsert(now.join(before, "chunk_id", "left").where(~F.col("fingerprint").eqNullSafe(F.col("was"))).drop("fingerprint", "was"))
    delete(known.join(now.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id"))
    return now.select("chunk_id", "fingerprint")


def load_table(rows: DataFrame, name: str, provider: str = "parquet", **options: str) -> DataFrame:
    """Creates or replaces a named table; options go to its provider (for example one that keeps change data)."""
    rows.write.format(provider).mode("overwrite").options(**options).saveAsTable(name)
    return rows.sparkSession.table(name)
