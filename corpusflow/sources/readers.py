"""Files as DataFrames: documents and chunks in JSON with their schemas given, binary files, VARIANT results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CHUNK, DOC
from .sinks import file_system


def read_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the json format, from a folder and all below it."""
    return spark.read.schema(f"{DOC}, markdown string").option("recursiveFileLookup", True).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK).option("recursiveFileLookup", True).json(path)


def read_binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """path, modificationTime, length, content of files of a name pattern."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """target (relative path), sha256 of all files below a folder."""
    files = read_binary(spark, path, "*")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toString()
    return files.select(F.substring(F.col("path"), F.lit(len(whole) + 2), F.length("path")).alias("target"), F.sha2("content", 256).alias("sha256"))


def read_files(targets: DataFrame, folder: str) -> DataFrame:
    """target, content of files named below a folder that all executors reach, each read where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for target in batch.column("target").to_pylist():  # one at a time: nothing bounds their size
                with fs.open_input_stream(f"{root}/{target}") as stream:
                    yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([stream.read()], pa.binary())], ["target", "content"])

    return targets.select("target").mapInArrow(run, "target string, content binary")


def parsed_chunks(parsed: DataFrame, column: str = "parsed", key: str = "doc_id") -> DataFrame:
    """Chunks in a VARIANT {document: {contents: [{chunk_position, chunk_to_retrieve, chunk_to_embed}]}, error_status} of a
    document-parsing function: key, position, text, text_to_embed. Documents with an error give none."""
    return parsed.sparkSession.sql(
        f"""SELECT p.`{key}`, try_variant_get(c.value, '$.chunk_position', 'int') AS position, try_variant_get(c.value, '$.chunk_to_retrieve', 'string') AS text,
                   try_variant_get(c.value, '$.chunk_to_embed', 'string') AS text_to_embed
            FROM {{parsed}} p, LATERAL variant_explode(try_variant_get(p.`{column}`, '$.document.contents', 'variant')) AS c
            WHERE try_variant_get(p.`{column}`, '$.error_status', 'string') IS NULL""",
        parsed=parsed,
    )
