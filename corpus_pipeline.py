"""A corpus pipeline of five stages; each works on everything its predecessor kept.

classify (3): documents whose perplexity is beyond their language's bound go. lines (9): lines that 10 or more documents
share lose all their copies. near (4): one document of each near-duplicate group stays. benchmark (8): documents that
contain a benchmark item go. pack (1): the rest becomes windows of 2048 ids; its rows are pieces.

SQL can't express the first, third and last stage, so run() has no SQL; tests hold each stage against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialize
from corpusflow.llm.decontaminate import decontaminate
from corpusflow.llm.jaccard import keep_one
from corpusflow.llm.linededup import dedup_lines
from corpusflow.llm.packing import pack
from corpusflow.llm.perplexity import keep_good

#: Ends each document in the packed windows.
END_ID = 1


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs, min_docs=10).drop("n_lines", "n_dropped")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, 80, 100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=2048, end_id=END_ID)


STAGES = [("classify", classify), ("lines", lines), ("near", near), ("benchmark", benchmark), ("pack", packed)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
