"""The corpus pipeline: from raw documents to token-id files, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; its result is written as Parquet and read again as the next stage's docs.
Stages read ``doc_id``, ``text`` and ``source``; whatever other columns docs has,
with any names, goes along.  Texts are read whole, however long.  An empty table
goes through every stage as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import decontaminate, minhash, mixing, quality, tokens
from orrery.llm.scratch import Scratch


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects.

    The score is of the text alone: nulls in other columns, repeated ids and
    null ids change nothing.  Null, empty and blank texts are scored as texts
    without words.  Rows that repeat are kept or dropped together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.train(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of near duplicates.

    Null, empty and blank texts are like nothing and stay.  Rows that repeat an
    id are one document, of which one row stays.  Rows without an id, which nothing
    could name later, go.  Nulls in other columns don't matter.
    """
    found = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
    kept = docs.join(found, docs["doc_id"] == found["_kept"], "left_semi")
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null")
    return kept if twice.isEmpty() else kept.dropDuplicates(["doc_id"])


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which at least 5 % of the words are in passages of the benchmark.

    Null, empty and wordless texts are clean.  Rows that share an id go together
    if one of them is contaminated; rows without an id stay.  Items of the benchmark
    without an id count, empty ones don't.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.where("contaminated").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or drop documents so that the sources' words come to their targets.

    Texts without words go.  A null source is a source.  Rows that repeat an id
    or have none are documents of their own.
    """
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token-id files, read them back, and tell each document's place, length and checksum.

    Rows that repeat an id follow one another; rows without an id have no place
    and go; null and empty texts have their end id alone.
    """
    return tokens.token_ids(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_filter),
    ("mixing", mix_sources),
    ("token_ids", token_files),
]

#: Two stages are no SQL: a trained network and a byte-level tokenizer. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last one's result."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
