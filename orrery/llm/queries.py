"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chains, decontaminate, exact, fim, lattice, minhash, mixing, ngram, oracle, quality, suffix, tokens, trie
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.document_tokens(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A passage of over fifty words may have fewer bytes than a string that the contract removes.
    shares = suffix.sharing_passages(docs).withColumn("shares_passage", F.lit(True))
    return suffix.without_repeats(docs).drop("runs").join(shares, "doc_id", "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(False)))


def op7_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(_table(spark, sf_dir, "documents"))


def op8_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return ngram.cross_entropy_difference(_table(spark, sf_dir, "documents"), good)


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "trie")
    turns, convs = trie.rebuilt(_table(spark, sf_dir, "conversations"), scratch)
    return trie.prefix_trie(turns, convs, scratch)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fim.arranged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    f = lambda c: F.col("fim." + c)
    return docs.select(
        "doc_id", "fim.n", "fim.form", F.char_length(f("prefix")).cast("long").alias("prefix_chars"), F.char_length(f("middle")).cast("long").alias("middle_chars"),
        F.sha2(f("output"), 256).alias("output_sha256"), F.sha2(fim.restored(f("output"), f("form")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
