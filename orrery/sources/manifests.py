"""JSON-lines manifests with fixed schemas, identities, and sinks that never overwrite."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUESTS = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("image_paths", T.ArrayType(T.StringType())), T.StructField("prompt", T.StringType()),
    T.StructField("allowed_answers", T.ArrayType(T.StringType())), T.StructField("max_new_tokens", T.IntegerType()), T.StructField("do_sample", T.BooleanType()),
    T.StructField("modality_paths", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("path", T.StringType())]))),
])
TARGETS = T.StructType([T.StructField(c, T.StringType()) for c in ("request_id", "source_sample_id", "group_id", "derivation_version", "answer", "task_id", "condition_id", "reference_status", "review_status")])
PREDICTIONS = T.StructType([
    T.StructField("request_id", T.StringType()), T.StructField("raw_response", T.StringType()), T.StructField("status", T.StringType()), T.StructField("elapsed_seconds", T.DoubleType()),
    T.StructField("error_message", T.StringType()), T.StructField("model_id", T.StringType()), T.StructField("run_id", T.StringType()), T.StructField("mock", T.BooleanType()), T.StructField("request_manifest_sha256", T.StringType()),
])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines manifest; a byte-order mark and blank lines are skipped, a broken line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def resolve(rows: DataFrame, column: str, root: str) -> DataFrame:
    """Relative paths of an array column, taken from the manifest's folder."""
    base = root.rstrip("/")
    return rows.withColumn(column, F.transform(column, lambda p: F.when(p.rlike(r"^(/|[a-z]+://)"), p).otherwise(F.concat(F.lit(base + "/"), p))))


def write_once(rows: DataFrame, path: str, kind: str = "json") -> None:
    """Fails if the path exists; the writer's commit makes the folder appear with its success mark."""
    rows.write.mode("errorifexists").format(kind).save(path)


def create_or_verify(rows: DataFrame, path: str) -> str:
    """'created', or 'verified' if a data set with the same rows is there; ValueError if it differs."""
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        rows.write.mode("errorifexists").parquet(path)
        return "created"
    old = spark.read.parquet(path)
    if old.columns != rows.columns or not old.exceptAll(rows).isEmpty() or not rows.exceptAll(old).isEmpty():
        raise ValueError(f"{path} exists with other rows")
    return "verified"


@F.pandas_udf(T.StringType())
def canonical(rows: pd.Series) -> pd.Series:
    """JSON text of objects given as JSON: sorted keys, default separators, letters as they are."""
    return rows.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False))


def digest(value: object, *, ascii_only: bool = False, compact: bool = False) -> str:
    """SHA-256 of an object's canonical JSON."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=ascii_only, separators=(",", ":") if compact else None, allow_nan=False)
    return hashlib.sha256(text.encode()).hexdigest()


def row_digests(rows: DataFrame) -> DataFrame:
    """SHA-256 of each row's canonical JSON."""
    return rows.select(F.sha2(canonical(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})), 256).alias("row_sha"))


def fingerprint(rows: DataFrame) -> DataFrame:
    """(n, fingerprint) that no order of rows changes: eight sums of the parts of the row digests, and their digest.

    Only sums meet in one row, so a table of any size has a fingerprint.  It tells
    accidental changes, not forged ones; ``records_fingerprint`` is the exact identity.
    """
    own = row_digests(rows)
    part = lambda k: F.conv(F.substring("row_sha", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = own.agg(F.count("*").alias("n"), *(F.sum(part(k)).alias(f"s{k}") for k in range(8)))
    return sums.select("n", F.sha2(F.concat_ws(":", "n", *(F.col(f"s{k}").cast("string") for k in range(8))), 256).alias("fingerprint"))


def records_fingerprint(rows: DataFrame, key: str = "request_id") -> str:
    """SHA-256 of a manifest's canonical JSON: an array of its rows in the order of ``key``, without null fields.

    Rows are sorted in the cluster and hashed as they stream by, partition by
    partition, so that the driver holds a few at a time.
    """
    text = rows.select(F.col(key).alias("_key"), canonical(F.to_json(F.struct(*rows.columns))).alias("_text")).orderBy("_key", "_text").select("_text")
    digest_, lead = hashlib.sha256(b"["), b""
    for row in text.toLocalIterator():
        digest_.update(lead + row[0].encode())
        lead = b", "
    digest_.update(b"]")
    return digest_.hexdigest()


def embedded_images(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """Image and mask pairs of Parquet files that hold the bytes; without ``content`` only names and sizes are read."""
    rows = spark.read.parquet(path)
    columns = [F.col("image.path").alias("image"), F.col("mask.path").alias("mask"), "width", "height", "class_labels"]
    if content:
        columns += [F.col("image.bytes").alias("image_bytes"), F.col("mask.bytes").alias("mask_bytes"), F.sha2("image.bytes", 256).alias("image_sha256"), F.sha2("mask.bytes", 256).alias("mask_sha256")]
    return rows.select(*columns)


def write_sorted(rows: DataFrame, path: str, *keys: str, kind: str = "json") -> None:
    """Rows in the order of their keys, file by file, for reports that people compare; never overwrites."""
    rows.orderBy(*keys).write.mode("errorifexists").format(kind).save(path)
