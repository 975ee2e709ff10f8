"""Strict scans of JSON-lines manifests: a broken line is named by file and line, however the files are split."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .manifests import REQUESTS, read_jsonl, resolve

#: Fields of a request, and those that must be arrays (a null or absent allowed_answers too is refused).
REQUEST_FIELDS = tuple(f.name for f in REQUESTS.fields)
REQUEST_ARRAYS = {"image_paths": False, "allowed_answers": True, "modality_paths": False}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): lines as Spark's splits give them; ``at`` grows along a split, which one task reads."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    return rows.withColumn("at", F.monotonically_increasing_id())


def _before(blocks: DataFrame) -> DataFrame:
    """Blocks (path, block, n, ...) with ``before``, the lines of the same file in the blocks before."""
    order = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row for each split
    return blocks.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value) of all lines, numbered from 1 in their file.

    A split's lines are counted, a prefix scan over the splits of each file gives
    where a split begins, and a line adds its place in its split.
    """
    rows = _lines(spark, path)
    blocks = _before(rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")))
    return rows.join(blocks, ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def problem_of(text: str | None, allowed: frozenset[str] | None, arrays: dict[str, bool], pairs: frozenset[str]) -> str | None:
    """What is wrong with one line, None for nothing; see ``line_problem``."""
    text = (text or "").removeprefix("\ufeff")
    if not text.strip():
        return None
    try:
        row = json.loads(text)
    except json.JSONDecodeError as error:
        return f"invalid JSON: {error.msg}"
    except RecursionError:
        return "invalid JSON: nested too deeply"
    if not isinstance(row, dict):
        return "expected a JSON object"
    if allowed is not None and (unknown := sorted(set(row) - allowed)):
        return f"unknown fields: {', '.join(unknown)}"
    for name, needed in arrays.items():
        found = row.get(name, None if needed else [])
        if not isinstance(found, list):
            return f"{name} must be an array"
        if name in pairs and any(not (isinstance(p, list) and len(p) == 2 or isinstance(p, dict) and set(p) == {"name", "path"}) for p in found):
            return f"{name} needs name and path pairs"
    return None


def line_problem(value: Column, allowed: Iterable[str] | None = None, arrays: dict[str, bool] | None = None, pairs: Iterable[str] = ()) -> Column:
    """What is wrong with a line of JSON, null for nothing: not JSON, no object, a field that isn't allowed, a scalar for an array.

    Of ``arrays`` true ones must be there.  ``pairs`` are arrays of two-element
    arrays or name and path objects.  Blank lines and a byte-order mark are nothing.
    """
    allowed, arrays, pairs = None if allowed is None else frozenset(allowed), dict(arrays or {}), frozenset(pairs)

    @F.pandas_udf(T.StringType())
    def problems(values: pd.Series) -> pd.Series:
        return values.map(lambda text: problem_of(text, allowed, arrays, pairs))

    return problems(value)


def faults(spark: SparkSession, path: str, **rules) -> DataFrame:
    """(path, line, problem): the first broken line of each split, from one scan.

    A split comes back as a row, its number of lines and its first fault; so a
    manifest that is broken throughout costs no more than one that isn't.
    """
    rows = _lines(spark, path).withColumn("problem", line_problem(F.col("value"), **rules))
    bad = F.min(F.when(F.col("problem").isNotNull(), F.struct("at", "problem"))).alias("bad")
    blocks = _before(rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"), bad))
    return blocks.where("bad is not null").select("path", (F.col("before") + F.col("bad.at") - F.col("first") + 1).alias("line"), F.col("bad.problem").alias("problem"))


def read_strict(spark: SparkSession, path: str, schema: T.StructType, **rules) -> DataFrame:
    """The rows of a manifest, after a scan of all lines; ValueError 'file:line: problem' for the first that is broken."""
    first = faults(spark, path, **rules).orderBy("path", "line").first()
    if first:
        raise ValueError(f"{first.path}:{first.line}: {first.problem}")
    return read_jsonl(spark, path, schema)


def repeated(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n, path, line, again_path, again_line) of keys that several lines of a manifest have: the first two lines by file and line."""
    rows = numbered_lines(spark, path).select(F.get_json_object(F.ltrim(F.regexp_replace("value", "^﻿", "")), f"$.{key}").alias("key"), F.struct("path", "line").alias("at")).where("key is not null")
    twice = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("at").alias("one")).where("n > 1")
    # The second: the least of what isn't the first; an equi-join on keys that repeat, each row once.
    two = rows.join(twice.select(F.col("key").alias("_k"), "one"), F.col("key") == F.col("_k")).where(F.col("at") > F.col("one")).groupBy("_k").agg(F.min("at").alias("two"))
    return twice.join(two, F.col("key") == F.col("_k")).select("key", "n", F.col("one.path").alias("path"), F.col("one.line").alias("line"), F.col("two.path").alias("again_path"), F.col("two.line").alias("again_line"))


def read_requests(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """A request manifest: known fields only, arrays where arrays belong, some row, each id once; paths taken from ``root``."""
    rows = read_strict(spark, path, REQUESTS, allowed=REQUEST_FIELDS, arrays=REQUEST_ARRAYS, pairs=("modality_paths",))
    if rows.isEmpty():
        raise ValueError(f"{path}: the manifest is empty")
    if rows.where("request_id is null").count():
        raise ValueError(f"{path}: a request has no request_id")
    twice = repeated(spark, path, "request_id").orderBy("path", "line").first()
    if twice:
        raise ValueError(f"{twice.again_path}:{twice.again_line}: request_id {twice.key} is also in line {twice.line} of {twice.path}")
    return rows if root is None else resolve(rows, "image_paths", root)
