"""Rules that return violations as rows (rule, key, detail); an empty result means that a manifest is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import labels_distinct

FORBIDDEN_IN_INPUTS = ("answer", "mask", "mask_sha256", "classes", "truth", "target")


def duplicates(rows: DataFrame, key: str, rule: str) -> DataFrame:
    out = rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return out.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail"))


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that a row breaks; a null rule counts as broken."""
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(failed).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def unmatched(a: DataFrame, b: DataFrame, key: str, rule: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    out = a.select(key).distinct().join(b.select(key), key, "left_anti")
    return out.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def one_to_one(a: DataFrame, b: DataFrame, key: str, missing: str, unknown: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks and keys of ``b`` that ``a`` lacks, by one full join of the distinct keys; null keys are a violation of either side."""
    own = a.select(F.col(key).alias("_a")).distinct().join(b.select(F.col(key).alias("_b")).distinct(), F.col("_a") == F.col("_b"), "full")
    lacking = own.where("_a is null or _b is null")
    side = F.when(F.col("_b").isNull() & F.col("_a").isNotNull(), F.array(F.lit(missing))).when(F.col("_a").isNull() & F.col("_b").isNotNull(), F.array(F.lit(unknown)))
    named = lacking.select(F.explode(side).alias("rule"), F.coalesce("_a", "_b").cast("string").alias("key"))
    nulls = [rows.where(F.col(key).isNull()).limit(1).select(F.lit(rule).alias("rule"), F.lit(None).cast("string").alias("key")) for rows, rule in ((a, missing), (b, unknown))]
    return named.unionByName(nulls[0]).unionByName(nulls[1]).withColumn("detail", F.lit(""))


def single_valued(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata columns with more than one value."""
    n = rows.agg(*(F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("\0null"))).alias(c) for c in columns))
    each = n.select(F.explode(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*")
    return each.where("n > 1").select(F.lit("single_valued").alias("rule"), "key", F.concat(F.lit("n="), F.col("n").cast("string")).alias("detail"))


def request_rules() -> dict[str, Column]:
    return {
        "request_id_blank": F.trim("request_id") != "",
        "labels_ambiguous": labels_distinct(F.col("allowed_answers")),
        "max_new_tokens": F.col("max_new_tokens") >= 1,
        "prompt_blank": F.trim("prompt") != "",
        "do_sample_null": F.col("do_sample").isNotNull(),
    }


def image_rules() -> dict[str, Column]:
    """Rules of a request's images: safe paths, and names of modalities that are given and differ."""
    names = F.transform("modality_paths", lambda m: m["name"])
    return {
        "images_missing": F.size("image_paths") > 0,
        "path_unsafe": F.forall("image_paths", safe_path) & F.forall("modality_paths", lambda m: safe_path(m["path"])),
        "modality_names": (F.size(F.array_distinct(names)) == F.size(names)) & ~F.exists(names, lambda n: n.isNull() | (F.trim(n) == "")),
    }


def prediction_rules() -> dict[str, Column]:
    return {
        "status_unknown": F.col("status").isin("ok", "error", "unsupported"),
        "seconds_not_finite": ~F.isnan("elapsed_seconds") & (F.col("elapsed_seconds") >= 0) & (F.col("elapsed_seconds") < float("inf")),
        "response_null": F.col("raw_response").isNotNull(),
    }


def fingerprint_rules(column: str = "request_manifest_sha256") -> dict[str, Column]:
    """An optional hash has 64 lower-case hexadecimal digits."""
    return {"fingerprint_format": F.col(column).isNull() | F.col(column).rlike(r"^[0-9a-f]{64}$")}


PROVENANCE = ("task_id", "condition_id", "group_id", "answer", "reference_status")


def pairing_violations(left: DataFrame, right: DataFrame, key: str = "request_id", columns: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """What keeps two runs from being compared: keys of one side alone, and provenance that differs, a row for each column."""
    both = left.select(key, F.lit(True).alias("_l"), *(F.col(c).alias(f"l_{c}") for c in columns)).join(right.select(key, F.lit(True).alias("_r"), *(F.col(c).alias(f"r_{c}") for c in columns)), key, "full")
    differs = [F.when(F.col("_l") & F.col("_r") & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), f"{c}_differs") for c in columns]
    rules = F.array_compact(F.array(F.when(F.col("_l").isNull(), "left_missing"), F.when(F.col("_r").isNull(), "right_missing"), *differs))
    return both.select(F.explode(rules).alias("rule"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))


def resume_violations(requests: DataFrame, done: DataFrame, key: str = "request_id") -> DataFrame:
    """Rows of a response log that forbid resuming: requests answered twice, and answers to requests that aren't there."""
    return duplicates(done, key, "done_twice").unionByName(unmatched(done, requests, key, "done_foreign"))


def identifier(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$")


def safe_path(path: Column) -> Column:
    """Relative, without steps up, drive letters or back slashes."""
    return ~(path.rlike(r"^/|^[A-Za-z]:|\\") | F.array_contains(F.split(path, "/"), ".."))


def assert_no_leak(rows: DataFrame, forbidden: tuple[str, ...] = FORBIDDEN_IN_INPUTS) -> DataFrame:
    leaked = sorted(set(rows.columns) & set(forbidden))
    if leaked:
        raise ValueError(f"inputs hold target columns: {leaked}")
    return rows


def require_empty(violations: DataFrame) -> None:
    """Raise with the first few violations; the one action here, for use before a sink."""
    first = violations.limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.rule}: {r.key} {r.detail}".strip() for r in first))


def reasons(rows: DataFrame, key: str, rules: list[tuple[str, Column]]) -> DataFrame:
    """(key, reason): the first reason that excludes a row, null for rows that are kept."""
    out = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        out = F.when(bad, name).otherwise(out)
    return rows.select(key, out.alias("reason"))
