"""Deterministic selection: hash order, spreading over groups, ranks and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import hash_order
from ..sources.shared import Scratch
from .hot import lookup, ranked


def hash_topk(rows: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """The first ``n`` rows in blind order: a take-ordered plan, one small heap for each task."""
    return rows.withColumn("h", hash_order(seed, F.col(key))).orderBy("h", key).limit(n)


def round_robin(rows: DataFrame, group: str, order: list[Column], group_order: Column, taken: int | None = None) -> DataFrame:
    """Rows with ``turn``, their number in their group: by turn, then group, this visits each group once a round.

    With ``taken`` only the first rounds are kept, which Spark cuts before the
    shuffle.  Without it turns come from places in the order of the whole table,
    so a group with most of the rows is no task of its own.
    """
    if taken:
        out = rows.withColumn("turn", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("turn") <= taken)
    else:
        scratch = Scratch(rows.sparkSession, "turns")
        placed, groups = ranked(rows, [group], order, scratch, "placed", "_at")
        groups = scratch.write(groups.withColumnsRenamed({"first": "_first", "n": "_n"}), "groups")
        total = groups.agg(F.sum("_n")).first()[0] or 0
        out = lookup(placed, groups, [group], "_n", total).withColumn("turn", (F.col("_at") - F.col("_first") + 1).cast("int")).drop("_at", "_first")
    return out.withColumn("group_key", group_order)


def latest_valid(rows: DataFrame, key: str, by: str, signature: str, current: DataFrame) -> DataFrame:
    """Of each key in ``current`` (key, signature) the row of the greatest ``by``, with ``valid``: whether its signature is still the current one.

    An older row that would fit doesn't stand in for a newest one that doesn't.
    """
    newest = latest(rows, key, by).withColumnRenamed(signature, "_s")
    out = current.select(key, F.col(signature).alias("_now")).join(newest, key, "left")
    return out.withColumn("valid", F.coalesce(F.col("_s") == F.col("_now"), F.lit(False))).drop("_s", "_now")


def _at_places(rows: DataFrame, group: str, order: list[str | Column], spots: Column, name: str) -> DataFrame:
    """The rows of each group at the places ``spots`` (an array, from 0, made of the group's size ``n``), with their place ``i``."""
    scratch = Scratch(rows.sparkSession, name)
    placed, groups = ranked(rows, [group], order, scratch, "placed", "_at")
    wanted = groups.select("first", F.explode(spots).alias("i")).select((F.col("first") + F.col("i")).alias("_at"), "i")
    return placed.join(wanted, "_at").drop("_at")


def evenly_spaced(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """Up to ``k`` rows of each group at round(i (n - 1) / (k - 1)) (half to even); the middle one for k = 1."""
    n = F.col("n")
    spots = F.when(n <= k, F.sequence(F.lit(0).cast("long"), n - 1))
    return _at_places(rows, group, [order], spots.otherwise(F.array(F.expr("n div 2")) if k == 1 else F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(k - 1)), 0).cast("long"))), "spaced")


def top_distinct(rows: DataFrame, anchor: str, dedupe: Column, order: list[Column], k: int = 3) -> DataFrame:
    """The best ``k`` candidates of each anchor, of which no two agree on ``dedupe``."""
    # Dealt by anchor once, which serves both windows.
    first = rows.repartition(anchor).withColumn("_d", dedupe).withColumn("_r", F.row_number().over(W.partitionBy(anchor, "_d").orderBy(*order))).where("_r = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(anchor).orderBy(*order))).where(F.col("rank") <= k).drop("_d", "_r")


def priority_first(rows: DataFrame, name: str, priority: Column, order: list[Column]) -> DataFrame:
    """One row for each name: that of the smallest priority."""
    out = rows.withColumn("priority", priority).withColumn("_r", F.row_number().over(W.partitionBy(name).orderBy("priority", *order)))
    return out.where("_r = 1").drop("_r")


def latest(rows: DataFrame, key: str, by: str) -> DataFrame:
    """The row of the greatest ``by`` for each key, by one aggregate."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), by).alias("r")).select(key, "r.*")


def middle(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    return _at_places(rows, group, order, F.array(F.expr("n div 2")), "middle").drop("i")


def page(rows: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset at least 0")
    return rows.orderBy(*order).offset(offset).limit(limit)


def histogram_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Smallest value up to which at least half of a group's rows lie."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = W.partitionBy(group)
    run = counts.withColumns({"cum": F.sum("c").over(w.orderBy(value)), "total": F.sum("c").over(w)})
    return run.where("2 * cum >= total").groupBy(group).agg(F.min(value).alias("median"), F.max("total").alias("n"))


def early_stopping(rows: DataFrame, run: str, step: str, value: str, gain: float = 1e-8, patience: int = 8) -> DataFrame:
    """Per step: best value before, whether the step improves on it, steps since the last improvement, and whether training stops there."""
    w = W.partitionBy(run).orderBy(step)
    out = rows.withColumn("best_before", F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1)))
    out = out.withColumn("improved", F.col("best_before").isNull() | (F.col(value) > F.col("best_before") + gain))
    out = out.withColumn("_at", F.row_number().over(w)).withColumn("_last", F.max(F.when(F.col("improved"), F.col("_at"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("wait", F.col("_at") - F.col("_last")).withColumn("stop", F.col("wait") >= patience).drop("_at", "_last")


def proportional_quotas(sizes: DataFrame, key: str, size: str, total: int, cap: int) -> DataFrame:
    """Largest-remainder quotas of ``total`` in proportion to sizes, none above ``cap`` nor its own size.

    One row for each scene; capped scenes are set first, in closed form, the rest shares what is left.
    """
    every = W.partitionBy(F.lit(1))
    largest = every.orderBy(F.col(size).desc(), key)
    top = F.least(F.col(size), F.lit(cap))
    # Larger scenes meet the cap first: one is capped if all before it are and its share of what they leave reaches its top.
    before = F.coalesce(F.sum(top).over(largest.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(size).over(largest.rowsBetween(0, W.unboundedFollowing))
    now = sizes.withColumn("full", F.coalesce((F.lit(total) - before) * F.col(size) / rest >= top, F.lit(True)).cast("int"))
    now = now.withColumn("q", F.when(F.min("full").over(largest.rowsBetween(W.unboundedPreceding, 0)) == 1, top).cast("long")).drop("full")
    free = F.col("q").isNull()
    left = F.lit(total) - F.coalesce(F.sum("q").over(every), F.lit(0))
    now = now.withColumn("e", F.when(free, left * F.col(size) / F.sum(F.when(free, F.col(size))).over(every)))
    now = now.withColumn("f", F.floor("e")).withColumn("rest", left - F.sum("f").over(every))
    rank = F.row_number().over(every.orderBy((F.col("e") - F.col("f")).desc_nulls_last(), key))
    return now.withColumn("rank", rank).select(key, size, F.coalesce("q", F.col("f") + F.when(F.col("rank") <= F.col("rest"), 1).otherwise(0)).cast("long").alias("quota"))
