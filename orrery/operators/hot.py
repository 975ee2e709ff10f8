"""Joins and ranks that a hot key doesn't slow down."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import Scratch

#: A key is hot if it has more than one of so many rows; so many keys are hot at most, and are sent to all tasks.
SHARE = 1024


def lookup(rows: DataFrame, table: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and in ``count`` how many of the ``total`` rows have it.

    Rows of hot keys, of which there are at most SHARE, meet them without a
    shuffle; so no task of the shuffle gets more than a share of the rows for a
    key.  Null keys are equal.  ``rows`` is read twice: it should be a written table.
    """
    keys = {c: f"_hot_key{i}" for i, c in enumerate(on)}
    table = table.withColumnsRenamed(keys)

    def met(some: DataFrame, others: DataFrame, how: str) -> DataFrame:
        same = [some[c].eqNullSafe(others[k]) for c, k in keys.items()]
        return some.join(others, reduce(and_, same), how).drop(*keys.values(), *([] if count in some.columns else [count]))

    hot = F.broadcast(table.where(F.col(count) * SHARE > total))
    rest = met(rows, F.broadcast(table.where(F.col(count) * SHARE > total).select(*keys.values())), "left_anti")
    return met(rows, hot, "inner").unionByName(met(rest, table.where(F.col(count) * SHARE <= total), "inner"))


def indexed(rows: DataFrame, scratch: Scratch, name: str, at: str = "at") -> DataFrame:
    """``rows``, written once, with ``at``: 0 to n - 1 over partitions and the rows in them as they come.

    Each partition numbers its rows; a prefix scan over the partitions' counts,
    a row for each, turns that into one numbering.
    """
    kept = scratch.write(rows.withColumn("_hot_row", F.monotonically_increasing_id()), name)
    part = F.shiftright("_hot_row", 33).alias("_hot_part")
    counts = kept.groupBy(part).agg(F.count("*").alias("_hot_count"))
    before = counts.select("_hot_part", (F.sum("_hot_count").over(W.partitionBy(F.lit(1)).orderBy("_hot_part")) - F.col("_hot_count")).alias("_hot_before"))
    out = kept.withColumn("_hot_part", part).join(F.broadcast(before), "_hot_part")
    return out.withColumn(at, F.col("_hot_before") + F.col("_hot_row").bitwiseAND(F.lit((1 << 33) - 1))).drop("_hot_part", "_hot_before", "_hot_row")


def ordered(rows: DataFrame, by: list[str | Column], scratch: Scratch, name: str, at: str = "at") -> DataFrame:
    """``rows`` with ``at``, their place (from 0) in the order ``by`` over the whole table.

    Ranges of the order are dealt to tasks, so a group with most of the rows is
    spread over many.  Rows that agree in all of ``by`` follow one another, in any order.
    """
    tie = F.monotonically_increasing_id()
    dealt = rows.withColumn("_hot_tie", tie).repartitionByRange(*by, "_hot_tie").sortWithinPartitions(*by, "_hot_tie").drop("_hot_tie")
    return indexed(dealt, scratch, name, at)


def ranked(rows: DataFrame, group: list[str], by: list[str | Column], scratch: Scratch, name: str, at: str = "at") -> tuple[DataFrame, DataFrame]:
    """(rows with their place ``at`` in the order of group and ``by``; a row for each group: first place ``first`` and size ``n``).

    A row's rank in its group is ``at - first``, so that of picks by rank only the
    wanted places are joined, and nothing is sorted group by group.
    """
    placed = ordered(rows, [*group, *by], scratch, name, at)
    return placed, placed.groupBy(*group).agg(F.min(at).alias("first"), F.count("*").alias("n"))
