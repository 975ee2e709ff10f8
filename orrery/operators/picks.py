"""Sequential picks over tables of any size.

A greedy rule looks at all rows for each pick, but few rows can ever win.  Whatever
its counts are, it takes the rows of one class (say, of one scene and one label set)
in one fixed order, so of each class only the first ``k`` can be among ``k`` picks; and
while fewer than ``k`` picks are made, one of the ``k`` classes with the best first rows
is untouched and comes before every other class.  Spark cuts to these rows before
it shuffles; the sequential rule then sees a number of rows that ``k`` bounds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import Scratch
from .hot import ordered


def frontier(rows: DataFrame, track: str, level: str, group: str, order: list[Column], k: int) -> DataFrame:
    """The rows that can be among the first ``k`` picks of a track: at most k rows of k groups for each level.

    ``level`` is what a pick weighs besides the group's count and the fixed
    ``order``; in both steps Spark keeps the first k rows of each task before the shuffle.
    """
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy(track, level, group).orderBy(*order))).where(F.col("_r") <= k)
    best = first.where("_r = 1").withColumn("_g", F.row_number().over(W.partitionBy(track, level).orderBy(*order))).where(F.col("_g") <= k)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (track, level, group)]
    return first.alias("a").join(best.select(track, level, group).alias("b"), same[0] & same[1] & same[2], "left_semi").drop("_r")


def _sequential(frontier_rows: DataFrame, track: str, rule: Callable[[list[dict], int], Iterable[dict]], k: int) -> DataFrame:
    """``rule`` over each track's frontier; its rows with ``pick``, from 0."""
    schema = StructType([*frontier_rows.schema, StructField("pick", LongType())])

    def run(table):
        import pyarrow as pa

        picked = [row | {"pick": i} for i, row in enumerate(rule(table.to_pylist(), k))]
        return pa.Table.from_pylist(picked, schema=table.schema.append(pa.field("pick", pa.int64())))

    return frontier_rows.groupBy(track).applyInArrow(run, schema)


def quantile_edges(rows: DataFrame, value: str, shares: list[float], scratch: Scratch, name: str = "quantiles") -> DataFrame:
    """One row of exact quantiles ``q0``, ``q1``, ... over all values that aren't null, between neighbours in proportion.

    Values are put in order over the whole table, in ranges; only the neighbours
    of each quantile's place are then read.
    """
    placed = ordered(rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), ["v"], scratch, name)
    n = placed.count()
    spots = [share * (n - 1) for share in shares]
    low = [int(s) for s in spots]
    wanted = sorted({i for s in low for i in (s, min(s + 1, n - 1)) if n})
    at = lambda i: F.max(F.when(F.col("at") == i, F.col("v")))
    edge = lambda s, i: at(i) + (at(min(i + 1, n - 1)) - at(i)) * F.lit(float(s - i))
    return placed.where(F.col("at").isin(wanted)).agg(*(edge(s, i).alias(f"q{j}") for j, (s, i) in enumerate(zip(spots, low, strict=True))))


def with_bins(rows: DataFrame, value: str, edges: DataFrame, into: str = "bin") -> DataFrame:
    """``rows`` with the number of edges (one row of them) that a value reaches; null for a null value."""
    reached = sum((F.when(F.col(value).cast("double") >= F.col(c), 1).otherwise(0) for c in edges.columns), F.lit(0))
    return rows.crossJoin(F.broadcast(edges)).withColumn(into, F.when(F.col(value).isNotNull(), reached).cast("long")).drop(*edges.columns)


def _level_rule(rows: list[dict], k: int) -> Iterable[dict]:
    groups, bins, left = Counter(), Counter(), {r["h"]: r for r in rows}
    while left and k > 0:
        best = min(left, key=lambda h: (groups[left[h]["group_id"]], bins[left[h]["bin"]], h))
        row = left.pop(best)
        groups[row["group_id"]] += 1
        bins[row["bin"]] += 1
        k -= 1
        yield row


def balanced(rows: DataFrame, track: str, k: int) -> DataFrame:
    """``k`` rows of each track that keep ``group_id`` and ``bin`` level: least (group's count, bin's count, h) each time.

    ``h`` is a blind order without ties in a track.  Rows come back with ``pick``.
    Null groups and bins are a group and a bin.
    """
    return _sequential(frontier(rows, track, "bin", "group_id", [F.col("h")], k), track, _level_rule, k)


def _scene_rule(rows: list[dict], k: int) -> Iterable[dict]:
    scenes, left = Counter(), {r["h"]: r for r in rows}
    while left and k > 0:
        best = min(left, key=lambda h: (-left[h]["n_labels"], scenes[left[h]["scene"]], -left[h]["least"], h))
        row = left.pop(best)
        scenes[row["scene"]] += 1
        k -= 1
        yield row


def best_first(rows: DataFrame, track: str, k: int = 12) -> DataFrame:
    """``k`` rows of each track: most labels, then the scene taken least often, then the most pixels of the rarest label, then ``h``.

    Rows have scene, labels (an array), least (pixels of the rarest label) and h, an
    order without ties.  Rows without a label or pixels go.
    """
    rows = rows.where(F.size(F.coalesce("labels", F.array().cast(rows.schema["labels"].dataType))) > 0).where("least is not null")
    rows = rows.withColumn("n_labels", F.size(F.array_distinct("labels")).cast("long"))
    return _sequential(frontier(rows, track, "n_labels", "scene", [F.desc("least"), F.col("h")], k), track, _scene_rule, k)


def label_support(picks: DataFrame, track: str, labels: list[str], least: int = 10) -> DataFrame:
    """(track, label, n, enough) for every wanted label of every track, also those that no pick has."""
    has = picks.select(track, F.explode(F.array_distinct("labels")).alias("label")).groupBy(track, "label").agg(F.count("*").alias("n"))
    wanted = picks.select(track).distinct().select(track, F.explode(F.array(*map(F.lit, labels))).alias("label"))
    return wanted.join(has, [track, "label"], "left").select(track, "label", F.coalesce("n", F.lit(0)).alias("n")).withColumn("enough", F.col("n") >= least)


def farthest(rows: DataFrame, track: str, key: str, x: str, y: str, k: int, scratch: Scratch) -> DataFrame:
    """``k`` rows of each track, each as far as can be from those before, in the unit square; the first by sha256 of the key.

    ``pick`` is a round: one maximum for each track over the distances to the
    points so far, of which a row for each track is sent along.  Ties go to the
    greater key as text.  Rows without a coordinate go.
    """
    own = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(track).alias("t"), F.col(key).cast("string").alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    span = own.groupBy(F.col("t").alias("_t")).agg(*(f(c).alias(f"{n}{c}") for c in "xy" for f, n in ((F.min, "a"), (F.max, "b"))))
    unit = lambda c: ((F.col(c) - F.col(f"a{c}")) / F.greatest(F.col(f"b{c}") - F.col(f"a{c}"), F.lit(1e-12))).alias(c)
    own = scratch.write(own.join(span, F.col("t").eqNullSafe(F.col("_t"))).select("t", "i", unit("x"), unit("y")), "points")
    point = F.struct("i", "x", "y")
    chosen = own.groupBy("t").agg(F.array(F.min_by(point, F.sha2("i", 256))).alias("chosen"))
    for round_ in range(1, k):
        chosen = scratch.write(chosen, f"round{round_}").withColumnRenamed("t", "_t")
        square = lambda p: (F.col("x") - p["x"]) * (F.col("x") - p["x"]) + (F.col("y") - p["y"]) * (F.col("y") - p["y"])
        far = own.join(chosen, F.col("t").eqNullSafe(F.col("_t"))).where(~F.exists("chosen", lambda p: p["i"] == F.col("i")))
        far = far.withColumn("d", F.array_min(F.transform("chosen", square))).groupBy("_t").agg(F.max_by(point, F.struct("d", "i")).alias("next"))
        more = chosen.join(far.withColumnRenamed("_t", "_f"), F.col("_t").eqNullSafe(F.col("_f")), "left")
        chosen = more.select(F.col("_t").alias("t"), F.when(F.col("next").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("next"))).alias("chosen"))
    return chosen.select(F.col("t").alias(track), F.posexplode("chosen").alias("pick", "p")).select(track, F.col("p.i").alias(key), F.col("pick").cast("long").alias("pick"))
