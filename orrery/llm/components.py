"""Connected components of an edge table, as joins and aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``edges``: the smallest id reachable.

    Alternates large-star and small-star until the edges are stars.  Each step
    hooks ids to the smallest neighbour they see, so the number of steps grows
    with the logarithm of the longest path.  A step only takes minima per id
    (combined before the shuffle) and one equi-join that adaptive execution
    splits where an id has very many edges.  Null ends and loops are ignored;
    an empty table gives an empty result.
    """
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    name, step = f"cc{uuid.uuid4().hex[:6]}-", 0
    now = scratch.write(now, f"{name}0")
    while True:
        # A star forest is done: no leaf has two centres, and no centre is a leaf.
        role = now.select(F.col("v").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(now.select("u", F.lit(0), F.lit(1)))
        role = role.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        if role.where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(least, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u < v")
            .distinct()
        )
        step += 1
        now = scratch.write(small, f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
    leaves = now.select(F.col("v").alias("id"), F.col("u").alias("component"))
    return leaves.unionByName(now.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
