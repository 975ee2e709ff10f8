"""Bounded picks against the plain sequential rules, and ranks of a group that has all rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import hot, picks, select
from orrery.sources.shared import Scratch


def h(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def plain(rows, k, key, count):
    """Always the least row of all that are left."""
    left, out, seen = list(rows), [], [Counter() for _ in count]
    while left and len(out) < k:
        best = min(left, key=lambda r: key(r, seen))
        left.remove(best)
        out.append(best)
        for c, name in zip(seen, count, strict=True):
            c[best[name]] += 1
    return out


@pytest.mark.parametrize("seed,groups", [(1, 3), (2, 60), (3, 1), (4, 400)])
def test_balanced(spark, seed, groups):
    r = random.Random(seed)
    # A third of the rows in one group; null groups and bins are values like others.
    rows = [dict(track="ab"[i % 2], id=i, group_id=r.choice(["hot", f"g{r.randrange(groups)}", f"g{r.randrange(groups)}", None]), bin=r.choice([0, 1, 1, 1, 3, None]), h=h(i)) for i in range(900)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "track string, id long, group_id string, bin long, h string").repartition(5)
    for k in (1, 12, 40):
        got = {t: [x.id for x in sorted(picks.balanced(df, "track", k).where(F.col("track") == t).collect(), key=lambda x: x.pick)] for t in "ab"}
        for t in "ab":
            want = plain([x for x in rows if x["track"] == t], k, lambda x, c: (c[0][x["group_id"]], c[1][x["bin"]], x["h"]), ["group_id", "bin"])
            assert got[t] == [x["id"] for x in want]


@pytest.mark.parametrize("seed,scenes", [(1, 2), (2, 50), (3, 500)])
def test_best_first(spark, seed, scenes):
    r, names = random.Random(seed), ["a", "b", "c", "d"]
    rows = [dict(track="t", id=i, scene=r.choice([None, 0, r.randrange(scenes), r.randrange(scenes)]), labels=r.sample(names, r.choice([0, 1, 2, 2, 4])), least=r.choice([1, 5, 5, 9]), h=h(i)) for i in range(700)]
    df = spark.createDataFrame([tuple(x.values()) for x in rows], "track string, id long, scene long, labels array<string>, least int, h string").repartition(4)
    for k in (12, 33):
        got = sorted(picks.best_first(df, "track", k).collect(), key=lambda x: x.pick)
        want = plain([x for x in rows if x["labels"]], k, lambda x, c: (-len(x["labels"]), c[0][x["scene"]], -x["least"], x["h"]), ["scene"])
        assert [x.id for x in got] == [x["id"] for x in want]
    support = {x.label: (x.n, x.enough) for x in picks.label_support(picks.best_first(df, "track", 12), "track", [*names, "none"], 10).collect()}
    n = Counter(c for x in plain([x for x in rows if x["labels"]], 12, lambda x, c: (-len(x["labels"]), c[0][x["scene"]], -x["least"], x["h"]), ["scene"]) for c in x["labels"])
    assert support == {c: (n[c], n[c] >= 10) for c in [*names, "none"]}


def test_the_frontier_is_small(spark):
    df = spark.range(60_000).select(F.lit("t").alias("track"), F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("group_id"), (F.col("id") % 4).alias("bin"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    front = picks.frontier(df, "track", "bin", "group_id", [F.col("h")], 12)
    assert front.count() <= 4 * 12 * 12
    assert "WindowGroupLimit" in front._jdf.queryExecution().executedPlan().toString()  # the cut is made before the shuffle


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles(spark, n):
    r = random.Random(n)
    values = [r.choice([r.gauss(0, 1), 0.5]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(6)
    edges = picks.quantile_edges(df, "v", [0, 0.25, 0.5, 0.9, 1], Scratch(spark, "q"))
    assert list(edges.first()) == pytest.approx(list(np.quantile(values, [0, 0.25, 0.5, 0.9, 1])))
    got = picks.with_bins(df, "v", edges.select("q1", "q2", "q3")).collect()
    inner = np.array(edges.select("q1", "q2", "q3").first(), float)
    assert all(x.bin == (None if x.v is None else np.searchsorted(inner, x.v, side="right")) for x in got) and len(got) == n + 1


def test_farthest_points(spark):
    r = random.Random(5)
    rows = [("ab"[i % 2], i, float(r.randrange(30)), float(r.randrange(12))) for i in range(300)] + [("one", 1000, 1.0, 2.0), ("b", 2000, None, 1.0), (None, 3000, 5.0, 5.0), (None, 3001, 6.0, 5.0)]
    df = spark.createDataFrame(rows, "track string, id long, x double, y double").repartition(3)
    got = picks.farthest(df, "track", "id", "x", "y", 6, Scratch(spark, "far")).collect()
    for t in ("a", "b", "one", None):
        own = [x for x in rows if x[0] == t and x[2] is not None]
        xy = np.array([x[2:] for x in own])
        xy = (xy - xy.min(0)) / np.maximum(xy.max(0) - xy.min(0), 1e-12)
        chosen = [min(range(len(own)), key=lambda j: h(own[j][1]))]
        while len(chosen) < min(6, len(own)):
            far = ((xy[:, None] - xy[chosen]) ** 2).sum(-1).min(1)
            chosen.append(max((j for j in range(len(own)) if j not in chosen), key=lambda j: (far[j], str(own[j][1]))))
        assert [x.id for x in sorted((x for x in got if x.track == t), key=lambda x: x.pick)] == [str(own[j][1]) for j in chosen]


def test_ranks_of_one_group_with_all_rows(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), ((F.col("id") * 7919) % 20_011).alias("v"), "id").repartition(8)
    values = sorted((i * 7919) % 20_011 for i in range(20_000))
    turns = select.round_robin(df, "g", [F.col("v")], F.col("g"))
    assert sorted((r.turn, r.v) for r in turns.select("turn", "v").collect()) == list(enumerate(values, 1))
    assert "row_number" not in turns._jdf.queryExecution().executedPlan().toString()
    assert [r.v for r in select.middle(df, "g", ["v", "id"]).collect()] == [values[10_000]]
    spots = select.evenly_spaced(df, "g", "v", 5).collect()
    assert sorted((r.i, r.v) for r in spots) == [(i, values[i]) for i in (0, 5000, 10_000, 14_999, 19_999)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        scratch = Scratch(spark, "o")
        placed = hot.ordered(df, ["g", "v"], scratch, "o")
        assert [r.v for r in placed.orderBy("at").collect()] == values
        written = spark.read.parquet(f"{scratch.path}/o")
        assert max(r["count"] for r in written.groupBy(F.shiftright("_hot_row", 33)).count().collect()) < 10_000  # dealt to four tasks
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_keep_null_groups_and_ties(spark):
    rows = [(g, v) for g in ("a", None, "b") for v in (1, 1, 2, None)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(3)
    got = select.round_robin(df, "g", [F.col("v").asc_nulls_first()], F.coalesce("g", F.lit("-"))).collect()
    assert sorted((r.group_key, r.turn, r.v or 0) for r in got) == [(g, i, v) for g in "-ab" for i, v in enumerate((0, 1, 1, 2), 1)]
    assert select.evenly_spaced(df, "g", "v", 9).count() == 12 and select.middle(df, "g", ["v"]).count() == 3
    assert select.round_robin(df.where("false"), "g", [F.col("v")], F.col("g")).count() == 0
