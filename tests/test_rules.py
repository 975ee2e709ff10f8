"""Rules at their edges: hot medians, two-way matches, labels that nobody knows, scenes in archives."""

import io
import statistics
import zipfile

import numpy as np
from pyspark.sql import functions as F

from orrery.operators import evaluate, scenes, segment, validate
from orrery.sources import scene_archives as S


def test_medians(spark):
    rows = [("hot", float(i * 7919 % 5003)) for i in range(5000)] + [("even", 1.0), ("even", 4.0), ("one", 3.0), (None, 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.m for r in evaluate.medians(df, ["k"], "v", "m").collect()}
    assert got == {k: statistics.median([v for x, v in rows if x == k and v is not None]) for k in ("hot", "even", "one", None)}
    plan = evaluate.medians(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median(" not in plan


def test_one_to_one(spark):
    side = lambda keys: spark.createDataFrame([(k,) for k in keys], "k string")
    found = lambda a, b: sorted((r.rule, r.key or "-") for r in validate.one_to_one(side(a), side(b), "k", "missing", "unknown").collect())
    assert found(["a", "b", "b"], ["b", "c", "c"]) == [("missing", "a"), ("unknown", "c")]
    assert found(["a", None], ["a", None]) == [("missing", "-"), ("unknown", "-")]
    assert found([], []) == []


def test_class_answers(spark):
    names = {0: "sand", 1: "rock", 2: "rock2"}
    images = {"all": [0] * 6 + [1] * 4, "tie": [0, 0, 1, 1], "low": [0] * 4 + [1] * 3 + [2] * 3, "gap": [0] * 8 + [9] * 2, "rocks": [1] * 3 + [9], "little": [0] + [9] * 3, "odd": [0, 0, 0, 5], "null": [0, 0, None], "nothing": [9, 9]}
    df = spark.createDataFrame([(k, v) for k, vs in images.items() for v in vs], "k string, v int").repartition(3)
    got = {r.k: (r.terrain, r.presence, r.reason) for r in scenes.class_answers(df, "k", "v", names, (9,), ("rock", "rock2"), 0.5, 0.5, 3).collect()}
    assert got == {
        "all": ("sand", "YES", None), "tie": ("MIXED", "NO", None), "low": ("MIXED", "YES", None), "gap": (None, None, None), "rocks": (None, "YES", None), "little": (None, None, "insufficient_valid_annotation"),
        "odd": (None, None, "unmapped_label"), "null": (None, None, "unmapped_label"), "nothing": (None, None, "insufficient_valid_annotation"),
    }


def test_channel_statistics(spark):
    r = np.random.default_rng(1)
    rows = [(i, "ab"[i % 3 == 0], r.normal(size=6).tolist(), int(i % 4), 6 - int(i % 4)) for i in range(30)] + [(90, "b", [1.0], 0, 6), (91, "c", None, 1, 5)]
    df = spark.createDataFrame(rows, "id long, g string, x array<double>, f long, b long").repartition(4)
    per, weight = segment.channel_statistics(df, "x", 3, "g", "f", "b")
    x = np.array([row[2] for row in rows[:30]]).reshape(30, 3, 2)
    for row in per.collect():
        assert (row.n, round(row["mean"], 9), round(row["std"], 9)) == (60, round(x[:, row.channel].mean(), 9), round(x[:, row.channel].std(), 9))
    mean = lambda k: sum(np.mean([row[k] for row in rows if row[1] == g]) for g in "abc")
    assert abs(weight.first()[0] - mean(4) / mean(3)) < 1e-9
    assert segment.channel_statistics(df.withColumn("f", F.lit(0)), "x", 3, "g", "f", "b")[1].first()[0] is None


def scene(n, root="s", skip=(), more=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(n):
            for folder, suffix in S.MODALITIES.values():
                if (i, folder) not in skip:
                    z.writestr(f"{root}/image0/{folder}/{1000 + i}{suffix}", f"{folder} of {i}" * 9)
        for name in more:
            z.writestr(name, "x")
    return out.getvalue()


def test_scenes(spark):
    whole = scene(11, skip={(3, "depth"), (4, "label")}, more=["s/image1/color/1003.png", "s/image0/color/deep/9.png", "s/image0/depth/7777.pfm"])
    at = whole.index(b"depth of 5") + 3
    broken = whole[:at] + b"X" + whole[at + 1 :]
    files = spark.createDataFrame([("whole", bytearray(whole)), ("broken", bytearray(broken)), ("short", bytearray(scene(2))), ("none", bytearray(b"no archive"))], "path string, content binary")
    members = S.archive_members(files)
    assert [(r.path, bool(r.problem)) for r in members.where("member is null").collect()] == [("none", True)]
    frames = S.scene_frames(members)
    kept = [f"{1000 + i}" for i in range(11) if i not in (3, 4)]
    assert sorted(r.stem for r in frames.where("path = 'whole'").collect()) == kept
    picks = S.pick_frames(frames, 5)
    assert sorted((r.frame_index, r.stem) for r in picks.where("path = 'whole'").collect()) == [(i, kept[i]) for i in (0, 2, 4, 6, 8)]
    assert sorted((r.path, r.complete, r.n_frames) for r in picks.select("path", "complete", "n_frames").distinct().collect()) == [("broken", True, 9), ("short", False, 2), ("whole", True, 9)]
    every = S.extracted(files, S.pick_frames(frames, 9))
    got = {(r.path, r.stem, r.modality): r for r in every.collect()}
    assert len(got) == 9 * 3 * 2 + 2 * 3
    assert bytes(got["whole", "1005", "depth"].content) == b"depth of 5" * 9 and got["whole", "1005", "depth"].problem is None
    assert got["broken", "1005", "depth"].problem == "checksum" and got["broken", "1005", "depth"].content is None
    assert [k for k, r in got.items() if r.problem] == [("broken", "1005", "depth")]
    index = {(r.path, r.stem): r for r in S.scene_index(every).collect()}
    assert not index["broken", "1005"].usable and index["whole", "1005"].usable
    assert index["whole", "1005"].assets["rgb"].sha256 == got["whole", "1005", "rgb"].sha256 and len(index["whole", "1005"].assets["rgb"].crc32) == 8
    assert {r.problem for r in S.extracted(files, picks, limit=3).collect()} == {"too_large"}
