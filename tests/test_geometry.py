import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions.geometry import box_geometry, iou
from orrery.functions.hashing import chunks, digest_modulo, effect_seed, from_hex, hamming
from orrery.operators import audit, rasters, scenes, segment


def geometry(spark, box, truncated=False, size=300):
    df = spark.createDataFrame([(list(map(float, box)), truncated)], "b array<double>, t boolean")
    return df.select(box_geometry(F.col("b"), F.col("t"), F.lit(size), F.lit(size)).alias("g")).first().g


def test_boundaries_go_right_and_down(spark):
    assert geometry(spark, (140, 140, 160, 160)).half == "RIGHT"
    assert geometry(spark, (90, 90, 110, 110)).cell == 5
    assert geometry(spark, (88, 88, 110, 110)).cell == 1


def test_eligibility_is_inclusive(spark):
    assert geometry(spark, (1, 1, 13, 13)).eligible and not geometry(spark, (1, 1, 12.9, 13)).eligible
    assert not geometry(spark, (0, 1, 20, 20)).eligible and geometry(spark, (200, 200, 299, 299)).eligible
    assert not geometry(spark, (10, 10, 50, 50), truncated=True).eligible


def test_iou(spark):
    df = spark.createDataFrame([([0.0, 0.0, 2.0, 2.0], [1.0, 1.0, 3.0, 3.0]), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(iou(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 7), 0]


def test_largest_and_ties(spark):
    cols = "image long, size_proxy double, cell int, half string"
    rows = spark.createDataFrame([(1, 10.0, 5, "LEFT"), (1, 9.6, 3, "RIGHT"), (2, 10.0, 2, "LEFT"), (2, 9.4, 3, "LEFT")], cols)
    got = {r.image: (r.q2, r.q3, r.q4) for r in scenes.definite_answers(rows).collect()}
    assert got == {1: ("YES", "TIE", "TIE"), 2: ("NO", "2", "LEFT")}


def test_uncertain_objects_never_imply_absence(spark):
    rows = spark.createDataFrame([(1, 10.0, 5, "LEFT", True), (2, 10.0, 5, "LEFT", False), (2, 1.0, 1, "LEFT", True)], "image long, size_proxy double, cell int, half string, uncertain boolean")
    got = {r.image: tuple(r)[1:] for r in scenes.world_invariance(rows).collect()}
    assert got == {1: (None, None, None, None), 2: ("YES", "YES", "5", "LEFT")}


def test_hamming_two_yes_three_no(spark):
    rows = spark.createDataFrame([(1, 0), (2, 0b11), (3, 0b111 << 40), (4, -(2**63)), (5, 0)], "id long, bits long")
    got = {(r.a, r.b): r.distance for r in audit.near_pairs(rows).collect()}
    assert got == {(1, 2): 2, (2, 5): 2, (1, 4): 1, (4, 5): 1}
    assert (1, 5) in {(r.a, r.b) for r in audit.near_pairs(rows, equal=True).collect()}


def test_hash_arithmetic(spark):
    import hashlib

    df = spark.createDataFrame([("abc", "ffffffffffffffff")], "t string, h string")
    row = df.select(digest_modulo(F.col("t"), F.lit(7)).alias("m"), from_hex(F.col("h")).alias("x"), effect_seed(F.lit("1"), F.col("t"), F.lit("shear")).alias("e"), F.size(chunks(F.lit(5).cast("long"))).alias("c"), hamming(F.lit(1), F.lit(2)).alias("d")).first()
    assert row.m == int(hashlib.sha256(b"abc").hexdigest(), 16) % 7 and row.x == -1 and row.c == 3 and row.d == 2
    assert row.e == int(hashlib.sha256(b"1:abc:shear").hexdigest()[:8], 16)


def test_empty_masks_agree(spark):
    rows = spark.createDataFrame([(1, "a", [0, 255], [0, 1]), (2, "a", [1, 1], [1, 0]), (3, "b", [1, 0], [0, 1])], "sample_id long, scene string, target array<int>, predicted array<int>")
    got = {r.sample_id: r for r in segment.per_image(rows).collect()}
    assert got[1].iou == 1.0 and got[1].ignored == 1 and got[2].iou == 0.5 and got[3].iou == 0
    macro = segment.scene_macro(segment.per_image(rows)).first()
    assert macro.scene_iou == 0.375 and macro.image_iou == 0.5


def test_effects_are_seeded_and_zero_is_identity():
    image = np.random.default_rng(1).random((16, 16))
    for name, effect in rasters.EFFECTS.items():
        assert np.array_equal(effect(image, 0.0, 3), image), name
        assert np.array_equal(effect(image, 0.5, 3), effect(image, 0.5, 3))
    offsets = rasters.shear_offsets(64, 5.0, 2)
    assert abs(offsets.mean()) < 1e-9 and np.abs(np.diff(offsets)).max() <= 0.35 + 1e-9 and np.abs(offsets).max() <= 5 + 1e-9
    mask = np.zeros((16, 16))
    mask[4:9, 5:9] = 1
    assert set(np.unique(rasters.shear(mask, rasters.shear_offsets(16, 2, 1), nearest=True, border=255))) <= {0, 1, 255}


def test_raster_arithmetic():
    mask = np.zeros((6, 7), bool)
    mask[0:2, 0:2] = mask[2, 2] = mask[5, 6] = True
    parts = rasters.components8(mask)
    assert [(p["area"], p["x2"]) for p in parts] == [(5, 3), (1, 7)]
    assert rasters.window_counts(mask, 2)[0, 0] == 4 and rasters.circularity(mask[:2, :2]) == pytest.approx(np.pi / 4)
    grid = np.array([[1.0, np.nan], [3.0, 5.0]])
    assert rasters.resample(grid, np.array([0.5]), np.array([0.0]))[0] == 2.0
    assert np.allclose(rasters.resize_bilinear(np.ones((4, 6)), 3, 2), 1) and rasters.resize_nearest(np.arange(4).reshape(2, 2), 4, 4).shape == (4, 4)
    assert rasters.polygon_fill(4, 4, np.array([[0, 0], [4, 0], [4, 4], [0, 4]])).all()
    assert rasters.restore(rasters.to_unit(np.array([[0, 255]], np.uint8)), np.uint8).tolist() == [[0, 255]]
    assert rasters.image_checks(np.zeros((2, 3)))["constant"]


def test_world_invariance_against_all_worlds(spark):
    """Bounds over worlds give what listing every subset of the uncertain objects gives."""
    r = random.Random(5)
    rows = [(image, float(r.choice([10, 10, 19, 20, 21, 40])), r.choice([1, 5, 9]), r.choice(["LEFT", "RIGHT"]), r.random() < 0.5) for image in range(150) for _ in range(r.randrange(1, 6))]

    def answers(own):
        most = max((o[1] for o in own), default=0)
        cells = {o[2] for o in own if o[1] >= 0.95 * most}
        delta = sum(1 if o[3] == "LEFT" else -1 for o in own)
        return ("YES" if own else "NO", "YES" if 5 in {o[2] for o in own} else "NO", "NONE" if not own else str(min(cells)) if len(cells) == 1 else "TIE", "LEFT" if delta > 0 else "RIGHT" if delta < 0 else "TIE")

    want = {}
    for image in {o[0] for o in rows}:
        sure, maybe = ([o for o in rows if o[0] == image and o[4] == k] for k in (False, True))
        worlds = {answers(sure + [o for k, o in enumerate(maybe) if bits >> k & 1]) for bits in range(1 << len(maybe))}
        want[image] = tuple(v.pop() if len(v := {w[k] for w in worlds}) == 1 else None for k in range(4))
    df = spark.createDataFrame(rows, "image long, size_proxy double, cell int, half string, uncertain boolean")
    assert {x.image: tuple(x)[1:] for x in scenes.world_invariance(df).collect()} == want
    assert any(w[2] == "TIE" for w in want.values()) and any(w[2] is None for w in want.values())
    limited = {x.image: tuple(x)[1:] for x in scenes.world_invariance(df, limit=0).collect()}
    assert all(x[2:] == (None, None) for i, x in limited.items() if any(o[0] == i and o[4] for o in rows))
