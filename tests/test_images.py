"""Image hashes, candidate masks, regions and resampling against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import audit, images


def triangle(n, m):
    """Weights one by one."""
    step = n / m
    wide = max(1.0, step)
    out = []
    for j in range(m):
        centre = (j + 0.5) * step
        w = [max(0.0, 1 - abs((i + 0.5 - centre) / wide)) for i in range(n)]
        out.append([math.floor(v / sum(w) * 2**22 + 0.5) for v in w])
    return out


@pytest.mark.parametrize("n,m", [(8, 9), (9, 9), (64, 9), (512, 8), (5, 8), (1, 9), (37, 8)])
def test_reduction(n, m):
    assert np.abs(images.reduction(n, m) - np.array(triangle(n, m))).max() <= 1
    assert np.abs(images.reduction(n, m).sum(1) - 2**22).max() <= n


def test_difference_bits():
    r = np.random.default_rng(1)
    grey = r.integers(0, 256, (5, 20, 31), dtype=np.uint8)
    for k, got in enumerate(images.difference_bits(grey)):
        a = np.clip((grey[k].astype(int) @ np.array(triangle(31, 9)).T + 2**21) >> 22, 0, 255)
        a = np.clip((np.array(triangle(20, 8)) @ a + 2**21) >> 22, 0, 255)
        want = sum(int(a[y, x + 1] > a[y, x]) << (8 * y + x) for y in range(8) for x in range(8))
        assert int(got) & (2**64 - 1) == want
    rising = np.tile(np.arange(0, 250, 10, dtype=np.uint8), (12, 1))[None]
    assert images.difference_bits(rising)[0] == -1 and images.difference_bits(rising[:, :, ::-1])[0] == 0


def test_signatures(spark):
    r = np.random.default_rng(2)
    sizes = [(8, 8), (3, 5), (8, 8), (600, 400)]
    rows = [(i, h, w, r.integers(0, 256, 3 * h * w, dtype=np.uint8).tobytes()) for i, (h, w) in enumerate(sizes)]
    rows += [(10, 8, 8, b"short"), (11, None, 8, b"x"), (12, 0, 0, b""), (13, 8, 8, None), (14, 8, 8, bytes(192))]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary").withColumn("bits", F.lit("clash")).repartition(2)
    got = {x.id: x for x in images.signatures(df).collect()}
    for i, h, w, data in rows:
        if i < 10 or i == 14:
            assert got[i].pixels_sha256 == hashlib.sha256(str((w, h)).encode() + data).hexdigest()
            assert got[i].bits == images.difference_bits(images.luminance(np.frombuffer(data, np.uint8).reshape(1, h, w, 3)))[0]
        else:
            assert got[i].pixels_sha256 is None and got[i].bits is None
    assert images.signatures(df.where("false")).count() == 0


def test_two_bits_are_near_and_three_are_not(spark):
    base = 0x0123456789ABCDEF
    rows = [(1, base), (2, base ^ 0b11), (3, base ^ (1 << 40 | 1 << 60)), (4, base ^ 0b111 << 20), (5, None), (6, base ^ 1), (7, base ^ 0b11)]
    got = {(x.a, x.b): (x.n_a, x.n_b, x.distance) for x in audit.near_classes(spark.createDataFrame(rows, "id long, bits long")).collect()}
    assert got == {(1, 2): (1, 2, 2), (1, 3): (1, 1, 2), (1, 6): (1, 1, 1), (2, 6): (2, 1, 1)}
    copies = spark.range(10_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(1).cast("long").alias("bits"))
    assert [tuple(x) for x in audit.near_classes(copies).collect()] == [(0, 1, 5000, 5000, 1)]  # a row for 25 million pairs


def flood(mask):
    """Regions by walking."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        todo, region = [left.pop()], set()
        while todo:
            y, x = todo.pop()
            region.add((y, x))
            for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        out.append(region)
    return out


@pytest.mark.parametrize("seed,shape", [(1, (1, 1)), (2, (9, 14)), (3, (30, 17)), (4, (40, 40))])
def test_regions(seed, shape):
    r = np.random.default_rng(seed)
    classes = r.choice([0, 1, 2, 3], shape, p=[0.45, 0.35, 0.1, 0.1])
    want = []
    for region in flood(classes == 1):
        ys, xs = [p[0] for p in region], [p[1] for p in region]
        beside = {(y + a, x + b) for y, x in region for a in (-1, 0, 1) for b in (-1, 0, 1)}
        inside = lambda p: 0 <= p[0] < shape[0] and 0 <= p[1] < shape[1]
        sides = sum((y + a, x + b) not in region for y, x in region for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        x1, y1, x2, y2 = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        want.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "area": len(region), "sides": sides, "large": min(x2 - x1, y2 - y1) >= math.ceil(0.1 * min(shape)),
                     "framed": x1 >= 1 and y1 >= 1 and x2 <= shape[1] - 1 and y2 <= shape[0] - 1, "touches_other": any(inside(p) and classes[p] > 1 for p in beside)})
    order = lambda rows: sorted(map(repr, rows))
    got = images.regions(classes, 1, 0.1)
    assert order(got) == order(want) and [(x["y1"], x["x1"], x["area"]) for x in got] == sorted((x["y1"], x["x1"], x["area"]) for x in got)


def test_class_regions(spark):
    df = spark.createDataFrame([("a", 2, 3, [1, 0, 1, 0, 0, 2]), ("b", 2, 2, [1]), ("c", 2, 2, None), ("d", 1, 2, [2, 0])], "k string, height int, width int, classes array<int>")
    got = images.class_regions(df, "k", 1).collect()
    assert [(x.k, x.x1, x.y1, x.area, x.sides, x.touches_other) for x in got] == [("a", 0, 0, 1, 4, False), ("a", 2, 0, 1, 4, True)]


def test_filtered_candidates(spark):
    r = np.random.default_rng(7)
    rows = [(i, i % 3, h, w, [int(v) for v in (r.random(h * w) < 0.7)]) for i, (h, w) in enumerate([(9, 15)] * 12)]
    disc = [int((y - 4) ** 2 + (x - 7) ** 2 <= 12) for y in range(9) for x in range(15)]
    rows += [(90, 0, 9, 15, disc), (91, 1, 9, 15, [0] * 135), (92, 1, 9, 15, None), (93, 2, 2, 2, [1]), (94, None, 9, 15, disc)]
    df = spark.createDataFrame(rows, "id long, image long, height int, width int, mask array<int>").repartition(3)
    out = images.filtered_candidates(df, 3, 0.9, 0.3, 0.05).cache()
    got = {x.id: x for x in out.collect()}
    accepted = {}
    for i, image, h, w, flat in rows:
        if flat is None or len(flat) != h * w:
            assert got[i].area is None and not got[i].accepted
            continue
        m = np.array(flat).reshape(h, w)
        ys, xs = np.nonzero(m)
        sides = sum(not (0 <= y + a < h and 0 <= x + b < w and m[y + a, x + b]) for y, x in zip(ys, xs, strict=True) for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
        assert (got[i].area, got[i].sides) == (m.sum(), sides)
        if len(ys):
            bh, bw = np.ptp(ys) + 1, np.ptp(xs) + 1
            assert (got[i].box_height, got[i].box_width) == (bh, bw)
            ok = m.sum() >= 3 and m.sum() <= 0.9 * h * w and min(bh, bw) / max(bh, bw) >= 0.3 and 4 * math.pi * m.sum() / sides**2 >= 0.05
            assert got[i].accepted == ok
            if ok:
                accepted.setdefault(image, []).append(m > 0)
    union = {x.image: x for x in images.united(out, "image").collect()}
    assert union.keys() == {0, 1, 2, None}
    assert all(union[k].union_pixels == (np.any(accepted[k], axis=0).sum() if k in accepted else 0) and union[k].n_accepted == len(accepted.get(k, [])) for k in union)


def bilinear(grid, x, y):
    total = weight = 0.0
    for cy in (math.floor(y), math.floor(y) + 1):
        for cx in (math.floor(x), math.floor(x) + 1):
            if 0 <= cy < grid.shape[0] and 0 <= cx < grid.shape[1] and math.isfinite(grid[cy, cx]):
                w = (1 - abs(x - cx)) * (1 - abs(y - cy))
                total, weight = total + w * grid[cy, cx], weight + w
    return total / weight if weight else None


def test_affine_resampled(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(60):
        a = r.uniform(0, 0.6)
        s = r.uniform(0.5, 1.2)
        m = [s * math.cos(a), -s * math.sin(a), r.uniform(0, 4), s * math.sin(a), s * math.cos(a), r.uniform(0, 3)]
        rows.append((i, r.normal(size=9 * 7).tolist(), m))
    rows += [(100, None, rows[0][2]), (101, [1.0], rows[0][2]), (102, rows[0][1], None), (103, rows[0][1], [float("nan")] * 6), (104, rows[0][1], [1.0, 0.0, 1.0, 0.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, grid array<double>, matrix array<double>").repartition(3)
    got = {x.id: x for x in images.affine_resampled(df, "id", (9, 7), (4, 3)).collect()}
    n = 0
    for i, grid, m in rows:
        corners = [(m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) for x in (0, 2) for y in (0, 3)] if m and grid and len(grid) == 63 else []
        ok = bool(corners) and all(1 <= x <= 5 and 1 <= y <= 7 for x, y in corners)
        assert got[i].supported == ok and (got[i].pixels is not None) == ok
        if ok:
            n += 1
            g = np.array(grid).reshape(9, 7)
            assert got[i].pixels == pytest.approx([bilinear(g, m[0] * x + m[1] * y + m[2], m[3] * x + m[4] * y + m[5]) for y in range(4) for x in range(3)])
    assert n > 5


def test_points_sampled(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(20):
        g = r.normal(size=30)
        g[r.random(30) < 0.4] = np.nan
        rows.append((i, [None if np.isnan(v) and i % 2 else float(v) for v in g], r.uniform(-2, 7, 8).tolist(), r.uniform(-2, 8, 8).tolist()))
    df = spark.createDataFrame(rows, "id long, grid array<double>, xs array<double>, ys array<double>")
    got = {x.id: x for x in images.points_sampled(df, "id", (6, 5)).collect()}
    for i, g, xs, ys in rows:
        grid = np.array([np.nan if v is None else v for v in g], float).reshape(6, 5)
        want = [bilinear(grid, x, y) for x, y in zip(xs, ys, strict=True)]
        assert got[i].valid == [v is not None for v in want]
        assert [v for v in got[i]["values"] if v is not None] == pytest.approx([v for v in want if v is not None])


def test_copies_multiply_no_counts(spark):
    # 10,000 copies of one hash, stem and content on either side: 10^8 pairs, which nothing makes.
    one = lambda shift, bit: spark.range(10_000).select((F.col("id") + shift).alias("id"), F.lit("s").alias("stem"), F.lit(bit).cast("string").alias("content"), F.lit(bit).cast("long").alias("bits"))
    current, prior = one(0, 0), one(100_000, 0).unionByName(one(200_000, 1)).unionByName(one(300_000, 7))
    assert audit.near_count(current, prior).first().n_near == 2 * 10**8
    got = audit.overlap_counts(current, prior)
    assert [tuple(r) for r in got.groupBy("n_stem", "n_content", "n_near").count().collect()] == [(30_000, 10_000, 10_000, 10_000)]
    nulls = spark.createDataFrame([(1, None, None, None)], "id long, stem string, content string, bits long")
    assert tuple(audit.overlap_counts(nulls, nulls).first()) == (1, 0, 0, 0) and audit.near_count(nulls, nulls).first().n_near == 0
