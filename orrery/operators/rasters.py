"""Image corruption and raster arithmetic in numpy, for use in Arrow functions.

Images are float arrays (height, width[, channels]) in 0 .. 1.  Every effect is
a function of its seed; zero strength is the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def to_unit(pixels: np.ndarray) -> np.ndarray:
    top = np.iinfo(pixels.dtype).max if pixels.dtype.kind in "ui" else 1
    return pixels.astype(np.float64) / top


def restore(unit: np.ndarray, dtype: np.dtype) -> np.ndarray:
    if np.dtype(dtype).kind in "ui":
        return np.rint(np.clip(unit, 0, 1) * np.iinfo(dtype).max).astype(dtype)
    return np.clip(unit, 0, 1).astype(dtype)


def shear_offsets(height: int, peak: float, seed: int, knots: int = 5, slope: float = 0.35) -> np.ndarray:
    """Smooth row offsets: cubic Hermite through seeded knots, zero mean, peak ``peak``, slope limited."""
    if not peak or height < 2:
        return np.zeros(height)
    values = np.random.default_rng(seed).uniform(-1, 1, knots)
    at = np.linspace(0, knots - 1, height)
    k = np.minimum(at.astype(int), knots - 2)
    t = at - k
    tangent = np.gradient(values)
    h = ((2 * t**3 - 3 * t**2 + 1) * values[k] + (t**3 - 2 * t**2 + t) * tangent[k] + (3 * t**2 - 2 * t**3) * values[k + 1] + (t**3 - t**2) * tangent[k + 1])
    h -= h.mean()
    h *= peak / max(np.abs(h).max(), 1e-12)
    steep = np.abs(np.diff(h)).max()
    return h * min(1.0, slope / steep) if steep > 0 else h


def shear(image: np.ndarray, offsets: np.ndarray, nearest: bool = False, border: float = 0.0) -> np.ndarray:
    """Move each row sideways: bilinear for images, nearest with ``border`` outside for masks."""
    height, width = image.shape[:2]
    x = np.arange(width)[None, :] + offsets[:, None]
    rows = np.arange(height)[:, None]
    if nearest:
        k = np.rint(x).astype(int)
        out = image[rows, np.clip(k, 0, width - 1)].copy()
        out[(k < 0) | (k >= width)] = border
        return out
    lo = np.floor(x).astype(int)
    f = (x - lo).reshape(height, width, *[1] * (image.ndim - 2))
    a, b = (image[rows, np.clip(k, 0, width - 1)] for k in (lo, lo + 1))
    return a * (1 - f) + b * f


def radiation(image: np.ndarray, hits: int, strength: float, seed: int, length: int = 6) -> np.ndarray:
    """Seeded bright streaks, added and clipped."""
    out = image.copy()
    rng = np.random.default_rng(seed)
    for _ in range(hits):
        y, x, angle, size = rng.uniform(0, image.shape[0]), rng.uniform(0, image.shape[1]), rng.uniform(0, np.pi), rng.integers(1, length + 1)
        t = np.arange(size)
        ys, xs = np.floor(y + t * np.sin(angle)).astype(int), np.floor(x + t * np.cos(angle)).astype(int)
        ok = (ys >= 0) & (ys < image.shape[0]) & (xs >= 0) & (xs < image.shape[1])
        out[ys[ok], xs[ok]] += strength
    return np.clip(out, 0, 1)


def lens_flare(image: np.ndarray, strength: float, seed: int, ghosts: int = 3) -> np.ndarray:
    """A Gaussian core, a halo and ghosts along the line through the centre, blended to white."""
    height, width = image.shape[:2]
    rng = np.random.default_rng(seed)
    cy, cx = rng.uniform(0, height), rng.uniform(0, width)
    y, x = np.mgrid[:height, :width]
    size = max(height, width)
    glow = np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / (2 * (0.08 * size) ** 2))
    glow += 0.5 * np.exp(-((np.hypot(y - cy, x - cx) - 0.3 * size) ** 2) / (2 * (0.03 * size) ** 2))
    for k in range(1, ghosts + 1):
        f = 2 * k / (ghosts + 1)
        gy, gx = cy + f * (height / 2 - cy), cx + f * (width / 2 - cx)
        glow += 0.3 / k * np.exp(-((y - gy) ** 2 + (x - gx) ** 2) / (2 * (0.04 * size) ** 2))
    a = np.clip(strength * glow, 0, 1).reshape(height, width, *[1] * (image.ndim - 2))
    return image * (1 - a) + a


def polygon_fill(height: int, width: int, points: np.ndarray) -> np.ndarray:
    """Pixels whose centres lie inside a polygon (even-odd rule)."""
    y, x = np.mgrid[:height, :width] + 0.5
    inside = np.zeros((height, width), bool)
    for (xa, ya), (xb, yb) in zip(points, np.roll(points, -1, axis=0), strict=True):
        crosses = (ya > y) != (yb > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= crosses & (x < (xb - xa) * (y - ya) / (yb - ya) + xa)
    return inside


def shadows(image: np.ndarray, strength: float, seed: int, count: int = 2) -> np.ndarray:
    """Hard shadows: the union of seeded polygons, darkened."""
    height, width = image.shape[:2]
    rng = np.random.default_rng(seed)
    union = np.zeros((height, width), bool)
    for _ in range(count):
        centre, n = rng.uniform(0, 1, 2) * (width, height), int(rng.integers(4, 8))
        angle = np.sort(rng.uniform(0, 2 * np.pi, n))
        radius = rng.uniform(0.1, 0.35, n) * max(height, width)
        union |= polygon_fill(height, width, np.stack([centre[0] + radius * np.cos(angle), centre[1] + radius * np.sin(angle)], axis=1))
    out = image.copy()
    out[union] *= 1 - strength
    return out


EFFECTS = {
    "shear": lambda im, s, seed: shear(im, shear_offsets(im.shape[0], s * im.shape[1] / 8, seed)),
    "shadow": lambda im, s, seed: shadows(im, s, seed),
    "flare": lambda im, s, seed: lens_flare(im, s, seed),
    "radiation": lambda im, s, seed: radiation(im, int(round(s * 20)), s, seed),
}


def compose(image: np.ndarray, strengths: dict[str, float], seeds: dict[str, int]) -> np.ndarray:
    """Effects in their fixed order, each with its own seed."""
    for name, effect in EFFECTS.items():
        if strengths.get(name):
            image = effect(image, strengths[name], seeds[name])
    return image


def chain(image: np.ndarray, effects: list[tuple[str, float]], seed_of: Callable[[str], int]) -> np.ndarray:
    """Effects in the order in which a condition declares them, each with the seed of its own name."""
    for name, strength in effects:
        image = EFFECTS[name](image, strength, seed_of(name))
    return image


def window_counts(mask: np.ndarray, size: int) -> np.ndarray:
    """Number of set pixels of each ``size`` x ``size`` window, by two prefix sums."""
    s = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), np.int64)
    s[1:, 1:] = mask.cumsum(0).cumsum(1)
    return s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]


def labelled8(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components as numbers from 1, 0 outside, and how many there are."""
    # Runs of a row are joined to the runs of the row above that they touch (union-find).
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1]
    parent = list(range(len(row)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    start = np.searchsorted(row, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = start[y - 1], start[y]
        while i < start[y] and j < start[y + 1]:
            if first[i] <= last[j] and first[j] <= last[i]:
                x, z = find(i), find(j)
                parent[max(x, z)] = min(x, z)
            if last[i] < last[j]:
                i += 1
            else:
                j += 1
    roots, number = np.unique(np.array([find(i) for i in range(len(row))], np.int64), return_inverse=True)
    # A run's number goes on at its start and off behind its end.
    step = np.zeros((mask.shape[0], mask.shape[1] + 1), np.int64)
    np.add.at(step, (row, first), number + 1)
    np.add.at(step, (row, last), -(number + 1))
    return step.cumsum(axis=1)[:, :-1], len(roots)


def components8(mask: np.ndarray) -> list[dict]:
    """8-connected components with bounding box and area, in scan order."""
    label, n = labelled8(mask)
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(label == k)
        out.append({"x1": int(x.min()), "y1": int(y.min()), "x2": int(x.max()) + 1, "y2": int(y.max()) + 1, "area": len(x)})
    return sorted(out, key=lambda c: (c["y1"], c["x1"]))


def circularity(mask: np.ndarray) -> float:
    """4 pi area / perimeter squared, with the perimeter as the number of open sides of pixels."""
    padded = np.pad(mask.astype(bool), 1)
    sides = sum(int((padded & ~np.roll(padded, s, axis=a)).sum()) for a in (0, 1) for s in (1, -1))
    return float(4 * np.pi * mask.sum() / sides**2) if sides else 0.0


def resample(grid: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear samples of a height grid; weights are shared by the finite corners, nan where none is."""
    y0, x0 = np.clip(np.floor(y).astype(int), 0, grid.shape[0] - 2), np.clip(np.floor(x).astype(int), 0, grid.shape[1] - 2)
    fy, fx = y - y0, x - x0
    total, weight = np.zeros(np.shape(y)), np.zeros(np.shape(y))
    for dy, wy in ((0, 1 - fy), (1, fy)):
        for dx, wx in ((0, 1 - fx), (1, fx)):
            v = grid[y0 + dy, x0 + dx]
            ok = np.isfinite(v)
            total += np.where(ok, v, 0) * wy * wx * ok
            weight += wy * wx * ok
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def resize_nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return image[(np.arange(height) * image.shape[0]) // height][:, (np.arange(width) * image.shape[1]) // width]


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Two small matrix products."""

    def weights(n: int, m: int) -> np.ndarray:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        lo = np.minimum(at.astype(int), max(n - 2, 0))
        w = np.zeros((m, n))
        w[np.arange(m), lo] += 1 - (at - lo)
        w[np.arange(m), np.minimum(lo + 1, n - 1)] += at - lo
        return w

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def image_checks(image: np.ndarray) -> dict:
    """Size, whether all pixels are equal, and numbers of constant rows and columns."""
    flat = image.reshape(image.shape[0], image.shape[1], -1)
    rows, cols = (flat == flat[:, :1]).all(axis=(1, 2)), (flat == flat[:1]).all(axis=(0, 2))
    return {"height": image.shape[0], "width": image.shape[1], "constant": bool((flat == flat[:1, :1]).all()), "constant_rows": int(rows.sum()), "constant_columns": int(cols.sum())}


def apply_grid(rows: DataFrame, key: str, column: str, height: int, width: int, effect: str, strength: float) -> DataFrame:
    """(key, before, after, changed): mean of flat grids before and after an effect seeded by the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, flat in zip(pdf[key], pdf[column], strict=True):
                image = np.asarray(flat, np.float64).reshape(height, width)
                after = EFFECTS[effect](image, strength, int(k))
                out.append((k, round(float(image.mean()), 6), round(float(after.mean()), 6), int((np.abs(after - image) > 1e-12).sum())))
            yield pd.DataFrame(out, columns=[key, "before", "after", "changed"])

    return rows.select(key, column).mapInPandas(run, f"{key} long, before double, after double, changed long")
