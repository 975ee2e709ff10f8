"""Images as bytes: hashes, candidate masks, regions of class maps and resampling.

Images of one size are stacked, so that a batch costs a few numpy passes; Spark
deals the batches and does the joins, unions and counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rasters import labelled8

#: Weights of red, green and blue in 2^-16, and the bits of a resampling weight.
LUMA, WEIGHT_BITS = (19595, 38470, 7471), 22


def luminance(rgb: np.ndarray) -> np.ndarray:
    """Grey of (..., 3) bytes, rounded."""
    return ((rgb.astype(np.int64) @ np.array(LUMA) + 0x8000) >> 16).astype(np.uint8)


def reduction(n: int, m: int) -> np.ndarray:
    """Weights (m, n) that take n pixels to m, in whole parts of 2^WEIGHT_BITS.

    A triangle about each new pixel's centre, as wide as the step where the image
    shrinks, so that every old pixel counts; weights add up to one before rounding.
    """
    step = n / m
    wide = max(step, 1.0)
    centre = (np.arange(m)[:, None] + 0.5) * step
    at = np.arange(n)[None, :]
    # Only pixels whose centre lies within the triangle's foot take part.
    first, last = np.maximum((centre - wide + 0.5).astype(int), 0), np.minimum((centre + wide + 0.5).astype(int), n)
    weight = np.maximum(0.0, 1 - np.abs((at + 0.5 - centre) / wide)) * ((at >= first) & (at < last))
    weight /= weight.sum(axis=1, keepdims=True)
    return np.floor(weight * (1 << WEIGHT_BITS) + 0.5).astype(np.int64)


def reduced(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Grey images (k, h, w) at another size: two matrix products, columns first, each rounded to bytes."""
    half = 1 << (WEIGHT_BITS - 1)
    across = np.clip((grey.astype(np.int64) @ reduction(grey.shape[2], width).T + half) >> WEIGHT_BITS, 0, 255)
    return np.clip((reduction(grey.shape[1], height) @ across + half) >> WEIGHT_BITS, 0, 255).astype(np.uint8)


def difference_bits(grey: np.ndarray) -> np.ndarray:
    """64 bits of each grey image (k, h, w): at 9 x 8, bit 8 y + x tells whether pixel x + 1 is lighter than x."""
    small = reduced(grey, 8, 9)
    bits = (small[:, :, 1:] > small[:, :, :-1]).reshape(len(grey), 64)
    return (bits.astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))).view(np.int64)


def _by_size(height: np.ndarray, width: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(height, width, rows) of the rows of each size."""
    key = height.astype(np.int64) << 32 | width.astype(np.int64)
    for k in np.unique(key):
        yield int(k >> 32), int(k & 0xFFFFFFFF), np.flatnonzero(key == k)


def signatures(images: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, pixels_sha256, bits) of images height, width, pixels (RGB bytes, row by row).

    The hash is of the size as '(width, height)' and the bytes.  An image without
    pixels or whose bytes don't fit its size has nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                size = [(h or 0, w or 0) for h, w in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)]
                data = batch.column("pixels").to_pylist()
                good = np.array([d is not None and h > 0 and w > 0 and len(d) == 3 * h * w for (h, w), d in zip(size, data, strict=True)], bool)
                sha, bits = [None] * len(data), np.zeros(len(data), np.int64)
                at = np.flatnonzero(good)
                hw = np.array(size, np.int64).reshape(-1, 2)[at]
                for h, w, rows in _by_size(hw[:, 0], hw[:, 1]):
                    for i in at[rows]:
                        sha[i] = hashlib.sha256(f"({w}, {h})".encode() + data[i]).hexdigest()
                    bits[at[rows]] = difference_bits(luminance(np.frombuffer(b"".join(data[i] for i in at[rows]), np.uint8).reshape(-1, h, w, 3)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sha, pa.string()), pa.array(bits, mask=~good)], ["id", "pixels_sha256", "bits"])

    rows = images.select(F.col(id_col).alias("id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, pixels_sha256 string, bits long").withColumnRenamed("id", id_col)


# --- candidate masks and regions --------------------------------------------------------------


def _open_sides(label: np.ndarray, n: int) -> np.ndarray:
    """Sides of pixels of each label (1 to n) that the label doesn't go on behind: one count over four shifts."""
    wide = np.pad(label, [(0, 0)] * (label.ndim - 2) + [(1, 1), (1, 1)])
    mid = wide[..., 1:-1, 1:-1]
    sides = [mid[mid != other] for other in (wide[..., :-2, 1:-1], wide[..., 2:, 1:-1], wide[..., 1:-1, :-2], wide[..., 1:-1, 2:])]
    return np.bincount(np.concatenate(sides), minlength=n + 1)[1:]


def mask_shapes(masks: np.ndarray) -> dict[str, np.ndarray]:
    """Area, box and open sides of each mask (k, h, w); boxes of empty masks are zero."""
    k, h, w = masks.shape
    rows, cols = masks.any(axis=2), masks.any(axis=1)
    some = rows.any(axis=1)
    label = np.where(masks, np.arange(1, k + 1)[:, None, None], 0)
    span = lambda v, n: np.where(some, n - v[:, ::-1].argmax(axis=1) - v.argmax(axis=1), 0)
    return {"area": masks.sum(axis=(1, 2)), "box_height": span(rows, h), "box_width": span(cols, w), "sides": _open_sides(label, k)}


def _mask_rows(rows: DataFrame, fields: str, of: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """``rows`` (height, width, mask: an array of 0 and 1 row by row) with what ``of`` tells of each mask; nulls where sizes don't fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            data = [None if m is None else np.array(m, bool) for m in batch.column("mask").to_pylist()]
            hw = np.array([(h or 0, w or 0) for h, w in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)], np.int64).reshape(-1, 2)
            good = np.array([m is not None and len(m) == h * w > 0 for m, (h, w) in zip(data, hw, strict=True)], bool)
            out = {n: np.zeros(len(data), np.int64) for n in names}
            at = np.flatnonzero(good)
            for h, w, some in _by_size(hw[at, 0], hw[at, 1]):
                for n, values in of(np.stack([data[i] for i in at[some]]).reshape(-1, h, w)).items():
                    out[n][at[some]] = values
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n], mask=~good) for n in names)], [*batch.schema.names, *names])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, {fields}")


def filtered_candidates(rows: DataFrame, least_area: int, most_fraction: float, least_ratio: float, least_circularity: float) -> DataFrame:
    """``rows`` (height, width, mask) with area, box_height, box_width, sides, axis_ratio, circularity and ``accepted``.

    Circularity is 4 pi area over the square of the open sides, the border's too.
    A candidate is accepted if it passes all four bounds; an empty mask never is.
    A mask that is null or doesn't fit its size has nulls and isn't accepted.
    """
    out = _mask_rows(rows, "area long, box_height long, box_width long, sides long", mask_shapes)
    out = out.withColumn("axis_ratio", F.try_divide(F.least("box_height", "box_width"), F.greatest("box_height", "box_width")))
    out = out.withColumn("circularity", F.try_divide(4 * F.pi() * F.col("area"), F.col("sides") * F.col("sides")))
    good = (F.col("area") > 0) & (F.col("area") >= least_area) & (F.col("area") <= F.col("height") * F.col("width") * most_fraction)
    return out.withColumn("accepted", F.coalesce(good & (F.col("axis_ratio") >= least_ratio) & (F.col("circularity") >= least_circularity), F.lit(False)))


def united(candidates: DataFrame, image: str) -> DataFrame:
    """(image, n_candidates, n_accepted, union_pixels): pixels of an image that any accepted candidate has.

    Masks go out as words of 63 pixels, which are or-ed before the shuffle: an image
    with very many candidates costs its pixels, not its candidates' pixels.
    """
    words = F.transform(F.sequence(F.lit(0), F.expr("(size(mask) - 1) div 63")), lambda i: F.aggregate(F.slice("mask", i * 63 + 1, 63), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b.cast("long")))
    # A short last word is shifted, the same in all masks of a size.
    parts = candidates.where("accepted").select(image, F.posexplode(words).alias("at", "word")).groupBy(image, "at").agg(F.bit_or("word").alias("word"))
    pixels = parts.groupBy(F.col(image).alias("_i")).agg(F.sum(F.bit_count("word")).cast("long").alias("union_pixels"))
    counts = candidates.groupBy(image).agg(F.count("*").alias("n_candidates"), F.count_if("accepted").alias("n_accepted"))
    return counts.join(pixels, F.col(image).eqNullSafe(F.col("_i")), "left").select(image, "n_candidates", "n_accepted", F.coalesce("union_pixels", F.lit(0)).cast("long").alias("union_pixels"))


def regions(classes: np.ndarray, class_id: int, size_fraction: float = 0.04, margin: int = 1) -> list[dict]:
    """8-connected regions of a class in a class map (0 is background): box, area, open sides, and whether another class touches.

    Also whether the box's lesser side reaches ``size_fraction`` of the image's, and
    whether it keeps ``margin`` pixels from the frame.  By row, column and area.
    """
    height, width = classes.shape
    label, n = labelled8(classes == class_id)
    if not n:
        return []
    other = np.pad((classes > 0) & (classes != class_id), 1)
    near = np.zeros_like(classes, bool)
    for dy in range(3):
        for dx in range(3):
            near |= other[dy : dy + height, dx : dx + width]
    y, x = np.nonzero(label)
    of = label[y, x] - 1
    area, touched, sides = np.bincount(of, minlength=n), np.bincount(of, weights=near[y, x], minlength=n) > 0, _open_sides(label, n)
    low, high = np.full((n, 2), max(height, width)), np.full((n, 2), -1)
    for axis, v in enumerate((x, y)):
        np.minimum.at(low[:, axis], of, v)
        np.maximum.at(high[:, axis], of, v)
    least = int(np.ceil(size_fraction * min(height, width)))
    out = []
    for (x1, y1), (x2, y2), a, t, s in zip(low.tolist(), (high + 1).tolist(), area.tolist(), touched.tolist(), sides.tolist(), strict=True):
        framed = x1 >= margin and y1 >= margin and x2 <= width - margin and y2 <= height - margin
        out.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "area": a, "sides": s, "large": min(x2 - x1, y2 - y1) >= least, "framed": framed, "touches_other": t})
    return sorted(out, key=lambda r: (r["y1"], r["x1"], r["area"]))


def class_regions(rows: DataFrame, key: str, class_id: int, **rules: float) -> DataFrame:
    """A row for each region of ``class_id`` in class maps (height, width, classes: numbers row by row); maps that don't fit their size have none."""
    fields = "x1 int, y1 int, x2 int, y2 int, area long, sides long, large boolean, framed boolean, touches_other boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(key), *(pa.field(n, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in fields.split(", ")))])
            found = []
            for k, h, w, flat in zip(*(batch.column(c).to_pylist() for c in (key, "height", "width", "classes")), strict=True):
                if flat is not None and h and w and len(flat) == h * w:
                    found += [{key: k} | r for r in regions(np.array(flat).reshape(h, w), class_id, **rules)]
            yield pa.RecordBatch.from_pylist(found, schema=schema)

    return rows.select(key, "height", "width", "classes").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {fields}")


# --- resampling -------------------------------------------------------------------------------


def supported(shape: tuple[int, int], matrix: np.ndarray, height: int, width: int) -> np.ndarray:
    """Of affine maps (k, 2, 3) from new to old pixels (x, y): whether all corners of the new image lie a pixel inside the old one."""
    corners = np.array([[x, y, 1.0] for x in (0, width - 1) for y in (0, height - 1)])
    at = corners @ matrix.transpose(0, 2, 1)
    with np.errstate(invalid="ignore"):
        inside = (at >= 1).all(axis=(1, 2)) & (at[..., 0] <= shape[1] - 2).all(axis=1) & (at[..., 1] <= shape[0] - 2).all(axis=1)
    return inside & np.isfinite(matrix).all(axis=(1, 2))


def sampled(grids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bilinear samples (k, p) of grids (k, h, w) at points (k, p), and the weight of their finite corners.

    Corners that are missing (not finite) or outside share their weight out among
    the rest; a point without a finite corner is nan.
    """
    k, h, w = grids.shape
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    row = np.arange(k)[:, None]
    for dy, dx in ((0, 0), (0, 1), (1, 0), (1, 1)):
        cx, cy = x0 + dx, y0 + dy
        part = (1 - np.abs(x - cx)) * (1 - np.abs(y - cy))
        inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
        value = grids[row, np.clip(cy, 0, h - 1), np.clip(cx, 0, w - 1)]
        part = np.where(inside & np.isfinite(value), part, 0.0)
        total += np.where(part > 0, value, 0.0) * part
        weight += part
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(weight > 0, total / weight, np.nan), weight


def _grids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in g] for g in batch.column(column).to_pylist()], float)


def affine_resampled(rows: DataFrame, key: str, shape: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """(key, supported, pixels): grids of one ``shape`` through ``matrix`` (six numbers, new to old pixels) at ``size`` (height, width).

    Without support at every corner nothing is made up: pixels are null.
    Rows whose grid or matrix is null or of another size are unsupported.
    """
    (h, w), (m, n) = shape, size
    v, u = (a.ravel() for a in np.mgrid[:m, :n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array([g is not None and t is not None and len(g) == h * w and len(t) == 6 and None not in t for g, t in zip(batch.column("grid").to_pylist(), batch.column("matrix").to_pylist(), strict=True)], bool)
            at, pixels = np.flatnonzero(good), [None] * batch.num_rows
            if len(at):
                some = batch.take(pa.array(at))
                grid, matrix = _grids(some, "grid").reshape(-1, h, w), np.array(some.column("matrix").to_pylist(), float).reshape(-1, 2, 3)
                good[at] = supported(shape, matrix, m, n)
                on = np.flatnonzero(good[at])
                point = matrix[on] @ np.stack([u, v, np.ones(len(u))])
                for i, values in zip(at[on], sampled(grid[on], point[:, 0], point[:, 1])[0], strict=True):
                    pixels[i] = values.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(good), pa.array(pixels, pa.list_(pa.float64()))], [key, "supported", "pixels"])

    return rows.select(key, "grid", "matrix").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, supported boolean, pixels array<double>")


def points_sampled(rows: DataFrame, key: str, shape: tuple[int, int]) -> DataFrame:
    """(key, values, valid): heights at ``xs`` and ``ys`` of grids of one ``shape``, where not-a-number marks what is missing.

    ``valid`` tells for each point whether any corner is there; values of the others are null.
    """
    h, w = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, valid = [], []
            for g, x, y in zip(*(batch.column(c).to_pylist() for c in ("grid", "xs", "ys")), strict=True):
                grid = np.array([[np.nan if v is None else v for v in g]], float).reshape(1, h, w)
                got, weight = sampled(grid, np.array([x], float), np.array([y], float))
                valid.append((weight[0] > 0).tolist())
                values.append([v if ok else None for v, ok in zip(got[0].tolist(), valid[-1], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(values, pa.list_(pa.float64())), pa.array(valid, pa.list_(pa.bool_()))], [key, "values", "valid"])

    good = rows.where((F.size("grid") == h * w) & (F.size("xs") == F.size("ys")))
    return good.select(key, "grid", "xs", "ys").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, values array<double>, valid array<boolean>")
