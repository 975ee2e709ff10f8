"""Pixel values, palettes, bands and parameters of drawn shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reflectance(pixel: Column, full: float = 0.12) -> Column:
    """Reflectance of an eight-bit value."""
    return pixel * full / 255


def is_valid(value: Column, sentinel: float) -> Column:
    """Finite, above zero and not the mark of a missing value."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < float("inf")) & (value > 0) & (value != sentinel), F.lit(False))


def packed(rgb: Column) -> Column:
    """A colour's three bytes as one number."""
    return F.shiftleft(F.get(rgb, 0), 16).bitwiseOR(F.shiftleft(F.get(rgb, 1), 8)).bitwiseOR(F.get(rgb, 2))


def palette_class(rgb: Column, palette: dict[tuple[int, int, int], int]) -> Column:
    """Class of a colour; null for one that the palette lacks, which the caller's rules report."""
    entries = [F.lit(x) for (r, g, b), k in sorted(palette.items()) for x in (r << 16 | g << 8 | b, k)]
    return F.try_element_at(F.create_map(*entries), packed(rgb))


def stretch(band: Column, low: float = 0.02, high: float = 0.98) -> Column:
    """A band, an array with NaN for missing values, from the ``low`` to the ``high`` quantile to whole numbers of 0 to 255.

    Quantiles are linear between ranks of the values that are there; missing
    values are 0, and a band without range is 0.
    """
    seen = F.array_sort(F.filter(band, lambda x: ~F.isnan(x)))

    def quantile(v: Column, q: float) -> Column:
        at = (F.size(v) - 1) * F.lit(q)
        a, b = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return a + (b - a) * (at - F.floor(at))

    def scaled(q: Column) -> Column:
        a, b = q["a"], q["b"]
        return F.transform(band, lambda x: F.when(F.isnan(x) | F.coalesce(b <= a, F.lit(True)), 0).otherwise(F.floor(F.least(F.greatest((x - a) / (b - a), F.lit(0.0)), F.lit(1.0)) * 255).cast("int")))

    # Arrays of one entry hold what is used more than once, so that a band is sorted once.
    ends = F.transform(F.array(seen), lambda v: F.struct(quantile(v, low).alias("a"), quantile(v, high).alias("b")))
    return F.get(F.transform(ends, scaled), 0)


def crop(flat: Column, cols: int, top: Column, left: Column, bottom: Column, right: Column) -> Column:
    """Part of a raster that lies row by row in ``flat``: rows top to bottom, columns left to right, ends excluded."""
    rows = F.sequence(top.cast("int"), bottom.cast("int") - 1)
    return F.flatten(F.transform(rows, lambda r: F.slice(flat, r * cols + left.cast("int") + 1, right.cast("int") - left.cast("int"))))


def pixel_box(box: Column, width: int, height: int) -> Column:
    """Struct top, left, bottom, right in pixels of a box (x1, y1, x2, y2) in shares of the image, at least one pixel each way."""
    lo = lambda i, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.get(box, i) * n).cast("int")))
    hi = lambda i, n, least: F.greatest(least + 1, F.least(F.lit(n), F.ceil(F.get(box, i) * n).cast("int")))
    left, top = lo(0, width), lo(1, height)
    return F.struct(top.alias("top"), left.alias("left"), hi(3, height, top).alias("bottom"), hi(2, width, left).alias("right"))


def ellipse(x: Column, y: Column, major_km: Column, minor_km: Column, angle: Column, scale: float = 2.161) -> Column:
    """Struct of whole centre and half axes, cut off and not rounded, and the angle from the other axis."""
    return F.struct(x.cast("int").alias("cx"), y.cast("int").alias("cy"), (major_km * scale).cast("int").alias("a"), (minor_km * scale).cast("int").alias("b"), (90 - angle).alias("angle"))
