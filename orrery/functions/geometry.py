"""Boxes in native pixels: eligibility, cells, halves, overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box_geometry(box: Column, truncated: Column, width: Column, height: Column) -> Column:
    """Struct of cx, cy, threshold, eligible, cell (1-9), half, size_proxy and boundary_review of an xyxy box."""
    x1, y1, x2, y2 = (F.get(box, i) for i in range(4))
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    threshold = F.ceil(F.lit(0.04) * F.least(width, height))
    side = F.least(x2 - x1, y2 - y1)
    third = lambda k, n: F.floor(n * k / 3)
    step = lambda c, n: F.when(c >= third(1, n), 1).otherwise(0) + F.when(c >= third(2, n), 1).otherwise(0)
    near = lambda c, n: (F.abs(c - third(1, n)) <= 2) | (F.abs(c - third(2, n)) <= 2)
    return F.struct(
        cx.alias("cx"), cy.alias("cy"), threshold.cast("int").alias("threshold"),
        (~truncated & (side >= threshold) & (x1 >= 1) & (y1 >= 1) & (x2 <= width - 1) & (y2 <= height - 1)).alias("eligible"),
        (1 + step(cx, width) + 3 * step(cy, height)).cast("int").alias("cell"),
        F.when(cx < width / 2, "LEFT").otherwise("RIGHT").alias("half"),
        F.sqrt((x2 - x1) * (y2 - y1)).alias("size_proxy"),
        ((F.abs(side - threshold) <= 2) | (F.abs(cx - width / 2) <= 2) | near(cx, width) | near(cy, height)).alias("boundary_review"),
    )


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two xyxy boxes."""
    w = F.greatest(F.least(F.get(a, 2), F.get(b, 2)) - F.greatest(F.get(a, 0), F.get(b, 0)), F.lit(0.0))
    h = F.greatest(F.least(F.get(a, 3), F.get(b, 3)) - F.greatest(F.get(a, 1), F.get(b, 1)), F.lit(0.0))
    area = lambda x: (F.get(x, 2) - F.get(x, 0)) * (F.get(x, 3) - F.get(x, 1))
    return F.try_divide(w * h, area(a) + area(b) - w * h)


def rescale(box: Column, width: Column, height: Column, grid: int = 256) -> Column:
    return F.transform(box, lambda v, i: v * F.when(i % 2 == 0, width).otherwise(height) / grid)
