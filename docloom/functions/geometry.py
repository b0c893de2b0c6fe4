"""Boxes as column expressions: overlap, normalisation to 0..1000 and affine maps.

A box is four columns or an array (left, top, right, bottom). Python's and
`bround`'s rounding of halves to even is the rule wherever values are rounded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def corners(box: Column) -> list[Column]:
    return [F.get(box, F.lit(k)) for k in range(4)]


def metrics(box: Box) -> Column:
    """left, top, right, bottom, width, height (never negative) and centre."""
    x0, y0, x1, y1 = (c.cast("double") for c in box)
    return F.struct(
        x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom"), F.greatest(x1 - x0, F.lit(0.0)).alias("width"), F.greatest(y1 - y0, F.lit(0.0)).alias("height"),
        ((x0 + x1) / 2).alias("center_x"), ((y0 + y1) / 2).alias("center_y"),
    )


def intersection(a: Box, b: Box) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(width, F.lit(0)) * F.greatest(height, F.lit(0))


def area(box: Box) -> Column:
    return F.greatest(box[2] - box[0], F.lit(0)) * F.greatest(box[3] - box[1], F.lit(0))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where the union has no area."""
    common = intersection(a, b)
    union = area(a) + area(b) - common
    return F.when(union > 0, common.cast("double") / union).otherwise(0.0)


def overlaps(a: Box, b: Box) -> Column:
    """An intersection of positive area."""
    return (F.least(a[2], b[2]) > F.greatest(a[0], b[0])) & (F.least(a[3], b[3]) > F.greatest(a[1], b[1]))


def clamp(value: Column, low: float = 0, high: float = 1000) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def normalized(box: Box, width: Column, height: Column) -> list[Column]:
    """Pixels to 0..1000; an error where a side of the page isn't positive."""
    sides = [width, height, width, height]
    checked = [F.when(s > 0, s).otherwise(F.raise_error(F.lit("page dimensions must be positive"))) for s in sides]
    return [clamp(F.bround(c * 1000.0 / s)).cast("int") for c, s in zip(box, checked, strict=True)]


def _number(x: Column) -> Column:
    return x.cast("double")


def usable(box: Column) -> Column:
    """Four finite numbers (box: array of doubles, null where a value wasn't a number)."""
    return (F.size(box) == 4) & F.forall(box, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def attribute_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """Stored attribute boxes to 0..1000: fractions if nothing exceeds 1, pixels if something exceeds 1000 or the page, else as they are. Malformed ones go."""

    def one(box: Column) -> Column:
        top = F.array_max(box)
        kind = F.when(top <= 1.0, 1).when((top > 1000.0) | (top > F.greatest(width, height)), 2).otherwise(0)

        def scaled(x: Column, k: Column) -> Column:
            side = F.when(k % 2 == 0, width).otherwise(height)
            value = F.when(kind == 1, x * 1000.0).when(kind == 2, x * 1000.0 / F.greatest(side, F.lit(1))).otherwise(x)
            return clamp(F.bround(value)).cast("int")

        return F.transform(box, scaled)

    return F.transform(F.filter(boxes, usable), one)


def affine_box(box: Box, matrix: Sequence[Column], width: Column, height: Column) -> list[Column]:
    """The box around the mapped corners, rounded outwards and clamped to the page. matrix: a, b, c, d, e, f of x' = ax + by + c, y' = dx + ey + f."""
    a, b, c, d, e, f = matrix
    xs = [a * x + b * y + c for x in (box[0], box[2]) for y in (box[1], box[3])]
    ys = [d * x + e * y + f for x in (box[0], box[2]) for y in (box[1], box[3])]
    low = [F.floor(F.least(*v) + 1e-5) for v in (xs, ys)]
    high = [F.ceil(F.greatest(*v) - 1e-5) for v in (xs, ys)]
    limits = [width, height]
    return [F.least(F.greatest(v, F.lit(0)), s).cast("int") for v, s in zip([*low, *high], limits * 2, strict=True)]


def inverse_affine(matrix: Sequence[Column]) -> list[Column]:
    a, b, c, d, e, f = matrix
    det = a * e - b * d
    return [e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det]


def compose_affine(second: Sequence[Column], first: Sequence[Column]) -> list[Column]:
    """The map that does `first`, then `second`."""
    a, b, c, d, e, f = second
    g, h, i, j, k, m = first
    return [a * g + b * j, a * h + b * k, a * i + b * m + c, d * g + e * j, d * h + e * k, d * i + e * m + f]


def orientation(rotation: Column, width: Column, height: Column) -> list[Column]:
    """The map of a turn by 0, 90, 180 or 270 degrees clockwise of a page of the given size."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def pick(r0: Column, r90: Column, r180: Column, r270: Column) -> Column:
        return F.when(rotation == 90, r90).when(rotation == 180, r180).when(rotation == 270, r270).otherwise(r0).cast("double")

    return [
        pick(one, zero, -one, zero), pick(zero, -one, zero, one), pick(zero, height - 1, width - 1, zero),
        pick(zero, one, zero, -one), pick(one, zero, -one, zero), pick(zero, zero, height - 1, width - 1),
    ]
