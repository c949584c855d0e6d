"""Column functions on rectangles: structs (or anything with fields) x, y, w, h; origin at the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(x, y, w, h) -> Column:
    """A rectangle of columns, column names or numbers."""
    column = lambda v: F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(column(v).alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)))


def right(r: Column) -> Column:
    return r["x"] + r["w"]


def bottom(r: Column) -> Column:
    return r["y"] + r["h"]


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def center_x(r: Column) -> Column:
    return r["x"] + r["w"] / 2


def center_y(r: Column) -> Column:
    return r["y"] + r["h"] / 2


def contains(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x <= right(r)) & (y >= r["y"]) & (y <= bottom(r))


def contains_center(r: Column, of: Column) -> Column:
    return contains(r, center_x(of), center_y(of))


def intersects(a: Column, b: Column) -> Column:
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < bottom(b)) & (b["y"] < bottom(a))


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return rect(x0, y0, x1 - x0, y1 - y0)


def intersection(a: Column, b: Column) -> Column:
    """The common rectangle, or null."""
    return F.when(intersects(a, b), corners(F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]), F.least(right(a), right(b)), F.least(bottom(a), bottom(b))))


def is_empty(r: Column) -> Column:
    return (r["w"] <= 0) | (r["h"] <= 0)


def union(a: Column, b: Column) -> Column:
    both = corners(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(right(a), right(b)), F.greatest(bottom(a), bottom(b)))
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(both)


def h_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(right(a), right(b)) - F.greatest(a["x"], b["x"]), F.lit(0.0))


def v_overlap(a: Column, b: Column) -> Column:
    return F.greatest(F.least(bottom(a), bottom(b)) - F.greatest(a["y"], b["y"]), F.lit(0.0))


def h_gap(a: Column, b: Column) -> Column:
    return F.greatest(b["x"] - right(a), a["x"] - right(b), F.lit(0.0))


def v_gap(a: Column, b: Column) -> Column:
    return F.greatest(b["y"] - bottom(a), a["y"] - bottom(b), F.lit(0.0))


def overlap_area(a: Column, b: Column) -> Column:
    return h_overlap(a, b) * v_overlap(a, b)


def overlap_fraction(a: Column, b: Column) -> Column:
    """The share of ``a`` inside ``b``; 0 if ``a`` has no area."""
    return F.when(area(a) > 0, overlap_area(a, b) / area(a)).otherwise(F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    both = area(a) + area(b) - overlap_area(a, b)
    return F.when(both > 0, overlap_area(a, b) / both).otherwise(F.lit(0.0))


def inflate(r: Column, dx, dy) -> Column:
    return rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)


def to_points(r: Column, dpi, ox=0.0, oy=0.0) -> Column:
    k = 72.0 / dpi
    return rect((r["x"] + ox) * k, (r["y"] + oy) * k, r["w"] * k, r["h"] * k)


def to_pixels(r: Column, dpi, ox=0.0, oy=0.0) -> Column:
    k = dpi / 72.0
    return rect(r["x"] * k - ox, r["y"] * k - oy, r["w"] * k, r["h"] * k)


def map_back(r: Column, degrees: float, cx: float, cy: float) -> Column:
    """The bounding box of ``r`` turned by ``degrees`` about a point."""
    cos, sin = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees)))
    turned = [(cx + (x - cx) * cos - (y - cy) * sin, cy + (x - cx) * sin + (y - cy) * cos) for x in (r["x"], right(r)) for y in (r["y"], bottom(r))]
    xs, ys = [t[0] for t in turned], [t[1] for t in turned]
    return corners(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def crosses_gutter(a: Column, b: Column, gutters: Column) -> Column:
    """Whether the centres lie on opposite sides of some gutter's middle."""
    return F.exists(gutters, lambda g: (center_x(a) < (g["x0"] + g["x1"]) / 2) != (center_x(b) < (g["x0"] + g["x1"]) / 2))
