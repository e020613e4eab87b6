"""Rectangles as structs (x0, y0, x1, y1) of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip((x0, y0, x1, y1), SIDES, strict=True)))


def union(a: Column, b: Column) -> Column:
    return _box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def intersection(a: Column, b: Column) -> Column:
    """The overlap, null if there is none; boxes that touch overlap in an empty box, which isn't null."""
    x0, y0, x1, y1 = F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"])
    return F.when((x0 <= x1) & (y0 <= y1), _box(x0, y0, x1, y1))


def bounds(box: Column) -> Column:
    """Aggregate: the union of all boxes of a group."""
    return _box(F.min(box["x0"]), F.min(box["y0"]), F.max(box["x1"]), F.max(box["y1"]))
