"""Upper median, anchored modal bins, tolerance sets and spans, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """A double as SQL rounds it: scaled, to the nearest whole number (halves away from zero), and back. Spark's round takes
    the decimal digits that are printed instead, and differs where the value isn't exactly what is printed."""
    scale = 10.0**digits
    return F.round(value * scale) / scale


def upper_median(values: Column) -> Column:
    """The element at n/2 of the sorted array; no interpolation. Null if empty."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def dedupe(values: Column, tolerance: float) -> Column:
    """Sorted values, without those within the tolerance of the last kept one."""
    empty = F.slice(F.array_sort(values), 1, 0)
    return F.aggregate(
        F.array_sort(values),
        empty,
        lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(v))).otherwise(kept),
    )


def intersect(a: Column, b: Column, tolerance: float) -> Column:
    """Values of a within the tolerance of some value of b."""
    return F.filter(a, lambda x: F.exists(b, lambda y: F.abs(x - y) <= tolerance))


def greedy_breaks(text: Column, measure: int) -> Column:
    """Lines of first-fit breaking at single spaces, widths counted in characters."""
    words = F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    return F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda lines, w: F.when(
            (F.size(lines) > 0) & (F.length(F.try_element_at(lines, F.lit(-1))) + 1 + F.length(w) <= measure),
            F.concat(F.slice(lines, F.lit(1), F.size(lines) - 1), F.array(F.concat_ws(" ", F.try_element_at(lines, F.lit(-1)), w))),
        ).otherwise(F.concat(lines, F.array(w))),
    )
