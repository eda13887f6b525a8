"""Numbers of reports: rounding half up, steps, bands, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """One decimal, half up; null where the whole is 0."""
    return F.when(whole != 0, F.round(part.cast("decimal(20,4)") * 100 / whole.cast("decimal(20,4)"), 1))


def average_days(seconds: Column, n: Column) -> Column:
    """One decimal, half up; null where nothing was timed."""
    return F.when(n != 0, F.round(seconds.cast("decimal(20,4)") / 86400 / n, 1))


def to_step(value: Column, step: str) -> Column:
    """Rounded half up to a multiple of the step, in decimals."""
    s = F.lit(step).cast("decimal(10,4)")
    return (F.round(value.cast("decimal(18,4)") / s, 0) * s).cast("decimal(18,4)")


def band(similarity: Column, half: float, full: float) -> Column:
    return F.when(similarity >= full, 1.0).when(similarity >= half, 0.5).otherwise(0.0)


def near_edge(similarity: Column, half: float, full: float, margin: float) -> Column:
    return F.least(F.abs(similarity - half), F.abs(similarity - full)) < margin


def iou(a: str, b: str) -> Column:
    """Intersection over union of two box structs (x0, y0, x1, y1)."""
    both = intersection(a, b)
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(0.0)


def area(a: str) -> Column:
    return (F.col(f"{a}.x1") - F.col(f"{a}.x0")) * (F.col(f"{a}.y1") - F.col(f"{a}.y0"))


def intersection(a: str, b: str) -> Column:
    side = lambda lo, hi: F.greatest(F.least(F.col(f"{a}.{hi}"), F.col(f"{b}.{hi}")) - F.greatest(F.col(f"{a}.{lo}"), F.col(f"{b}.{lo}")), F.lit(0))
    return side("x0", "x1") * side("y0", "y1")


def inside_share(a: str, b: str) -> Column:
    """The share of a that lies in b."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def box_distance(a: str, b: str) -> Column:
    gap = lambda lo, hi: F.greatest(F.col(f"{a}.{lo}") - F.col(f"{b}.{hi}"), F.col(f"{b}.{lo}") - F.col(f"{a}.{hi}"), F.lit(0)).cast("double")
    return F.hypot(gap("x0", "x1"), gap("y0", "y1"))


def sorted_at(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p n))] of an array."""
    n = F.size(values)
    return F.element_at(F.sort_array(values), (F.least(n - 1, F.floor(F.lit(p) * n)) + 1).cast("int"))


def upper_median(values: Column) -> Column:
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def engine_weight(error: Column) -> Column:
    """Half the log odds of being right, not below 0."""
    return F.greatest(F.lit(0.0), 0.5 * F.log((1 - error) / error))


def mark_in_range(mark: Column, most: Column, step: str) -> Column:
    return (mark >= 0) & (mark <= most) & (mark % F.lit(step).cast("decimal(10,4)") == 0)
