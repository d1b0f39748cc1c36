"""Algebra of boxes given as structs ``(left, top, right, bottom)``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b["right"] - b["left"], F.lit(0)) * F.greatest(b["bottom"] - b["top"], F.lit(0))


def overlap(a: Column, b: Column) -> Column:
    """Common area over the smaller area."""
    wide = F.greatest(F.least(a["right"], b["right"]) - F.greatest(a["left"], b["left"]), F.lit(0))
    high = F.greatest(F.least(a["bottom"], b["bottom"]) - F.greatest(a["top"], b["top"]), F.lit(0))
    return wide * high / F.greatest(F.least(area(a), area(b)), F.lit(1))


def bounds(points: Column) -> Column:
    """The box around an array of ``(x, y)``."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))


def inset(b: Column, width: Column, height: Column, margin: float = 0.025) -> Column:
    """The box moved inside so that it keeps ``margin`` of the picture's sides from the border, where it fits."""
    dx = lambda side, low, high: F.greatest(F.lit(0.0), side * margin - low) - F.greatest(F.lit(0.0), high - side * (1 - margin))
    x, y = dx(width, b["left"], b["right"]), dx(height, b["top"], b["bottom"])
    return F.struct((b["left"] + x).alias("left"), (b["top"] + y).alias("top"), (b["right"] + x).alias("right"), (b["bottom"] + y).alias("bottom"))
