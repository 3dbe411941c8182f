"""Piecewise-linear profiles held as sorted arrays of nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(x: Column, at: Column) -> Column:
    """Index of the segment's right node: the first node at or after `at`, from 1 to size - 1."""
    before = F.size(F.filter(x, lambda v: v < at))
    return F.greatest(F.least(before, F.size(x) - 1), F.lit(1))


def value_at(x: Column, y: Column, at: Column) -> Column:
    """Linear value, held at the ends; x ascending, at least one node. A single node is a constant."""
    i = _segment(x, at)
    x0, x1, y0, y1 = F.get(x, i - 1), F.get(x, i), F.get(y, i - 1), F.get(y, i)
    inner = y0 + (y1 - y0) * (at - x0) / F.nullif(x1 - x0, F.lit(0.0))
    last = F.size(x) - 1
    return F.when(at <= F.get(x, F.lit(0)), F.get(y, F.lit(0))).when(at >= F.get(x, last), F.get(y, last)).otherwise(inner)


def slope_at(x: Column, y: Column, at: Column) -> Column:
    """Slope of the segment that holds `at`; at a node, of the segment on its left; 0 for a single node."""
    i = _segment(x, at)
    return F.when(F.size(x) < 2, 0.0).otherwise((F.get(y, i) - F.get(y, i - 1)) / F.nullif(F.get(x, i) - F.get(x, i - 1), F.lit(0.0)))


def between(x0: Column, y0: Column, x1: Column, y1: Column, at: Column) -> Column:
    """Value on the line through two points; y0 where they share x."""
    return F.when(x0 == x1, y0).otherwise(y0 + (y1 - y0) * (at - x0) / F.nullif(x1 - x0, F.lit(0.0)))
