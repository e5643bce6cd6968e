"""Exact relations of boxes and segments as native expressions, for columns of one or of two aliases.

A shape is a struct-like prefix of columns: a box has x0, y0, x1, y1; a segment has ax, ay, bx, by as well, which are null
for a box, and its box is that of its ends. Touching counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _cross(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """Which side of the line a-b the point p is on."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


class Shape:
    def __init__(self, alias: str):
        self.x0, self.y0, self.x1, self.y1, self.ax, self.ay, self.bx, self.by = (F.col(f"{alias}.{c}") for c in ("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by"))

    @property
    def line(self) -> Column:
        return self.ax.isNotNull()

    @property
    def corners(self) -> list[tuple[Column, Column]]:
        return [(self.x0, self.y0), (self.x1, self.y0), (self.x1, self.y1), (self.x0, self.y1)]

    @property
    def ends(self) -> list[tuple[Column, Column]]:
        return [(self.ax, self.ay), (self.bx, self.by)]

    def sides(self, points: list[tuple[Column, Column]]) -> list[Column]:
        return [_cross(self.ax, self.ay, self.bx, self.by, *p) for p in points]


def meet(s: Shape, t: Shape) -> Column:
    """Whether two shapes have a point in common: their boxes do, and neither lies on one side of the other's line."""
    boxes = (s.x0 <= t.x1) & (t.x0 <= s.x1) & (s.y0 <= t.y1) & (t.y0 <= s.y1)
    apart = lambda line, points: (F.least(*line.sides(points)) > 0) | (F.greatest(*line.sides(points)) < 0)
    split = lambda line, other: line.line & F.when(other.line, apart(line, other.ends)).otherwise(apart(line, other.corners))
    return boxes & ~split(s, t) & ~split(t, s)


def cover(s: Shape, t: Shape) -> Column:
    """Whether s holds all of t, boundary included. A segment holds a box only where that is a part of it."""
    box = (s.x0 <= t.x0) & (s.y0 <= t.y0) & (s.x1 >= t.x1) & (s.y1 >= t.y1)
    on = lambda points: F.greatest(*(F.abs(c) for c in s.sides(points))) == 0
    return box & (~s.line | F.when(t.line, on(t.ends)).otherwise(on(t.corners)))


def _from_segment(ax, ay, bx, by, px, py):
    """Squared distance of points from segments, arrays of both."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = np.clip(((px - ax) * dx + (py - ay) * dy) / np.where(size == 0, 1, size), 0, 1)
    return (px - (ax + t * dx)) ** 2 + (py - (ay + t * dy)) ** 2


def square_gap(s: Shape, t: Shape) -> Column:
    """Squared distance of two shapes, 0 where they meet: else a corner or end of one is nearest to the other.

    The many terms are worked out on arrays of a batch; as one native expression they outgrow a compiled method."""
    names = ("x0", "y0", "x1", "y1", "ax", "ay", "bx", "by")

    @F.arrow_udf("double")
    def run(*columns: pa.Array) -> pa.Array:
        first, second = ({n: c.to_numpy(zero_copy_only=False).astype(float) for n, c in zip(names, columns[k : k + 8])} for k in (0, 8))
        out = np.full(len(columns[0]), np.inf)

        def outlines(a):
            """Edges: four of a box, one of a segment (the others repeat it)."""
            x0, y0, x1, y1 = (a[n] for n in names[:4])
            line = ~np.isnan(a["ax"])
            for edge in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)):
                yield tuple(np.where(line, a[n], e) for n, e in zip(names[4:], edge))

        for ax, ay, bx, by in outlines(first):
            for cx, cy, dx, dy in outlines(second):
                for p in ((ax, ay), (bx, by)):
                    np.minimum(out, _from_segment(cx, cy, dx, dy, *p), out=out)
                for p in ((cx, cy), (dx, dy)):
                    np.minimum(out, _from_segment(ax, ay, bx, by, *p), out=out)
        return pa.array(out)

    parts = [getattr(x, n).cast("double") for x in (s, t) for n in names]
    return F.when(meet(s, t), F.lit(0.0)).otherwise(run(*parts))
