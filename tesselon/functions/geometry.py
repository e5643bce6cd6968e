"""Planar geometry kernel on NumPy, and Arrow functions over WKB columns that use it.

A shape is (kind, parts): kind is 'point', 'line' or 'polygon'; a part of a line is an (n, 2) array, a part of a polygon
a list of closed rings, the outer one first. GeometryCollections are refused, and nothing is repaired.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import codes
from .codes import FREQUENCIES, QUIET

NAMES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
Shape = tuple[str, list]


def read_wkb(data: bytes) -> Shape:
    """A shape from two-dimensional WKB of either byte order."""

    def one(at: int):
        order = "<" if data[at] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5

        def ring(at: int):
            n = struct.unpack_from(order + "I", data, at)[0]
            return np.frombuffer(data, order + "f8", 2 * n, at + 4).reshape(n, 2).astype(float), at + 4 + 16 * n

        if kind == 1:
            return kind, [np.frombuffer(data, order + "f8", 2, at).reshape(1, 2).astype(float)], at + 16
        if kind == 2:
            part, at = ring(at)
            return kind, [part], at
        if kind == 3:
            n, rings = struct.unpack_from(order + "I", data, at)[0], []
            at += 4
            for _ in range(n):
                r, at = ring(at)
                rings.append(r)
            return kind, [rings] if rings else [], at
        if kind in (5, 6):
            n, parts = struct.unpack_from(order + "I", data, at)[0], []
            at += 4
            for _ in range(n):
                _, own, at = one(at)
                parts += own
            return kind, parts, at
        raise ValueError(f"geometry of type {NAMES.get(kind, kind)} is not allowed")

    kind, parts, end = one(0)
    if end != len(data):
        raise ValueError("WKB is too long")
    return {1: "point", 2: "line", 5: "line", 3: "polygon", 6: "polygon"}[kind], parts


def write_wkb(shape: Shape) -> bytes:
    """Little-endian WKB; a multi-type only for several parts."""
    kind, parts = shape
    ring = lambda r: struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes()
    body = {"point": lambda p: b"\1" + struct.pack("<I", 1) + np.ascontiguousarray(p, "<f8").tobytes(), "line": lambda p: b"\1" + struct.pack("<I", 2) + ring(p), "polygon": lambda p: b"\1" + struct.pack("<II", 3, len(p)) + b"".join(map(ring, p))}[kind]
    if len(parts) == 1:
        return body(parts[0])
    return b"\1" + struct.pack("<II", {"point": 4, "line": 5, "polygon": 6}[kind], len(parts)) + b"".join(map(body, parts))


def normalized(shape: Shape) -> Shape:
    """The same shape written one way: rings start at their least vertex, outer ones run clockwise and holes the other
    way, lines run from their lesser end, holes and parts are sorted."""
    kind, parts = shape
    key = lambda a: a.tolist()

    def ring(r: np.ndarray, clockwise: bool) -> np.ndarray:
        r = r[:-1]
        if (signed_area(r) < 0) != clockwise:
            r = r[::-1]
        k = min(range(len(r)), key=lambda i: r[i].tolist())
        r = np.roll(r, -k, axis=0)
        return np.vstack([r, r[:1]])

    if kind == "line":
        parts = sorted((p if key(p) <= key(p[::-1]) else p[::-1] for p in parts), key=key)
    elif kind == "polygon":
        parts = sorted(([ring(p[0], True), *sorted((ring(h, False) for h in p[1:]), key=key)] for p in parts), key=lambda p: [key(r) for r in p])
    else:
        parts = sorted(parts, key=key)
    return kind, parts


def signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(shape: Shape) -> float:
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in shape[1]) if shape[0] == "polygon" else 0.0


def length(shape: Shape) -> float:
    return sum(float(np.hypot(*np.diff(p, axis=0).T).sum()) for p in shape[1]) if shape[0] == "line" else 0.0


def measure(shape: Shape) -> float:
    """Area of polygons, length of lines, 0 of points."""
    return area(shape) if shape[0] == "polygon" else length(shape)


def box(shape: Shape) -> tuple[float, float, float, float]:
    points = vertices(shape)
    return *points.min(0), *points.max(0)


def vertices(shape: Shape) -> np.ndarray:
    parts = [r for p in shape[1] for r in p] if shape[0] == "polygon" else shape[1]
    return np.vstack(parts) if parts else np.zeros((0, 2))


def representative(shape: Shape) -> tuple[float, float]:
    """Centroid of polygons, the middle of a line by length, a point itself."""
    kind, parts = shape
    if kind == "point":
        return tuple(parts[0][0])
    if kind == "line":
        steps = [(a, b, math.hypot(*(b - a))) for p in parts for a, b in zip(p, p[1:])]
        left = sum(s for *_, s in steps) / 2
        for a, b, s in steps:
            if s and left <= s:
                return tuple(a + (b - a) * left / s)
            left -= s
        return tuple(parts[0][0])
    total, mx, my = 0.0, 0.0, 0.0
    origin = parts[0][0][0]
    for p in parts:
        for k, r in enumerate(p):
            x, y = (r - origin).T
            cross = x * np.roll(y, -1) - np.roll(x, -1) * y
            sign = (1 if cross.sum() > 0 else -1) * (-1 if k else 1)
            total += sign * cross.sum() / 2
            mx += sign * ((x + np.roll(x, -1)) * cross).sum() / 6
            my += sign * ((y + np.roll(y, -1)) * cross).sum() / 6
    return float(origin[0] + mx / total), float(origin[1] + my / total)


def locate(points: np.ndarray, shape: Shape) -> np.ndarray:
    """Of each point 1 inside the polygon, 0 on its boundary, -1 outside."""
    inside, edge = np.zeros(len(points), bool), np.zeros(len(points), bool)
    x, y = points.T
    for p in shape[1]:
        for r in p:
            for (xa, ya), (xb, yb) in zip(r, r[1:]):
                cross = (xb - xa) * (y - ya) - (yb - ya) * (x - xa)
                edge |= (cross == 0) & (np.minimum(xa, xb) <= x) & (x <= np.maximum(xa, xb)) & (np.minimum(ya, yb) <= y) & (y <= np.maximum(ya, yb))
                inside ^= ((ya > y) != (yb > y)) & ((cross > 0) == (yb > ya))
    return np.where(edge, 0, np.where(inside, 1, -1))


def clip_ring(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a box, side by side; a concave ring may come back with edges that run along the box and return."""
    points = [tuple(p) for p in ring[:-1]]
    for axis, bound, sign in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for a, b in zip(points[-1:] + points[:-1], points):
            da, db = sign * (a[axis] - bound), sign * (b[axis] - bound)
            if (da < 0) != (db < 0):
                t = da / (da - db)
                cut = [a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t]
                cut[axis] = bound
                if da != 0 and db != 0 or (da == 0) == (db < 0):
                    out.append(tuple(cut))
            if db >= 0:
                out.append(b)
        points = [p for i, p in enumerate(out) if p != out[i - 1] or len(out) == 1]
        if len(points) < 3:
            return np.zeros((0, 2))
    return np.array(points + points[:1])


def split_bridges(ring: np.ndarray) -> list[np.ndarray]:
    """The simple rings of a clipped ring: it is cut where edges run back over each other along the box."""
    if not len(ring):
        return []
    # Every vertex that lies within an edge is put on it, so that edges running back over each other are equal.
    points = ring[:-1]
    split = []
    for a, b in zip(points, np.roll(points, -1, axis=0)):
        d = b - a
        if d[0] and d[1]:
            split.append(tuple(a))
            continue
        axis = 0 if d[0] else 1
        on = points[(points[:, 1 - axis] == a[1 - axis]) & (np.minimum(a[axis], b[axis]) < points[:, axis]) & (points[:, axis] < np.maximum(a[axis], b[axis]))]
        split += [tuple(a), *sorted({tuple(p) for p in on}, key=lambda p: abs(p[axis] - a[axis]))]
    edges: dict[tuple, int] = {}
    for a, b in zip(split, split[1:] + split[:1]):
        if edges.get((b, a), 0):
            edges[b, a] -= 1
        else:
            edges[a, b] = edges.get((a, b), 0) + 1
    after: dict[tuple, list] = {}
    for (a, b), n in edges.items():
        after.setdefault(a, []).extend([b] * n)
    rings = []
    while any(after.values()):
        start = next(a for a, to in after.items() if to)
        path = [start]
        while after.get(path[-1]):
            path.append(after[path[-1]].pop())
            if path[-1] in path[:-1]:
                k = path.index(path[-1])
                if len(path) - k > 3:
                    rings.append(np.array(path[k:]))
                path = path[: k + 1]
        if path and len(path) > 1:
            raise ValueError("a clipped ring doesn't close")
    return [r for r in rings if signed_area(r[:-1]) != 0]


def clip_segment(a: np.ndarray, b: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> tuple[np.ndarray, np.ndarray] | None:
    t0, t1 = 0.0, 1.0
    for p, d, lo, hi in ((a[0], b[0] - a[0], x0, x1), (a[1], b[1] - a[1], y0, y1)):
        if d == 0:
            if not lo <= p <= hi:
                return None
            continue
        u, v = sorted(((lo - p) / d, (hi - p) / d))
        t0, t1 = max(t0, u), min(t1, v)
    if t0 >= t1:
        return None
    at = lambda t: a if t == 0 else b if t == 1 else np.clip(a + (b - a) * t, (x0, y0), (x1, y1))
    return at(t0), at(t1)


def clip(shape: Shape, x0: float, y0: float, x1: float, y1: float) -> Shape:
    """What of a shape has area (polygons), length (lines) or place (points) in a closed box; parts that only touch are dropped."""
    kind, parts = shape
    if kind == "point":
        return kind, [p for p in parts if x0 <= p[0, 0] <= x1 and y0 <= p[0, 1] <= y1]
    if kind == "line":
        out: list[list] = []
        for p in parts:
            open_ = False
            for a, b in zip(p, p[1:]):
                cut = clip_segment(a, b, x0, y0, x1, y1)
                if cut is None:
                    open_ = open_ and bool((a == b).all())
                    continue
                if open_ and (out[-1][-1] == cut[0]).all():
                    out[-1].append(cut[1])
                else:
                    out.append([*cut])
                open_ = bool((cut[1] == b).all())
        return kind, [np.array(p) for p in out]
    bx0, by0, bx1, by1 = box(shape)
    if x0 <= bx0 and y0 <= by0 and bx1 <= x1 and by1 <= y1:
        return shape
    if bx0 >= x1 or bx1 <= x0 or by0 >= y1 or by1 <= y0:
        return kind, []
    done = []
    for p in parts:
        outer = split_bridges(clip_ring(p[0], x0, y0, x1, y1))
        holes = [h for r in p[1:] for h in split_bridges(clip_ring(r, x0, y0, x1, y1))]
        for o in outer:
            own = [h for h in holes if (locate((h[:1] + h[1:2]) / 2, ("polygon", [[o]])) >= 0).all() and (locate(h, ("polygon", [[o]])) >= 0).all()]
            if area(("polygon", [[o, *own]])) > 0:
                done.append([o, *own])
    return kind, done


def triangulate(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 3, 2) triangles of a polygon, by cutting ears; holes are joined to the outer ring by bridges first."""
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    outer = rings[0][:-1] if signed_area(rings[0][:-1]) > 0 else rings[0][:-1][::-1]
    points = [tuple(p) for p in outer]
    holes = [[tuple(p) for p in (h[:-1] if signed_area(h[:-1]) < 0 else h[:-1][::-1])] for h in rings[1:]]
    for hole in sorted(holes, key=lambda h: -max(h)[0]):
        k = max(range(len(hole)), key=lambda i: hole[i])
        m = hole[k]
        segments = [(a, b) for h in [points, *holes] for a, b in zip(h, h[1:] + h[:1])]

        def free(v: tuple) -> bool:
            for a, b in segments:
                if m in (a, b) or v in (a, b):
                    continue
                d = [cross(m, v, a), cross(m, v, b), cross(a, b, m), cross(a, b, v)]
                if d[0] * d[1] <= 0 and d[2] * d[3] <= 0 and any(d):
                    return False
            return True

        def opens(i: int) -> bool:  # the bridge leaves the vertex inwards
            a, v, b = points[i - 1], points[i], points[(i + 1) % len(points)]
            left, right = cross(a, v, m) > 0, cross(v, b, m) > 0
            return left and right if cross(a, v, b) > 0 else left or right

        found = sorted((i for i in range(len(points)) if opens(i)), key=lambda i: math.dist(points[i], m))
        i = next((i for i in found if free(points[i])), None)
        if i is None:
            raise ValueError("a hole can't be joined to its polygon")
        points[i : i + 1] = [points[i], *hole[k:], *hole[:k], m, points[i]]
    out = []
    index = list(range(len(points)))
    while len(index) > 3:
        for i in range(len(index)):
            a, b, c = (points[index[(i + d) % len(index)]] for d in (-1, 0, 1))
            turn = cross(a, b, c)
            if turn < 0:
                continue
            if turn > 0 and any(points[j] not in (a, b, c) and cross(a, b, points[j]) >= 0 and cross(b, c, points[j]) >= 0 and cross(c, a, points[j]) >= 0 for j in index):
                continue
            if turn > 0:
                out.append((a, b, c))
            del index[i]
            break
        else:
            raise ValueError("polygon is not simple")
    if cross(*(points[i] for i in index)) > 0:
        out.append(tuple(points[i] for i in index))
    return np.array(out, float).reshape(-1, 3, 2)


def _segments(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Transforms at w (k, 2) of the segments a-b, summed."""
    d, mid = b - a, (a + b) / 2
    return (np.hypot(*d.T)[:, None] * np.exp(-2j * np.pi * mid @ w.T) * np.sinc(d @ w.T)).sum(0)


def _triangles(t: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(n, k) transforms of triangles. With phases a, b, c at its corners a triangle's is twice its area times the
    second divided difference of exp at them, taken over the corners in the order that divides by the greatest gaps;
    where all gaps are small its series is summed instead."""
    size = np.abs((t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 2, 0] - t[:, 0, 0]) * (t[:, 1, 1] - t[:, 0, 1]))
    angle = np.sort(-2 * np.pi * t @ w.T, axis=1)  # (n, 3, k), ascending, so that the ends lie furthest apart
    a, b, c = angle[:, 0], angle[:, 1], angle[:, 2]
    first = lambda p, q: np.exp(0.5j * (p + q)) * np.sinc((q - p) / (2 * np.pi))  # noqa: E731  (e^iq - e^ip) / (i (q - p))
    wide = np.abs(c - a) > 0.5
    exact = (first(b, c) - first(a, b)) / np.where(wide, 1j * (c - a), 1)
    u, v = 1j * (b - a), 1j * (c - a)  # e^{ia} sum over n of h_n(0, u, v) / (n + 2)!
    h, power, term, series = np.ones_like(u), np.ones_like(u), 0.5, np.zeros_like(u)
    for n in range(16):
        series = series + h * term
        power = power * u
        h = h * v + power
        term /= n + 3
    return size[:, None] * np.where(wide, exact, np.exp(1j * a) * series)


def transform(shape: Shape, frequencies: np.ndarray | None = None) -> np.ndarray:
    """Fourier transform of a line's length or a polygon's area measure at each frequency."""
    w = np.array(FREQUENCIES if frequencies is None else frequencies)
    kind, parts = shape
    if kind == "line":
        return _segments(np.vstack([p[:-1] for p in parts]), np.vstack([p[1:] for p in parts]), w)
    if kind == "polygon":
        return _triangles(np.vstack([triangulate(p) for p in parts]), w).sum(0)
    raise ValueError("points have no transform")


def transforms(shapes: list[Shape], frequencies: np.ndarray, most: int = 4096) -> np.ndarray:
    """(shapes, k) transforms, the triangles of many polygons at once."""
    w = np.asarray(frequencies)
    out = np.zeros((len(shapes), len(w)), complex)
    held: list[np.ndarray] = []
    owner: list[int] = []

    def add() -> None:
        if held:
            count = np.array([len(t) for t in held])
            np.add.at(out, np.repeat(owner, count), _triangles(np.vstack(held), w))
            held.clear(), owner.clear()

    for i, shape in enumerate(shapes):
        if shape[0] != "polygon":
            out[i] = transform(shape, w)
            continue
        for p in shape[1]:
            held.append(triangulate(p))
            owner.append(i)
        if len(held) >= most:
            add()
    add()
    return out


def intrinsic(shape: Shape, scale: float = 500.0) -> Shape:
    """The shape about its representative point, in units of a window's side."""
    move = lambda r: (r - representative_) / scale
    representative_ = np.array(representative(shape))
    return shape[0], [[move(r) for r in p] if shape[0] == "polygon" else move(p) for p in shape[1]]


def features(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln(1 + |z|), cosines then sines of the phases), phase 0 up to QUIET."""
    angle = np.where(np.abs(z) <= QUIET, 0.0, np.angle(z))
    return np.log1p(np.abs(z)), np.concatenate([np.cos(angle), np.sin(angle)])


def rectangle(x0: float, y0: float, x1: float, y1: float) -> Shape:
    return "polygon", [[np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)]]


# Arrow functions over WKB columns. They count as nondeterministic, so that a filter on a result doesn't compute it twice.


RECTANGLE = np.frombuffer(b"\1" + struct.pack("<III", 3, 1, 5), np.uint8)


def rectangle_wkb(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """WKB of boxes, all bytes of a batch at once."""

    @F.arrow_udf("binary")
    def build(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        a, b, c, d = (x.to_numpy(zero_copy_only=False) for x in (a, b, c, d))
        ring = np.stack([a, b, c, b, c, d, a, d, a, b], axis=1).astype("<f8")
        out = np.empty((len(a), len(RECTANGLE) + 80), np.uint8)
        out[:, : len(RECTANGLE)] = RECTANGLE
        out[:, len(RECTANGLE) :] = ring.view(np.uint8).reshape(len(a), 80)
        bounds = np.arange(len(a) + 1, dtype=np.int32) * out.shape[1]
        return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(out.reshape(-1))])

    return build(*(c.cast("double") for c in (x0, y0, x1, y1)))


def quads(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, (n, 5, 2) rings) of those values that are polygons of one ring of four convex corners; the rest need a parser."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    size = len(RECTANGLE) + 80
    at = np.flatnonzero((np.diff(offsets) == size) & ~values.is_null().to_numpy(zero_copy_only=False))
    rows = data[offsets[at][:, None] + np.arange(size)]
    own = (rows[:, : len(RECTANGLE)] == RECTANGLE).all(axis=1)
    at, rings = at[own], np.ascontiguousarray(rows[own][:, len(RECTANGLE) :]).view("<f8").reshape(-1, 5, 2).astype(float)
    step = np.diff(np.concatenate([rings, rings[:, 1:2]], axis=1), axis=1)
    turn = step[:, :-1, 0] * step[:, 1:, 1] - step[:, :-1, 1] * step[:, 1:, 0]
    convex = ((turn > 0).all(axis=1) | (turn < 0).all(axis=1)) & (rings[:, 0] == rings[:, 4]).all(axis=1)
    return at[convex], rings[convex]


def quad_transforms(rings: np.ndarray, w: np.ndarray, scale: float = 500.0, most: int = 2048) -> np.ndarray:
    """Transforms of convex quadrilaterals about their centroids, two triangles each, with no loop over shapes."""
    out = np.zeros((len(rings), len(w)), complex)
    for k in range(0, len(rings), most):
        r = rings[k : k + most]
        t = np.stack([r[:, [0, 1, 2]], r[:, [0, 2, 3]]], axis=1)
        size = np.abs((t[..., 1, 0] - t[..., 0, 0]) * (t[..., 2, 1] - t[..., 0, 1]) - (t[..., 2, 0] - t[..., 0, 0]) * (t[..., 1, 1] - t[..., 0, 1]))
        centre = (t.mean(axis=2) * size[..., None]).sum(axis=1) / size.sum(axis=1)[:, None]
        t = (t - centre[:, None, None]) / scale
        out[k : k + most] = _triangles(t.reshape(-1, 3, 2), w).reshape(len(r), 2, len(w)).sum(axis=1)
    return out


def box_transforms(sides: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Transforms of boxes with sides along the axes about their centres. Sides of one length share their waves."""
    out = sides.prod(axis=1)[:, None]
    for axis in (0, 1):
        lengths, own = np.unique(sides[:, axis], return_inverse=True)
        out = out * codes.sinc_of(lengths[:, None] * w[:, axis])[own]
    return out


def inspect(wkb: Column) -> Column:
    """struct(kind, parts, vertices, measure, x, y, xmin, ymin, xmax, ymax, error): the error of WKB that can't be read, else null."""
    fields = [("kind", pa.string()), ("parts", pa.int32()), ("vertices", pa.int32()), *((n, pa.float64()) for n in ("measure", "x", "y", "xmin", "ymin", "xmax", "ymax")), ("error", pa.string())]

    @F.arrow_udf("kind string, parts int, vertices int, measure double, x double, y double, xmin double, ymin double, xmax double, ymax double, error string")
    def run(values: pa.Array) -> pa.Array:
        rows: list = [None] * len(values)
        at, rings = quads(values)
        t = np.stack([rings[:, [0, 1, 2]], rings[:, [0, 2, 3]]], axis=1)
        size = np.abs((t[..., 1, 0] - t[..., 0, 0]) * (t[..., 2, 1] - t[..., 0, 1]) - (t[..., 2, 0] - t[..., 0, 0]) * (t[..., 1, 1] - t[..., 0, 1])) / 2
        centre = (t.mean(axis=2) * size[..., None]).sum(axis=1) / size.sum(axis=1)[:, None]
        known = np.concatenate([size.sum(axis=1)[:, None], centre, rings.min(axis=1), rings.max(axis=1)], axis=1).tolist()
        for i, k in zip(at.tolist(), known):
            rows[i] = ["polygon", 1, 5, *k, None]
        for i, v in enumerate(values.to_pylist()):
            if rows[i] is None:
                row: list = [None] * len(fields)
                if v is not None:
                    try:
                        s = read_wkb(v)
                        row[:10] = [s[0], len(s[1]), len(vertices(s)), *([measure(s), *representative(s), *box(s)] if s[1] else [0.0] + [None] * 6)]
                    except (ValueError, struct.error, IndexError) as e:
                        row[-1] = str(e) or type(e).__name__
                rows[i] = row
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], fields=[pa.field(n, t) for n, t in fields])

    return run.asNondeterministic()(wkb)


def clip_wkb(wkb: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The WKB cut to a box; null where nothing of the shape's own dimension is left. Axis-parallel boxes are cut as arrays."""

    @F.arrow_udf("binary")
    def run(shapes: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        sides = [x.to_numpy(zero_copy_only=False) for x in (a, b, c, d)]
        out: list = [None] * len(shapes)
        at, rings = quads(shapes)
        low, high = rings.min(axis=1), rings.max(axis=1)
        straight = ((rings == low[:, None]) | (rings == high[:, None])).all(axis=(1, 2))
        at, low, high = at[straight], low[straight], high[straight]
        low, high = np.maximum(low, np.stack([sides[0][at], sides[1][at]], axis=1)), np.minimum(high, np.stack([sides[2][at], sides[3][at]], axis=1))
        left = (low < high).all(axis=1)
        # A normalised box starts at its least corner and runs clockwise.
        ring = np.stack([low[:, 0], low[:, 1], low[:, 0], high[:, 1], high[:, 0], high[:, 1], high[:, 0], low[:, 1], low[:, 0], low[:, 1]], axis=1).astype("<f8")
        head = RECTANGLE.tobytes()
        for i, r in zip(at[left].tolist(), ring[left]):
            out[i] = head + r.tobytes()
        done = set(at.tolist())
        for i, v in enumerate(shapes.to_pylist()):
            if v is not None and i not in done:
                cut = clip(read_wkb(v), *(s[i] for s in sides))
                out[i] = write_wkb(normalized(cut)) if cut and cut[1] else None
        return pa.array(out, pa.binary())

    return run.asNondeterministic()(wkb, *(x.cast("double") for x in (x0, y0, x1, y1)))


def covers_point(wkb: Column, x: Column, y: Column, strict: bool = False) -> Column:
    """Whether a polygon holds a point; its boundary counts unless ``strict``. Each polygon of a batch is read once, and its points are tested together."""

    @F.arrow_udf("boolean")
    def run(shapes: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        coded = shapes.dictionary_encode()
        known = np.ones(len(shapes), bool)
        for c in (shapes, xs, ys):
            known &= ~c.is_null().to_numpy(zero_copy_only=False)
        points = np.stack([c.to_numpy(zero_copy_only=False) for c in (xs, ys)], axis=1)
        code = coded.indices.fill_null(-1).to_numpy()
        out = np.zeros(len(shapes), bool)
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        for k, data in enumerate(coded.dictionary.to_pylist()):
            at = order[bounds[k] : bounds[k + 1]]
            at = at[known[at]]
            if len(at):
                out[at] = locate(points[at], read_wkb(data)) >= (1 if strict else 0)
        return pa.array(out, mask=~known)

    return run.asNondeterministic()(wkb, x.cast("double"), y.cast("double"))


def geometry_hash(wkb: Column) -> Column:
    """SHA-256 of the normalised WKB."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else write_wkb(normalized(read_wkb(v))) for v in values.to_pylist()], pa.binary())

    return F.sha2(run.asNondeterministic()(wkb), 256)


def fourier(wkb: Column, frequencies: list[tuple[float, float]] = FREQUENCIES, places: int | None = None) -> Column:
    """struct(re, im): transform of the shape about its representative point, in float64, rounded to ``places``.

    Convex quadrilaterals are done as arrays; those with sides along the axes by their closed form, which has no imaginary part."""
    w = np.array(frequencies)

    @F.arrow_udf("re array<double>, im array<double>")
    def run(values: pa.Array) -> pa.Array:
        re, im = (np.zeros((len(values), len(w))) for _ in "ri")
        known = ~values.is_null().to_numpy(zero_copy_only=False)
        at, rings = quads(values)
        low, high = rings.min(axis=1), rings.max(axis=1)
        straight = ((rings == low[:, None]) | (rings == high[:, None])).all(axis=(1, 2))
        re[at[straight]] = box_transforms((high - low)[straight] / 500.0, w)
        slanting = at[~straight]
        if len(slanting):
            z = quad_transforms(rings[~straight], w)
            re[slanting], im[slanting] = z.real, z.imag
        rest = np.setdiff1d(np.flatnonzero(known), at)
        if len(rest):
            z = transforms([intrinsic(read_wkb(values[int(i)].as_py())) for i in rest], w)
            re[rest], im[rest] = z.real, z.imag
        parts = [codes.lists(p if places is None else codes.rounded(p, places), known) for p in (re, im)]
        return pa.StructArray.from_arrays(parts, ["re", "im"])

    return run.asNondeterministic()(wkb)
