"""Pairs of shapes that share a window, as arrays: the relations of ``shapes`` for all windows of a block at once.

A shape is a place in arrays x0, y0, x1, y1 and, where some are segments, ax, ay, bx, by, which are NaN for a box. Pairs are
worked on in chunks of ``MOST``, so that memory grows with the shapes of a block and what is kept of them, not with its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .codes import rounded
from .shapes import _cross, _from_segment

MOST = 1 << 19
BOX, LINE = ("x0", "y0", "x1", "y1"), ("ax", "ay", "bx", "by")


class Shapes:
    """The shapes of a table (keys, object_type, id, box and line), in the order of window and least x; ``at`` is their row in the table."""

    def __init__(self, table: pa.Table, keys: list[str]):
        self.table = table.combine_chunks()
        numbers = lambda c: self.table[c].to_numpy().astype(float)
        window = np.zeros(len(table), np.int64)
        for c in keys:
            code = _ranks(self.table[c])
            window = np.unique(window * (code.max(initial=0) + 1) + code, return_inverse=True)[1]
        x0 = numbers("x0")
        self.at = np.lexsort((x0, window))
        self.window = window[self.at]
        for c in BOX + (LINE if "ax" in table.column_names else ()):
            setattr(self, c, numbers(c)[self.at])
        self.line = ~np.isnan(self.ax) if "ax" in table.column_names else None
        kind, own = (_ranks(self.table[c]) for c in ("object_type", "id"))
        #: Equal for rows of one object, in the order of type and id.
        self.name = np.unique(kind * (own.max(initial=0) + 1) + own, return_inverse=True)[1][self.at]

    def __len__(self) -> int:
        return len(self.at)

    def by_type(self, values: dict[str, float], none: float) -> np.ndarray:
        kinds = self.table["object_type"].combine_chunks().dictionary_encode()
        each = np.array([values.get(k, none) for k in kinds.dictionary.to_pylist()], float)
        return each[kinds.indices.to_numpy()][self.at]

    def part(self, i: np.ndarray) -> dict[str, np.ndarray]:
        return {c: getattr(self, c)[i] for c in BOX + LINE}

    def relations(self, keys: list[str], i: np.ndarray, j: np.ndarray, distance: np.ndarray | None) -> pa.Table:
        """Both directions of pairs of places."""
        a, b = (pa.array(self.at[np.concatenate(x)]) for x in ((i, j), (j, i)))
        far = pa.nulls(len(a), pa.float64()) if distance is None else pa.array(np.concatenate([distance, distance]))
        columns = {c: self.table[c].take(a) for c in keys}
        return pa.table(columns | {"src_type": self.table["object_type"].take(a), "src": self.table["id"].take(a), "dst_type": self.table["object_type"].take(b), "dst": self.table["id"].take(b), "distance": far})


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers in the order of a column's values, from 0."""
    if pa.types.is_integer(column.type):
        return np.unique(column.to_numpy(), return_inverse=True)[1].astype(np.int64)
    coded = column.combine_chunks().dictionary_encode()
    values = coded.dictionary.to_pylist()
    rank = np.empty(len(values), np.int64)
    rank[sorted(range(len(values)), key=values.__getitem__)] = np.arange(len(values))
    return rank[coded.indices.to_numpy()]


def sweep(s: Shapes, reach: float, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each pair of a window whose boxes are at most ``reach`` apart along x, once, in chunks of about ``most``."""
    n = len(s)
    if not n:
        return
    least = s.x0.min()
    span = s.x1.max() - least + reach + 1
    key, last = s.window * span + (s.x0 - least), s.window * span + (s.x1 - least) + reach
    # A little more than the sum's rounding; the exact tests of a pair come later.
    count = np.searchsorted(key, last + np.minimum(4 * np.spacing(np.abs(last)), 0.5), side="right") - np.arange(n) - 1
    before = np.concatenate([[0], np.cumsum(count)])
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(before, before[first] + most, side="right")) - 1)
        own = count[first:end]
        a = np.repeat(np.arange(first, end), own)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(before[first:end] - before[first], own)
        first = end


def _least(*values: np.ndarray) -> np.ndarray:
    return np.minimum.reduce(values)


def _most(*values: np.ndarray) -> np.ndarray:
    return np.maximum.reduce(values)


def _sides(s: dict, t: dict) -> list[np.ndarray]:
    """On which side of the line s the corners or ends of t lie; a segment's ends count twice."""
    line = ~np.isnan(t["ax"])
    corners = (("x0", "y0", "ax", "ay"), ("x1", "y0", "bx", "by"), ("x1", "y1", "ax", "ay"), ("x0", "y1", "bx", "by"))
    return [_cross(*(s[n] for n in LINE), np.where(line, t[p], t[x]), np.where(line, t[q], t[y])) for x, y, p, q in corners]


def meet(s: dict, t: dict) -> np.ndarray:
    """``shapes.meet`` of arrays."""
    out = (s["x0"] <= t["x1"]) & (t["x0"] <= s["x1"]) & (s["y0"] <= t["y1"]) & (t["y0"] <= s["y1"])
    for a, b in ((s, t), (t, s)):
        sides = _sides(a, b)
        out &= np.isnan(a["ax"]) | ~((_least(*sides) > 0) | (_most(*sides) < 0))
    return out


def cover(s: dict, t: dict) -> np.ndarray:
    """``shapes.cover`` of arrays."""
    box = (s["x0"] <= t["x0"]) & (s["y0"] <= t["y0"]) & (s["x1"] >= t["x1"]) & (s["y1"] >= t["y1"])
    return box & (np.isnan(s["ax"]) | (_most(*map(np.abs, _sides(s, t))) == 0))


def line_gap(s: dict, t: dict) -> np.ndarray:
    """Squared distance of segments s from shapes t, 0 where they meet."""
    line = ~np.isnan(t["ax"])
    own = [s[n] for n in LINE]
    out = np.full(len(line), np.inf)
    corners = [(np.where(line, t[p], t[x]), np.where(line, t[q], t[y])) for x, y, p, q in (("x0", "y0", "ax", "ay"), ("x1", "y0", "bx", "by"), ("x1", "y1", "ax", "ay"), ("x0", "y1", "bx", "by"))]
    for c, d in zip(corners, corners[1:] + corners[:1]):
        np.minimum(out, _from_segment(*own, *c), out=out)
        for p in (own[:2], own[2:]):
            np.minimum(out, _from_segment(*c, *d, *p), out=out)
    out[meet(s, t)] = 0.0
    return out


def nearest(table: pa.Table, keys: list[str], radius: dict[str, float], k: dict[str, int], most: int = MOST) -> pa.Table:
    """``relations.nearest`` of the windows of a table."""
    s = Shapes(table, keys)
    n = len(s)
    limit, wanted = s.by_type({t: r * r for t, r in radius.items()}, -1.0), s.by_type(k, 0)
    limit[wanted == 0] = -1.0
    held: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]

    def first() -> tuple:
        """Of what is held the first of each source."""
        a, b, square = (np.concatenate(x) for x in zip(*held))
        full = np.bincount(a, minlength=n)[a] > wanted[a]
        at = np.flatnonzero(full)
        at = at[np.lexsort((s.name[b[at]], rounded(square[at]), a[at]))]
        start = np.flatnonzero(np.concatenate([[True], a[at][1:] != a[at][:-1]])) if len(at) else at
        place = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        at = np.concatenate([np.flatnonzero(~full), at[place < wanted[a[at]]]])
        return a[at], b[at], square[at]

    size = 0
    for a, b in sweep(s, max(radius.values()), most):
        gap = lambda low, high: _most(low[a] - high[b], low[b] - high[a], np.zeros(len(a)))  # noqa: E731, B023
        x, y = gap(s.x0, s.x1), gap(s.y0, s.y1)
        square = x * x + y * y
        near = (square <= np.maximum(limit[a], limit[b])) & (s.name[a] != s.name[b])
        a, b, square = a[near], b[near], square[near]
        if s.line is not None:  # the boxes' distance is no greater, so it has been looked at first
            at = np.flatnonzero(s.line[a] | s.line[b])
            turned = ~s.line[a[at]]
            square[at] = line_gap(s.part(np.where(turned, b[at], a[at])), s.part(np.where(turned, a[at], b[at])))
        to, back = square <= limit[a], square <= limit[b]
        held.append((np.concatenate([a[to], b[back]]), np.concatenate([b[to], a[back]]), np.concatenate([square[to], square[back]])))
        size += len(held[-1][0])
        if size > 2 * most:
            held = [first()]
            size = len(held[0][0])
    a, b, square = first()
    # Rows of one object in a window count as one; of several distances the least.
    same = np.unique(s.window * (s.name.max(initial=0) + 1) + s.name, return_index=True, return_inverse=True)
    own = same[1][same[2]]
    a, b = own[a], own[b]
    pair = np.minimum(a, b) * n + np.maximum(a, b)
    order = np.argsort(pair, kind="stable") if len(same[1]) == n else np.lexsort((square, pair))
    order = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])] if len(order) else order
    return s.relations(keys, a[order], b[order], np.sqrt(square[order]))


def intersections(table: pa.Table, keys: list[str], most: int = MOST) -> pa.Table:
    """``relations.shape_intersections`` of the windows of a table."""
    s = Shapes(table, keys)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in sweep(s, 0.0, most):
        near = (s.x0[a] <= s.x1[b]) & (s.x0[b] <= s.x1[a]) & (s.y0[a] <= s.y1[b]) & (s.y0[b] <= s.y1[a]) & (s.name[a] != s.name[b])
        a, b = a[near], b[near]
        holds = lambda i, j: (s.x0[i] <= s.x0[j]) & (s.y0[i] <= s.y0[j]) & (s.x1[i] >= s.x1[j]) & (s.y1[i] >= s.y1[j])
        kept = ~holds(a, b) & ~holds(b, a)
        if s.line is not None:
            at = np.flatnonzero(s.line[a] | s.line[b])
            first, second = s.part(a[at]), s.part(b[at])
            kept[at] = meet(first, second) & ~cover(first, second) & ~cover(second, first)
        found.append((a[kept], b[kept]))
    return s.relations(keys, *(np.concatenate(x) for x in zip(*found)), None)


def containment(table: pa.Table, keys: list[str], holder: str, most: int = MOST) -> pa.Table:
    """Pairs of a box of type ``holder`` and a point of another type that it covers, boundary included."""
    s = Shapes(table, keys)
    held = s.by_type({holder: 1.0}, 0.0) > 0
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for a, b in sweep(s, 0.0, most):
        at = held[a] != held[b]
        a, b = a[at], b[at]
        a, b = np.where(held[a], a, b), np.where(held[a], b, a)
        inside = (s.x0[a] <= s.x0[b]) & (s.x0[b] <= s.x1[a]) & (s.y0[a] <= s.y0[b]) & (s.y0[b] <= s.y1[a])
        found.append((a[inside], b[inside]))
    return s.relations(keys, *(np.concatenate(x) for x in zip(*found)), None)
