"""Exact Delaunay triangulation of the soundings of one block.

Points are inserted one by one: a walk finds the triangle around the point, the
triangles whose circle holds it are dug out and the cavity is joined to it.  A
vertex at infinity (``GHOST``) closes the hull, so points on hull edges and far
outside need no special size of frame.

Orientation and in-circle tests are exact: coordinates become integers by one
power of two.  Where four points lie on one circle, the point of least id counts
as lifted a little, which decides every tie the same way in any block that has
the points; the triangulation of a set is therefore unique.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1


def integers(x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """Coordinates from the least ones on, in units of one power of two, without rounding."""
    parts = [[Fraction(float(v)) for v in c] for c in (x, y)]
    unit = max(f.denominator for p in parts for f in p)
    out = []
    for p in parts:
        whole = [f.numerator * (unit // f.denominator) for f in p]
        least = min(whole)
        out.append([w - least for w in whole])
    return out[0], out[1]


class Triangulation:
    """Delaunay triangulation of distinct points; ``apex`` has the third vertex
    of the triangle on the left of each directed edge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray):
        self.apex: dict[tuple[int, int], int] = {}
        if len(x) < 3:
            return
        self.x, self.y = integers(x, y)
        self.ids = [int(i) for i in ids]
        order = _snake(x, y)
        a, b = order[0], order[1]
        c = next((i for i in order[2:] if self._turn(a, b, i)), None)
        if c is None:
            return
        if self._turn(a, b, c) < 0:
            a, b = b, a
        for u, v in ((a, b), (b, c), (c, a)):
            self.apex[u, v] = a + b + c - u - v
            self._join(v, u, GHOST)
        self.at = (a, b)
        for p in order:
            if p not in (a, b, c):
                self._insert(p)

    def triangles(self) -> np.ndarray:
        """Vertices in counter-clockwise order, the least index first."""
        t = [(u, v, w) for (u, v), w in self.apex.items() if GHOST not in (u, v, w) and u < v and u < w]
        return np.array(t, np.int64).reshape(-1, 3)

    def _turn(self, a: int, b: int, c: int) -> int:
        """Above zero where a, b, c turn left."""
        x, y = self.x, self.y
        return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])

    def _holds(self, a: int, b: int, c: int, p: int) -> bool:
        """The circle of the triangle has p inside; for a hull edge, p is beyond it or on it."""
        if a == GHOST:
            a, b, c = b, c, a
        elif b == GHOST:
            a, b, c = c, a, b
        if c == GHOST:
            side = self._turn(a, b, p)
            if side:
                return side > 0
            x, y = self.x, self.y
            return (x[a] - x[p]) * (x[b] - x[p]) + (y[a] - y[p]) * (y[b] - y[p]) < 0
        x, y = self.x, self.y
        ax, ay, bx, by, cx, cy = x[a] - x[p], y[a] - y[p], x[b] - x[p], y[b] - y[p], x[c] - x[p], y[c] - y[p]
        det = ((ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy)
               + (cx * cx + cy * cy) * (ax * by - bx * ay))
        if det:
            return det > 0
        ids = self.ids
        low = min(ids[a], ids[b], ids[c], ids[p])
        if ids[p] == low:
            return False
        if ids[b] == low:
            a, b, c = b, c, a
        elif ids[c] == low:
            a, b, c = c, a, b
        return self._turn(p, b, c) > 0

    def _join(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b

    def _around(self, p: int) -> tuple[int, int]:
        """An edge of a triangle that holds p: of the one around it, or at the hull where it is outside."""
        u, v = self.at
        while True:
            w = self.apex[u, v]
            if w == GHOST:
                return u, v
            if self._turn(v, w, p) < 0:
                u, v = w, v
            elif self._turn(w, u, p) < 0:
                u, v = u, w
            elif self._turn(u, v, p) < 0:
                u, v = v, u
            else:
                return u, v

    def _insert(self, p: int) -> None:
        u, v = self._around(p)
        w = self.apex[u, v]
        stack = []
        for e in ((u, v), (v, w), (w, u)):
            del self.apex[e]
            stack.append(e)
        rim = []
        while stack:
            u, v = stack.pop()
            w = self.apex.get((v, u))
            if w is None:  # dug out from both sides
                continue
            if self._holds(v, u, w, p):
                del self.apex[v, u], self.apex[u, w], self.apex[w, v]
                stack += ((u, w), (w, v))
            else:
                rim.append((u, v))
        for u, v in rim:
            self._join(u, v, p)
            if GHOST not in (u, v):
                self.at = (u, v)


def _snake(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Points in rows, each run the other way than the last, so that neighbours follow each other."""
    rows = max(1, int(np.sqrt(len(x) / 3)))
    span = float(np.ptp(y)) or 1.0
    row = np.minimum(((y - y.min()) / span * rows).astype(np.int64), rows - 1)
    return np.lexsort((np.where(row % 2, -x, x), row)).tolist()


def circles_within(x: np.ndarray, y: np.ndarray, tri: np.ndarray, region: tuple[float, float, float, float]) -> np.ndarray:
    """Triangles whose circle surely lies inside the open rectangle (x0, x1, y0, y1).

    Slivers, whose circle floats do not settle, count as not inside, unless the
    rectangle is the whole plane."""
    x0, x1, y0, y1 = region
    if x0 == y0 == -np.inf and x1 == y1 == np.inf:
        return np.ones(len(tri), bool)
    a, b, c = tri.T
    bx, by, cx, cy = x[b] - x[a], y[b] - y[a], x[c] - x[a], y[c] - y[a]
    det, bb, cc = bx * cy - by * cx, bx * bx + by * by, cx * cx + cy * cy
    with np.errstate(divide="ignore", invalid="ignore"):
        ux, uy = (cy * bb - by * cc) / (2 * det), (bx * cc - cx * bb) / (2 * det)
        sure = np.abs(det) > 1e-6 * np.sqrt(bb * cc)
        r = np.hypot(ux, uy) * (1 + 1e-6) + 1e-9 * (np.abs(x[a]) + np.abs(y[a])) * 1e-3
        ux, uy = ux + x[a], uy + y[a]
        return sure & (ux - r > x0) & (ux + r < x1) & (uy - r > y0) & (uy + r < y1)
