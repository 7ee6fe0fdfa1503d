"""Fewer corners without new crossings, and the inner point farthest from a shape's edge."""

from __future__ import annotations

import heapq
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Corners whose distances are computed one by one instead of as an array.
_SHORT = 24


class _CornerGrid:
    """Corners of all rings of a shape by square cell; corners that went are skipped when read."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x0, self.y0 = float(x.min()), float(y.min())
        extent = max(float(x.max()) - self.x0, float(y.max()) - self.y0)
        self.size = extent / max(1.0, len(x) ** 0.5) or 1.0
        self.cells: dict[tuple[int, int], list[int]] = {}
        for i, cell in enumerate(zip(((x - self.x0) // self.size).astype(int).tolist(), ((y - self.y0) // self.size).astype(int).tolist())):
            self.cells.setdefault(cell, []).append(i)

    def around(self, xs: tuple[float, ...], ys: tuple[float, ...]):
        for cx in range(int((min(xs) - self.x0) // self.size), int((max(xs) - self.x0) // self.size) + 1):
            for cy in range(int((min(ys) - self.y0) // self.size), int((max(ys) - self.y0) // self.size) + 1):
                yield from self.cells.get((cx, cy), ())


def _in_triangle(px, py, ax, ay, bx, by, cx, cy) -> bool:
    """Edges included; a flat triangle holds the points of its line."""
    d1 = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
    d2 = (cx - bx) * (py - by) - (cy - by) * (px - bx)
    d3 = (ax - cx) * (py - cy) - (ay - cy) * (px - cx)
    if not ((d1 >= 0 and d2 >= 0 and d3 >= 0) or (d1 <= 0 and d2 <= 0 and d3 <= 0)):
        return False
    return min(ax, bx, cx) <= px <= max(ax, bx, cx) and min(ay, by, cy) <= py <= max(ay, by, cy)


def kept_corners(rings: list[np.ndarray], closed: bool, tolerance: float) -> list[np.ndarray]:
    """Positions that stay in each ring (points as rows; closed rings repeat the first point).

    Corners go one at a time, the one whose removal moves the line least first, as long as every
    corner gone stays within ``tolerance`` of the line that replaces it. A corner stays while another corner of the
    shape lies in the triangle that its removal would cut off: only then could the new line cross or touch a ring,
    or a ring change sides. Ends of lines, first points of rings and three corners of a ring always stay.
    """
    sizes = [len(r) - 1 if closed and len(r) > 1 else len(r) for r in rings]
    base = np.cumsum([0, *sizes])
    if not base[-1]:
        return [np.arange(len(r)) for r in rings]
    points = np.concatenate([r[:n] for r, n in zip(rings, sizes)])
    x, y = points.T
    xs, ys = x.tolist(), y.tolist()
    grid = _CornerGrid(x, y)
    before = [0] * len(xs)
    after = [0] * len(xs)
    fixed, ring_of = [False] * len(xs), [0] * len(xs)
    for k, n in enumerate(sizes):
        low = int(base[k])
        for i in range(n):
            before[low + i], after[low + i], ring_of[low + i] = low + (i - 1) % n, low + (i + 1) % n, k
        if n:
            fixed[low] = True
            if not closed:
                fixed[low + n - 1] = True
    left = list(sizes)
    alive, version = [True] * len(xs), [0] * len(xs)

    def cost(v: int) -> float:
        p, n = before[v], after[v]
        if 0 < n - p <= _SHORT:  # the same arithmetic without arrays, far faster for a few corners
            xp, yp = xs[p], ys[p]
            dx, dy = xs[n] - xp, ys[n] - yp
            length, most = dx * dx + dy * dy, 0.0
            for i in range(p + 1, n):
                px, py = xs[i] - xp, ys[i] - yp
                along = min(max((px * dx + py * dy) / length, 0.0), 1.0) if length > 0 else 0.0
                try:
                    far = abs(complex(px - along * dx, py - along * dy))
                except OverflowError:
                    far = float("inf")
                if not far <= most:  # what is no number stays one
                    most = far
                    if far != far:
                        break
            return most
        low, size = int(base[ring_of[v]]), sizes[ring_of[v]]
        span = np.arange(p + 1, n) if p < n else low + np.arange(p + 1 - low, n - low + size) % size
        px, py = x[span] - xs[p], y[span] - ys[p]
        dx, dy = xs[n] - xs[p], ys[n] - ys[p]
        length = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / length, 0, 1) if length > 0 else 0.0
        return float(np.hypot(px - along * dx, py - along * dy).max())

    heap: list[tuple[float, int, int]] = []

    def offer(v: int) -> None:
        if alive[v] and not fixed[v]:
            version[v] += 1
            c = cost(v)
            if c <= tolerance:
                heapq.heappush(heap, (c, v, version[v]))

    for v in range(len(xs)):
        offer(v)
    waiting: dict[int, list[int]] = {}
    while heap:
        _, v, number = heapq.heappop(heap)
        if not alive[v] or number != version[v] or (closed and left[ring_of[v]] <= 3):
            continue
        p, n = before[v], after[v]
        tx, ty = (xs[p], xs[v], xs[n]), (ys[p], ys[v], ys[n])
        blocker = None
        for o in grid.around(tx, ty):
            if alive[o] and o not in (p, v, n) and _in_triangle(xs[o], ys[o], tx[0], ty[0], tx[1], ty[1], tx[2], ty[2]):
                if (xs[o], ys[o]) not in ((tx[0], ty[0]), (tx[2], ty[2])):
                    blocker = o
                    break
        if blocker is not None:
            waiting.setdefault(blocker, []).append(v)
            continue
        alive[v] = False
        left[ring_of[v]] -= 1
        after[p], before[n] = n, p
        for w in (p, n, *waiting.pop(v, ())):
            offer(w)
    kept = []
    for k, (ring, n) in enumerate(zip(rings, sizes)):
        stays = np.flatnonzero(alive[base[k] : base[k + 1]])
        kept.append(np.append(stays, n) if len(ring) > n else stays)
    return kept


def _pair_of(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("x", kind), T.StructField("y", kind)])


@F.pandas_udf(_pair_of(T.ArrayType(T.ArrayType(T.DoubleType()))))
def thinned_rings(xs: pd.Series, ys: pd.Series, ring_ends: pd.Series, tolerance: pd.Series, closed: pd.Series) -> pd.DataFrame:
    """Each row's rings with the corners that ``kept_corners`` leaves."""
    out_x, out_y = [], []
    for x, y, ends, tol, area in zip(xs, ys, ring_ends, tolerance, closed):
        if x is None:
            out_x.append(None)
            out_y.append(None)
            continue
        rings = [np.stack([x[a:b], y[a:b]], 1) for a, b in zip([0, *ends[:-1]], ends)]
        stay = kept_corners(rings, bool(area), float(tol))
        out_x.append([r[k, 0] for r, k in zip(rings, stay)])
        out_y.append([r[k, 1] for r, k in zip(rings, stay)])
    return pd.DataFrame({"x": out_x, "y": out_y})


def _gap(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of points to the nearest edge, negative outside (even-odd over all rings)."""
    x1, y1, x2, y2 = edges.T[:, :, None]
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(length > 0, length, 1), 0, 1)
    near = np.hypot(x - x1 - along * dx, y - y1 - along * dy).min(0)
    spans = (y1 > y) != (y2 > y)
    at = x1 + (y - y1) * dx / np.where(dy != 0, dy, 1)
    return np.where((spans & (x < at)).sum(0) % 2 == 1, near, -near)


def inner_point(rings: list[np.ndarray], precision: float = 1e-6) -> tuple[float, float, float] | None:
    """The point of a polygon farthest from its edge and that distance; None without an inside.

    Squares cover the shape. A square can hold nothing farther than its middle plus half its diagonal, so
    those that cannot beat the best middle by ``precision`` (a share of the shape's width) go and the rest
    are quartered. Of points that tie to within the precision one is taken, always the same.
    """
    edges = np.concatenate([np.concatenate([r[:-1], r[1:]], 1) for r in rings])
    low, high = rings[0].min(0), rings[0].max(0)
    size = float((high - low).max())
    if not size > 0:
        return None
    half = float((high - low).min()) / 2 or size / 2
    nx, ny = (max(1, int(np.ceil((high[i] - low[i]) / (2 * half)))) for i in (0, 1))
    half = max((high[0] - low[0]) / nx, (high[1] - low[1]) / ny) / 2
    gx, gy = np.meshgrid(low[0] + half * (2 * np.arange(nx) + 1), low[1] + half * (2 * np.arange(ny) + 1))
    x, y = gx.ravel(), gy.ravel()
    best = (-np.inf, 0.0, 0.0)
    while len(x):
        block = max(1, 1_000_000 // len(edges))
        gap = np.concatenate([_gap(edges, x[i : i + block], y[i : i + block]) for i in range(0, len(x), block)])
        i = int(gap.argmax())
        if gap[i] > best[0]:
            best = (float(gap[i]), float(x[i]), float(y[i]))
        more = gap + half * 2**0.5 > best[0] + precision * size
        half /= 2
        x, y = (np.concatenate([c[more] + s * half for s in signs]) for c, signs in ((x, (-1, 1, -1, 1)), (y, (-1, -1, 1, 1))))
    return (best[1], best[2], best[0]) if best[0] > 0 else None


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x", "y", "gap")]))
def inner_points(xs: pd.Series, ys: pd.Series, ring_ends: pd.Series, rings: pd.Series, precision: pd.Series) -> pd.DataFrame:
    """The inner point of each row's widest part: the one whose inner point lies farthest from the edge, the first of equal ones."""
    out = []
    for x, y, ends, per_part, share in zip(xs, ys, ring_ends, rings, precision):
        best = None
        if x is not None:
            pieces = [np.stack([x[a:b], y[a:b]], 1) for a, b in zip([0, *ends[:-1]], ends)]
            start = 0
            for n in per_part:
                part, start = [r for r in pieces[start : start + n] if len(r) > 3], start + n
                found = inner_point(part, float(share)) if part else None
                if found and (best is None or found[2] > best[2]):
                    best = found
        out.append(best or (None, None, None))
    return pd.DataFrame(out, columns=["x", "y", "gap"], dtype=float)
