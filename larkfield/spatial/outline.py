"""Outline at a distance around shapes of any form, for a whole batch of shapes at once.

Every ring is walked with the outside on its right; lines are walked there and back. The raw curve runs
along each edge at the distance, round every corner that turns left, and through the corner itself where it
turns right. It is the shape's own boundary plus the boundaries of a rectangle per edge and a sector per
corner, so the buffer is where the winding number is positive. The raw curves are cut at their
crossings, equal pieces are merged into one with a net direction, and pieces with a positive number on one
side only are the outline.

Coordinates are rounded to a fine grid, cuts are repeated until no new one appears, and winding
numbers are counted on rays half way between grid lines, which never meet a corner. Crossings are searched in
slabs: a segment is compared with those that its slab and its x-range share.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The functions travel inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Grid step in the unit of the coordinates (metres: a micrometre), pairs and vertices handled at a time.
STEP = 1e-6
_PAIRS = 2_000_000
_VERTICES = 50_000
_ANGLES = (0.0, 0.3719, 1.1403)


def _walk(points: np.ndarray, area: bool, hole: bool) -> np.ndarray:
    """The corners of a closed walk with the outside on its right, without repeated points."""
    new = np.append(True, (points[1:] != points[:-1]).any(1))
    points = points[new]
    if area and len(points) > 1 and (points[0] == points[-1]).all():
        points = points[:-1]
    if area and len(points) > 2:
        x, y = (points - points[0]).T
        turn = (x * np.roll(y, -1) - np.roll(x, -1) * y).sum()
        return points[::-1] if (turn < 0) != hole else points
    return np.concatenate([points, points[-2:0:-1]])


def _raw_curve(corners: np.ndarray, sizes: np.ndarray, shape: np.ndarray, distance: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments (x1, y1, x2, y2) of the raw curves of all walks, and the shape that each belongs to."""
    end = np.cumsum(sizes)
    following = np.arange(1, len(corners) + 1)
    following[end - 1] = end - sizes
    of = np.repeat(shape, sizes)
    d = distance[of]
    lone = np.repeat(sizes, sizes) == 1
    edge = corners[following] - corners
    length = np.hypot(edge[:, 0], edge[:, 1])
    length[lone] = 1
    normal = np.stack([edge[:, 1], -edge[:, 0]], 1) / length[:, None]
    normal[lone] = (1.0, 0.0)
    begin, stop = corners + d[:, None] * normal, corners[following] + d[:, None] * normal
    after = edge[following]
    turn = np.arctan2(edge[:, 0] * after[:, 1] - edge[:, 1] * after[:, 0], (edge * after).sum(1))
    turn[turn < -np.pi + 1e-9] = np.pi
    turn[lone] = 2 * np.pi
    segments = [np.concatenate([begin, stop], 1)[~lone]]
    owners = [of[~lone]]
    left = np.flatnonzero(turn > 1e-12)
    pieces = np.maximum(1, np.ceil(turn[left] / (np.pi / (2 * steps)) - 1e-9).astype(int))
    corner = np.repeat(left, pieces)
    nth = np.arange(len(corner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start_angle = np.arctan2(normal[:, 1], normal[:, 0])

    def on_arc(k: np.ndarray) -> np.ndarray:
        angle = start_angle[corner] + turn[corner] * k / np.repeat(pieces, pieces)
        centre = corners[following[corner]]
        at = centre + d[corner][:, None] * np.stack([np.cos(angle), np.sin(angle)], 1)
        at[k == 0] = stop[corner[k == 0]]
        last = k == np.repeat(pieces, pieces)
        at[last] = begin[following[corner[last]]]
        return at

    segments.append(np.concatenate([on_arc(nth), on_arc(nth + 1)], 1))
    owners.append(of[corner])
    right = np.flatnonzero(turn <= 1e-12)
    centre = corners[following[right]]
    segments += [np.concatenate([stop[right], centre], 1), np.concatenate([centre, begin[following[right]]], 1)]
    owners += [of[right], of[right]]
    return np.concatenate(segments), np.concatenate(owners)


@dataclass
class _Slabs:
    """Segments listed in every slab that they cross, by slab and then by smallest x."""

    slab: np.ndarray
    item: np.ndarray
    base: np.ndarray
    low: np.ndarray
    height: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, s: np.ndarray, shape: np.ndarray, shapes: int) -> _Slabs:
        ymin, ymax = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
        low, high = np.full(shapes, np.inf), np.full(shapes, -np.inf)
        np.minimum.at(low, shape, ymin)
        np.maximum.at(high, shape, ymax)
        n = np.maximum(1, np.bincount(shape, minlength=shapes))
        mean = np.bincount(shape, ymax - ymin, minlength=shapes) / n
        extent = np.where(np.isfinite(high - low), high - low, 0)
        height = np.maximum(np.maximum(mean, extent / n), 1.0)
        slabs = (extent // height).astype(np.int64) + 1
        base = np.cumsum(slabs) - slabs
        first = ((ymin - low[shape]) // height[shape]).astype(np.int64) + base[shape]
        last = ((ymax - low[shape]) // height[shape]).astype(np.int64) + base[shape]
        many = last - first + 1
        item = np.repeat(np.arange(len(s)), many)
        slab = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
        order = np.lexsort((np.minimum(s[:, 0], s[:, 2])[item], slab))
        return cls(slab[order], item[order], base, low, height, first)

    def where(self, shape: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((y - self.low[shape]) // self.height[shape]).astype(np.int64) + self.base[shape]


def _spread(start: np.ndarray, stop: np.ndarray):
    """(row, position) for every position from start to stop of every row, in bounded pieces."""
    many = np.maximum(stop - start, 0)
    total = np.cumsum(many)
    at = 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
        n = many[at:to]
        row = np.repeat(np.arange(at, to), n)
        yield row, start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _meeting_pairs(s: np.ndarray, shape: np.ndarray, shapes: int):
    """Pairs of segments of one shape whose boxes meet, each pair once."""
    slabs = _Slabs.of(s, shape, shapes)
    xmin, xmax = np.minimum(s[:, 0], s[:, 2]), np.maximum(s[:, 0], s[:, 2])
    ymin, ymax = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
    values = np.unique(np.concatenate([xmin, xmax]))
    rank = lambda v: np.searchsorted(values, v)
    key = slabs.slab * (len(values) + 1) + rank(xmin)[slabs.item]
    upto = np.searchsorted(key, slabs.slab * (len(values) + 1) + rank(xmax)[slabs.item], "right")
    for row, other in _spread(np.arange(1, len(key) + 1), upto):
        a, b = slabs.item[row], slabs.item[other]
        once = slabs.slab[row] == np.maximum(slabs.first[a], slabs.first[b])
        once &= (ymin[a] <= ymax[b]) & (ymin[b] <= ymax[a])
        yield a[once], b[once]


def _cuts(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments to cut and the grid points where: crossings, and ends that lie on the other segment."""
    p, r = s[a, :2], s[a, 2:] - s[a, :2]
    q, t = s[b, :2], s[b, 2:] - s[b, :2]
    across = r[:, 0] * t[:, 1] - r[:, 1] * t[:, 0]
    w = q - p
    with np.errstate(divide="ignore", invalid="ignore"):
        u = (w[:, 0] * t[:, 1] - w[:, 1] * t[:, 0]) / across
        v = (w[:, 0] * r[:, 1] - w[:, 1] * r[:, 0]) / across
    hit = (across != 0) & (u > 0) & (u < 1) & (v > 0) & (v < 1)
    at = np.round(p[hit] + u[hit, None] * r[hit])
    which, where = [a[hit], b[hit]], [at, at]
    for one, origin, way, other in ((a, p, r, b), (b, q, t, a)):
        reach = np.hypot(way[:, 0], way[:, 1])
        for end in (s[other, :2], s[other, 2:]):
            off = end - origin
            with np.errstate(divide="ignore", invalid="ignore"):
                gap = np.abs(off[:, 0] * way[:, 1] - off[:, 1] * way[:, 0]) / reach
                along = (off * way).sum(1) / reach
            on = (gap <= 0.75) & (along > 0) & (along < reach)
            which.append(one[on])
            where.append(end[on])
    which, where = np.concatenate(which), np.concatenate(where)
    inner = (where != s[which, :2]).any(1) & (where != s[which, 2:]).any(1)
    return which[inner], where[inner]


def _merged(s: np.ndarray, shape: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal segments as one, upwards (or to the right), with their net direction; those that cancel go."""
    down = (s[:, 3] < s[:, 1]) | ((s[:, 3] == s[:, 1]) & (s[:, 2] < s[:, 0]))
    s = np.where(down[:, None], s[:, [2, 3, 0, 1]], s)
    net = np.where(down, -net, net)
    order = np.lexsort((s[:, 3], s[:, 2], s[:, 1], s[:, 0], shape))
    s, shape, net = s[order], shape[order], net[order]
    if not len(s):
        return s, shape, net
    new = np.append(True, (s[1:] != s[:-1]).any(1) | (shape[1:] != shape[:-1]))
    first = np.flatnonzero(new)
    total = np.add.reduceat(net, first)
    kept = (total != 0) & ((s[first, :2] != s[first, 2:]).any(1))
    return s[first][kept], shape[first][kept], total[kept]


def _arranged(s: np.ndarray, shape: np.ndarray, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments that meet at their ends only, with net directions."""
    s, shape, net = _merged(s, shape, np.ones(len(s), np.int64))
    for _ in range(12):
        found = [_cuts(s, a, b) for a, b in _meeting_pairs(s, shape, shapes)]
        which = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        if not len(which):
            break
        where = np.concatenate([f[1] for f in found])
        cut = np.unique(which)
        far = ((where - s[which, :2]) * (s[which, 2:] - s[which, :2])).sum(1)
        order = np.lexsort((far, which))
        which, where = which[order], where[order]
        # a cut segment becomes start, its cuts in order, end
        n = np.bincount(which, minlength=len(s))[cut]
        begin = np.concatenate([s[cut, :2], where])
        stop = np.concatenate([s[cut, 2:], where])
        a_order = np.lexsort((np.concatenate([np.zeros(len(cut)), np.arange(1, len(where) + 1)]), np.concatenate([cut, which])))
        b_order = np.lexsort((np.concatenate([np.full(len(cut), len(where) + 1), np.arange(1, len(where) + 1)]), np.concatenate([cut, which])))
        pieces = np.concatenate([begin[a_order], stop[b_order]], 1)
        of = np.repeat(cut, n + 1)
        rest = np.ones(len(s), bool)
        rest[cut] = False
        s, shape, net = _merged(np.concatenate([s[rest], pieces]), np.concatenate([shape[rest], shape[of]]), np.concatenate([net[rest], net[of]]))
    return s, shape, net


def _winding(s: np.ndarray, shape: np.ndarray, net: np.ndarray, shapes: int, own: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Winding number just right of points on rows ``own`` (their own segment does not count)."""
    slabs = _Slabs.of(s, shape, shapes)
    slab = slabs.where(shape[own], y)
    total = np.zeros(len(own), np.int64)
    for row, entry in _spread(np.searchsorted(slabs.slab, slab), np.searchsorted(slabs.slab, slab, "right")):
        seg = slabs.item[entry]
        spans = (s[seg, 1] < y[row]) & (s[seg, 3] > y[row]) & (seg != own[row])
        row, seg = row[spans], seg[spans]
        at = s[seg, 0] + (y[row] - s[seg, 1]) * ((s[seg, 2] - s[seg, 0]) / (s[seg, 3] - s[seg, 1]))
        beyond = at > x[row]
        np.add.at(total, row[beyond], net[seg[beyond]])
    return total


def _outline(s: np.ndarray, shape: np.ndarray, net: np.ndarray, shapes: int) -> tuple[np.ndarray, np.ndarray]:
    """Directed pieces with positive winding on their left and none on their right."""
    flat = s[:, 1] == s[:, 3]
    every = np.arange(len(s))
    y = np.floor((s[:, 1] + s[:, 3]) / 2) + 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(flat, (s[:, 0] + s[:, 2]) / 2, s[:, 0] + (y - s[:, 1]) * ((s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])))
    one = _winding(s, shape, net, shapes, every, x, y)  # right of a rising piece, above a flat one
    under = np.zeros(len(s), np.int64)
    under[flat] = _winding(s, shape, net, shapes, every[flat], x[flat], s[flat, 1] - 0.5)
    left, right = np.where(flat, one, one + net), np.where(flat, under, one)
    kept = (left > 0) != (right > 0)
    out = np.where((left > 0)[:, None], s, s[:, [2, 3, 0, 1]])
    return out[kept], shape[kept]


def _rings(s: np.ndarray, shape: np.ndarray) -> tuple[list[np.ndarray], list[int], set[int]]:
    """Closed rings of directed pieces, their shapes, and shapes whose pieces do not close."""
    ends = np.concatenate([s[:, :2], s[:, 2:]])
    of = np.concatenate([shape, shape])
    order = np.lexsort((ends[:, 1], ends[:, 0], of))
    new = np.append(True, (ends[order][1:] != ends[order][:-1]).any(1) | (of[order][1:] != of[order][:-1]))
    vertex = np.empty(len(ends), np.int64)
    vertex[order] = np.cumsum(new) - 1
    tail, head = vertex[: len(s)], vertex[len(s) :]
    n = int(vertex.max(initial=-1)) + 1
    uneven = np.bincount(tail, minlength=n) != np.bincount(head, minlength=n)
    broken = set(shape[uneven[tail]].tolist()) | set(shape[uneven[head]].tolist())
    angle = np.arctan2(s[:, 3] - s[:, 1], s[:, 2] - s[:, 0])
    leaving = np.lexsort((angle, tail))
    start = np.searchsorted(tail[leaving], np.arange(n + 1))
    follower = np.full(len(s), -1)
    only = (start[head + 1] - start[head]) == 1
    follower[only] = leaving[start[head[only]]]
    for e in np.flatnonzero(~only).tolist():
        choice = leaving[start[head[e]] : start[head[e] + 1]]
        if len(choice):  # the next piece clockwise from the way back
            back = np.arctan2(s[e, 1] - s[e, 3], s[e, 0] - s[e, 2])
            follower[e] = choice[np.argmin((back - angle[choice]) % (2 * np.pi) + np.where(angle[choice] == back, 2 * np.pi, 0))]
    rings, owners, seen = [], [], np.zeros(len(s), bool)
    following = follower.tolist()
    for e in range(len(s)):
        if seen[e] or int(shape[e]) in broken:
            continue
        path = []
        while e >= 0 and not seen[e]:
            seen[e] = True
            path.append(e)
            e = following[e]
        if e != path[0]:
            broken.add(int(shape[path[0]]))
            continue
        rings.append(s[path, :2])
        owners.append(int(shape[path[0]]))
    return rings, owners, broken


def _signed_area(ring: np.ndarray) -> float:
    x, y = (ring - ring[0]).T
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    x1, y1 = ring.T
    x2, y2 = np.roll(x1, -1), np.roll(y1, -1)
    spans = (y1 > y) != (y2 > y)
    at = x1[spans] + (y - y1[spans]) * (x2[spans] - x1[spans]) / (y2[spans] - y1[spans])
    return bool((at > x).sum() % 2)


def _polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outlines with the holes that lie in them; slivers of a few grid steps go."""
    sized = []
    for ring in rings:
        around = float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum())
        area = _signed_area(ring)
        if abs(area) > 2 * around:
            sized.append((area, ring))
    outer = sorted((a, i) for i, (a, _) in enumerate(sized) if a > 0)
    parts = {i: [sized[i][1]] for _, i in outer}
    for area, ring in sized:
        if area < 0:
            a, b = ring[0], ring[1 % len(ring)]
            way = (b - a) / max(np.hypot(*(b - a)), 1e-300)
            x, y = (a + b) / 2 + 0.5 * np.array([way[1], -way[0]])
            home = next((i for _, i in outer if _holds(sized[i][1], x, y)), None)
            if home is not None:
                parts[home].append(ring)
    return list(parts.values())


def buffers(shapes: list[list[tuple[np.ndarray, bool, bool]]], distance: np.ndarray, steps: int) -> list[list[list[np.ndarray]] | None]:
    """Buffer of each shape, given as rings (points, whether it bounds an area, whether it is a hole).

    A buffer is a list of polygons, each a list of closed rings, outline first. None marks a shape
    whose outline could not be closed.
    """
    out: list[list[list[np.ndarray]] | None] = [None] * len(shapes)
    todo = [i for i, rings in enumerate(shapes) if rings]
    for angle in _ANGLES:
        if not todo:
            break
        turn = np.array([[np.cos(angle), np.sin(angle)], [-np.sin(angle), np.cos(angle)]])
        walks = [[_walk(points, area, hole) for points, area, hole in shapes[i]] for i in todo]
        flat = [w for own in walks for w in own]
        sizes = np.array([len(w) for w in flat])
        owner = np.repeat(np.arange(len(todo)), [len(own) for own in walks])
        origin = np.stack([np.concatenate(own).min(0) for own in walks])
        corners = (np.concatenate(flat) - np.repeat(origin[owner], sizes, 0)) @ turn
        raw, of = _raw_curve(corners, sizes, owner, distance[todo], steps)
        s, of, net = _arranged(np.round(raw / STEP), of, len(todo))
        rings, whose, broken = _rings(*_outline(s, of, net, len(todo)))
        by_shape: dict[int, list[np.ndarray]] = {}
        for ring, k in zip(rings, whose):
            by_shape.setdefault(k, []).append(ring)
        for k, i in enumerate(todo):
            if k not in broken:
                closed = [[np.concatenate([r, r[:1]]) * STEP @ turn.T + origin[k] for r in part] for part in _polygons(by_shape.get(k, []))]
                out[i] = closed or None
        todo = [todo[k] for k in sorted(broken)]
    return out


_NESTED = T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))


@F.pandas_udf(T.StructType([T.StructField("x", _NESTED), T.StructField("y", _NESTED)]))
def outlines(xs: pd.Series, ys: pd.Series, ends: pd.Series, rings: pd.Series, kinds: pd.Series, distance: pd.Series, steps: pd.Series) -> pd.DataFrame:
    """Buffer of each row's shape: coordinates, the end of every ring, rings per part, geometry type."""
    out_x: list = [None] * len(xs)
    out_y: list = [None] * len(xs)
    group: list[tuple[int, list]] = []
    held = 0

    def finish() -> None:
        found = buffers([shape for _, shape in group], np.array([float(distance.iloc[i]) for i, _ in group]), int(steps.iloc[0]))
        for (i, _), polygons in zip(group, found):
            if polygons:
                out_x[i] = [[r[:, 0].tolist() for r in part] for part in polygons]
                out_y[i] = [[r[:, 1].tolist() for r in part] for part in polygons]

    for i, (x, y, e, n, kind) in enumerate(zip(xs, ys, ends, rings, kinds)):
        if x is None or not len(x) or not (np.isfinite(x).all() and np.isfinite(y).all()):
            continue
        points, area = np.stack([x, y], 1).astype(float), kind.endswith("POLYGON")
        first = {int(k) for k in np.cumsum(n) - n}
        start, shape = 0, []
        for k, end in enumerate(e):
            if end > start:
                shape.append((points[start:end], area, area and k not in first))
            start = end
        group.append((i, shape))
        held += len(x)
        if held > _VERTICES:
            finish()
            group, held = [], 0
    if group:
        finish()
    return pd.DataFrame({"x": out_x, "y": out_y})
