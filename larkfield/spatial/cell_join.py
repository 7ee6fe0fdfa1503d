"""Exact join of geometries inside the cells of an adaptive grid.

Boxes go to the cells of a regular grid; border cells take what lies outside, so nothing is lost. Cells
where the pairs of both sides would be too many are quartered, level by level, from counts of
their boxes, as long as boxes are small beside the cell. What stays crowded, such as equal boxes, is cut into
blocks of both sides. A task gets the shapes of its cells once each, a few cells at a time, finds the pairs of boxes
that meet, tests only those and sends them on as they are found. A pair belongs to the one cell that holds the low corner of its
boxes' overlap. A convex outline and a rectangle whose boxes meet are apart only if a slanting edge of the outline parts them;
what is too near to tell goes to the exact test, as other shapes do. If a shape covers its cell and the other has a corner
in it, the pair is proven without a test.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.session import checkpointed, small_side
from larkfield.spatial.grid import BOX, Grid
from larkfield.spatial.segments import CHUNK, holds_any, meet, meet_large, segments_meet

# The functions travel inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_CELL = ["level", "ix", "iy"]
_BLOCK = [*_CELL, "i", "j"]
#: Levels below the grid at most.
_DEEPEST = 20
#: Rows and bytes of the cells that are joined at once, and rows of one side that a block may have.
_GROUP_ROWS, _GROUP_BYTES, _BLOCK_ROWS = 20_000, 64 << 20, 200_000
#: Rows, and pairs to compare, that a task should get.
_TASK_ROWS, _TASK_PAIRS = 100_000, 500_000_000
#: Pairs of the arrays of one step, few enough for a core's own cache, and pairs of rows of a cell that is compared by itself.
_STEP, _OWN_STEP = 1 << 16, 1 << 11
#: Pairs of a batch that goes out.
_SENT = 1 << 18
#: Corners of a convex outline that is tested by its edges, and slanting edges among them.
_CORNERS, _SLANTS = 16, 8


def _span(low: Column, high: Column, origin: float, step: Column, cells: Column) -> tuple[Column, Column]:
    """First and last index of the cells that [low, high] meets, edges included; outer ones count to the border."""
    first = F.least(F.greatest(F.ceil((low - origin) / step - 1).cast("int"), F.lit(0)), cells - 1)
    last = F.greatest(F.least(F.floor((high - origin) / step).cast("int"), cells - 1), F.lit(0))
    return F.least(first, last), last


def _cells(ix: tuple[Column, Column], iy: tuple[Column, Column], level: Column) -> Column:
    return F.flatten(F.transform(F.sequence(*iy), lambda y: F.transform(
        F.sequence(*ix), lambda x: F.struct(level.alias("level"), x.alias("ix"), y.alias("iy")))))


def _placed(df: DataFrame, grid: Grid) -> DataFrame:
    """One row per grid cell that the box meets."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in BOX)
    ix = _span(xmin, xmax, grid.xmin, F.lit(grid.dx), F.lit(grid.nx))
    iy = _span(ymin, ymax, grid.ymin, F.lit(grid.dy), F.lit(grid.ny))
    return df.select("*", F.inline(_cells(ix, iy, F.lit(0))))


def _quartered(df: DataFrame, crowded: DataFrame, grid: Grid) -> DataFrame:
    """Rows of crowded cells go to the quarters that their box meets; others stay."""
    marked = df.join(crowded.select(*_CELL, F.lit(True).alias("_split")), _CELL, "left")
    level = F.col("level") + 1
    scale = F.shiftleft(F.lit(1), level)

    def within(low: Column, high: Column, origin: float, step: float, n: int, own: Column) -> tuple[Column, Column]:
        first, last = _span(low, high, origin, F.lit(step) / scale, F.lit(n) * scale)
        return F.least(F.greatest(first, own * 2), own * 2 + 1), F.greatest(F.least(last, own * 2 + 1), own * 2)

    ix = within(F.col("xmin"), F.col("xmax"), grid.xmin, grid.dx, grid.nx, F.col("ix"))
    iy = within(F.col("ymin"), F.col("ymax"), grid.ymin, grid.dy, grid.ny, F.col("iy"))
    own = F.array(F.struct(*_CELL))
    cells = F.when(F.col("_split"), _cells(ix, iy, level)).otherwise(own)
    return marked.withColumn("_cells", cells).drop(*_CELL, "_split").select("*", F.inline("_cells")).drop("_cells")


def _loads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of both sides per cell that both have, and the mean width of its boxes beside its own."""
    width = F.least(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))
    both = a.select(*_CELL, F.lit(1).alias("na"), F.lit(0).alias("nb"), width.alias("width")).unionAll(
        b.select(*_CELL, F.lit(0).alias("na"), F.lit(1).alias("nb"), width.alias("width")))
    counts = both.groupBy(*_CELL).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"), F.avg("width").alias("width"))
    return counts.where((F.col("na") > 0) & (F.col("nb") > 0))


def _blocks(loads: DataFrame, crowded_pairs: int) -> tuple[DataFrame, Column]:
    """Cells to cut into blocks, ``_pa`` times ``_pb`` of them, and the rows of both sides that a cell has in all its blocks."""
    per_block = math.sqrt(crowded_pairs)
    is_hot = (F.col("na").cast("double") * F.col("nb") > crowded_pairs) | (F.greatest("na", "nb") > _BLOCK_ROWS)
    pa, pb = (F.ceil(F.col(c) / per_block).cast("int") for c in ("na", "nb"))
    rows = F.when(is_hot, F.col("na") * pb + F.col("nb") * pa).otherwise(F.col("na") + F.col("nb"))
    return loads.where(is_hot).select(*_CELL, pa.alias("_pa"), pb.alias("_pb")), rows


class _Shapes:
    """Segments of all shapes of one side of a group, shape after shape."""

    def __init__(self, table: pa.Table, key: str):
        table = table.combine_chunks()
        column = lambda n: table.column(n).to_numpy()
        self.ids = table.column(key)
        self.box = np.stack([column(c) for c in BOX], 1).reshape(-1, 4)
        self.cell = np.stack([column(c).astype(np.int64) for c in _CELL], 1).reshape(-1, 3)
        self.area = table.column("flat_area").to_numpy(zero_copy_only=False).astype(bool)
        lists = [table.column(c).chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float64())) for c in ("flat_x", "flat_y")]
        self.x, self.y = (v.flatten().to_numpy() for v in lists)
        points = lists[0].value_lengths().to_numpy()
        self.point_start = np.cumsum(points) - points
        rings = table.column("flat_ends").combine_chunks()
        rings = rings.chunk(0) if isinstance(rings, pa.ChunkedArray) else rings
        per_shape = rings.value_lengths().to_numpy()
        ends = rings.flatten().to_numpy().astype(np.int64) + np.repeat(self.point_start, per_shape)
        begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        owner = np.repeat(np.arange(len(points)), points)
        last = np.zeros(len(self.x), bool)
        last[ends - 1] = True
        lone = np.zeros(len(self.x), bool)
        lone[begins[ends - begins == 1]] = True
        start = np.flatnonzero(~last | lone)
        stop = np.where(lone[start], start, start + 1)
        self.segments = np.stack([self.x[start], self.y[start], self.x[stop], self.y[stop]], 1)
        self.count = np.bincount(owner[start], minlength=len(points))
        self.first = np.cumsum(self.count) - self.count
        self.one_ring = per_shape == 1
        self._convex()

    def _convex(self) -> None:
        """Marks convex outlines and rectangles; ``slants`` has the normals and offsets of slanting edges, an array each."""
        n_rows = len(self.box)
        self.is_convex = np.zeros(n_rows, bool)
        slants = np.zeros((_SLANTS, 3, n_rows))
        slants[:, 2] = np.inf
        many = np.zeros(n_rows, np.int64)
        simple = self.area & self.one_ring & np.isfinite(self.box).all(1) & (self.box[:, 2] > self.box[:, 0]) & (self.box[:, 3] > self.box[:, 1])
        for n in np.unique(self.count[simple & (self.count >= 3) & (self.count <= _CORNERS)]).tolist():
            rows = np.flatnonzero(simple & (self.count == n))
            edges = self.stacked(rows, n)
            closed = (edges[:, -1, 2:] == edges[:, 0, :2]).all(1)
            rows, edges = rows[closed], edges[closed]
            dx, dy = edges[:, :, 2] - edges[:, :, 0], edges[:, :, 3] - edges[:, :, 1]
            next_x, next_y = np.roll(dx, -1, 1), np.roll(dy, -1, 1)
            cross, along = dx * next_y - dy * next_x, dx * next_x + dy * next_y
            low = self.box[rows]
            x, y = edges[:, :, 0] - low[:, 0, None], edges[:, :, 1] - low[:, 1, None]
            twice = (x * np.roll(y, -1, 1) - y * np.roll(x, -1, 1)).sum(1)
            turns = np.where(twice[:, None] > 0, cross, -cross)
            # one way round, once, and no flat shape
            good = (turns >= 0).all(1) & ((turns > 0) | (along > 0)).all(1) & (np.abs(np.arctan2(turns, along).sum(1) - 2 * np.pi) < 1)
            good &= np.abs(twice) > 1e-9 * (low[:, 2] - low[:, 0]) * (low[:, 3] - low[:, 1])
            slanting = (dx != 0) & (dy != 0)
            good &= slanting.sum(1) <= _SLANTS
            rows, slanting = rows[good], slanting[good]
            way = np.sign(twice[good])[:, None] / np.maximum(np.hypot(dx[good], dy[good]), np.finfo(float).tiny)
            nx, ny = dy[good] * way, -dx[good] * way
            offset = nx * edges[good, :, 0] + ny * edges[good, :, 1]
            place = np.cumsum(slanting, 1) - 1
            at, edge = np.nonzero(slanting)
            for k, values in enumerate((nx, ny, offset)):
                slants[place[at, edge], k, rows[at]] = values[at, edge]
            self.is_convex[rows] = True
            many[rows] = slanting.sum(1)
        self.slants = slants[: int(many.max(initial=0))]
        self.is_rectangle = self.is_convex & (many == 0)
        self.edges = np.ascontiguousarray(self.box.T)
        self.reach = float(np.abs(self.box[self.is_convex]).max(initial=0.0))

    def of(self, row: int) -> np.ndarray:
        return self.segments[self.first[row] : self.first[row] + self.count[row]]

    def stacked(self, rows: np.ndarray, n: int) -> np.ndarray:
        return self.segments[self.first[rows][:, None] + np.arange(n)]


def _spread(start: np.ndarray, stop: np.ndarray):
    """(row, position) for every position from start to stop of every row, in bounded pieces."""
    many = np.maximum(stop - start, 0)
    total, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _STEP, "right")))
        n = many[at:to]
        row = np.repeat(np.arange(at, to), n)
        yield row, start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def _box_pairs(a: np.ndarray, b: np.ndarray, cell_a: np.ndarray, cell_b: np.ndarray):
    """Rows of the boxes a and b in one cell that meet, each pair of rows once."""
    values = np.unique(np.concatenate([a[:, 0], a[:, 2], b[:, 0], b[:, 2]]))
    wide = len(values) + 1
    key = lambda cell, v: cell * wide + np.searchsorted(values, v)
    for one, two, cell_one, cell_two, side in ((a, b, cell_a, cell_b, "left"), (b, a, cell_b, cell_a, "right")):
        order = np.argsort(key(cell_two, two[:, 0]), kind="stable")
        low = key(cell_two, two[:, 0])[order]
        # starts of two within the span of one; equal starts count for a only
        begin = np.searchsorted(low, key(cell_one, one[:, 0]), side)
        end = np.searchsorted(low, key(cell_one, one[:, 2]), "right")
        for row, place in _spread(begin, end):
            other = order[place]
            meets = (one[row, 1] <= two[other, 3]) & (two[other, 1] <= one[row, 3])
            row, other = row[meets], other[meets]
            yield (row, other) if one is a else (other, row)


def _cell_pairs(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray):
    """Rows of the boxes of one cell that meet and belong to it: some rows of a against the rows of b that can reach them."""
    by_a, by_b = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, own_a = a[by_a], own_a[by_a, None]
    xmin, ymin, xmax, ymax = np.ascontiguousarray(b[by_b].T)
    own_b, widest = own_b[by_b], float(np.fmax.reduce(xmax - xmin, initial=0.0))
    at = 0
    while at < len(a):
        # a width is rounded, so the first row is sought a little lower
        least = a[at, 0] - widest - (abs(a[at, 0]) + widest) * 1e-9
        begin = int(np.searchsorted(xmin, least, "left")) if math.isfinite(least) else 0
        to = min(len(a), at + max(1, _STEP // max(1, len(xmin) - begin)))
        end = int(np.searchsorted(xmin, a[at:to, 2].max(), "right"))
        if end > begin:
            part, some = slice(begin, end), a[at:to]
            meets = some[:, :1] <= xmax[part]
            meets &= some[:, 2:3] >= xmin[part]
            meets &= some[:, 1:2] <= ymax[part]
            meets &= some[:, 3:] >= ymin[part]
            meets &= (own_a[at:to] | own_b[part]) == 3
            found = np.flatnonzero(meets)
            starts = np.arange(to - at + 1) * (end - begin)
            many = np.diff(np.searchsorted(found, starts))
            yield np.repeat(by_a[at:to], many), by_b[found - np.repeat(starts[:-1] - begin, many)]
        at = to


def _covers(shapes: _Shapes, corners: np.ndarray) -> np.ndarray:
    """Rows whose shape covers its whole cell: no segment meets the cell, and its middle lies inside."""
    out = shapes.area & (shapes.box[:, 0] <= corners[:, 0]) & (shapes.box[:, 1] <= corners[:, 1]) & (shapes.box[:, 2] >= corners[:, 2]) & (shapes.box[:, 3] >= corners[:, 3])
    for row in np.flatnonzero(out).tolist():
        x1, y1, x2, y2 = corners[row]
        own = shapes.of(row)
        low, high = np.minimum(own[:, :2], own[:, 2:]), np.maximum(own[:, :2], own[:, 2:])
        near = own[(high[:, 0] >= x1) & (low[:, 0] <= x2) & (high[:, 1] >= y1) & (low[:, 1] <= y2)]
        edges = np.array([[x1, y1, x2, y1], [x2, y1, x2, y2], [x2, y2, x1, y2], [x1, y2, x1, y1]])
        ends_in = ((near[:, [0, 2]] >= x1) & (near[:, [0, 2]] <= x2) & (near[:, [1, 3]] >= y1) & (near[:, [1, 3]] <= y2)).any()
        middle = np.array([[[(x1 + x2) / 2, (y1 + y2) / 2] * 2]])
        out[row] = not ends_in and not (len(near) and segments_meet(near[None], edges[None])[0]) and bool(holds_any(own[None], middle)[0])
    return out


def _has_corner(shapes: _Shapes, corners: np.ndarray) -> np.ndarray:
    """Rows whose shape has a corner in its cell."""
    lead = np.append(shapes.point_start, len(shapes.x))
    owner = np.repeat(np.arange(len(shapes.box)), np.diff(lead))
    c = corners[owner]
    inside = (shapes.x >= c[:, 0]) & (shapes.x <= c[:, 2]) & (shapes.y >= c[:, 1]) & (shapes.y <= c[:, 3])
    out = np.zeros(len(shapes.box), bool)
    out[owner[inside]] = True
    return out


def _touching(a: _Shapes, b: _Shapes, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
    """The exact test of row pairs, those of equal segment counts at once."""
    out = np.zeros(len(ra), bool)
    na, nb = a.count[ra], b.count[rb]
    order = np.lexsort((nb, na))
    edges = np.flatnonzero(np.append(True, (np.diff(na[order]) != 0) | (np.diff(nb[order]) != 0))) if len(order) else []
    for begin, end in zip(edges, [*edges[1:], len(order)]):
        some = order[begin:end]
        n, m = int(na[some[0]]), int(nb[some[0]])
        if n * m > CHUNK:
            for k in some.tolist():
                out[k] = meet_large(a.of(ra[k]), a.area[ra[k]], b.of(rb[k]), b.area[rb[k]])
            continue
        step = max(1, _STEP // max(1, n * m))
        for at in range(0, len(some), step):
            k = some[at : at + step]
            out[k] = meet(a.stacked(ra[k], n), a.area[ra[k]], b.stacked(rb[k], m), b.area[rb[k]])
    return out


def _lowest(normal: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, others: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``normal`` of rows times the edge of the other's box that lies lowest along it."""
    if not (normal < 0).any():
        low.take(others, out=out, mode="clip")
    elif not (normal > 0).any():
        high.take(others, out=out, mode="clip")
    else:
        return np.where(normal[rows] < 0, high[others], low[others]) * normal[rows]
    out *= normal[rows]
    return out


def _beside(outline: _Shapes, box: _Shapes, rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Convex outlines and rectangles whose boxes meet: (they meet, they are too near to tell)."""
    apart, near = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
    doubt = 1e-11 * max(outline.reach, box.reach)
    x, y = np.empty(len(rows)), np.empty(len(rows))
    for normal_x, normal_y, offset in outline.slants:
        gap = _lowest(normal_x, box.edges[0], box.edges[2], rows, others, x)
        gap += _lowest(normal_y, box.edges[1], box.edges[3], rows, others, y)
        gap -= offset[rows]
        apart |= gap > doubt
        near |= gap >= -doubt
    near &= ~apart
    return ~(apart | near), near


def _joined(grid: Grid, left_id: str, right_id: str):
    # plain numbers: a Grid would be read back by its class, and executors need not have this package
    xmin, ymin, nx, ny, grid_dx, grid_dy = grid.xmin, grid.ymin, grid.nx, grid.ny, grid.dx, grid.dy

    def corners(cell: np.ndarray) -> np.ndarray:
        scale = np.exp2(cell[:, 0])
        dx, dy = grid_dx / scale, grid_dy / scale
        x, y = xmin + cell[:, 1] * dx, ymin + cell[:, 2] * dy
        return np.stack([x, y, x + dx, y + dy], 1)

    def owned(shapes: _Shapes) -> np.ndarray:
        """Bit 1 or 2 if the cell holds the low x or y; a pair belongs to it if one of them holds x, one y and none starts beyond."""
        scale = np.exp2(shapes.cell[:, 0])
        out, beyond = np.zeros(len(shapes.box), np.uint8), np.zeros(len(shapes.box), bool)
        for axis, origin, step, n in ((0, xmin, grid_dx, nx), (1, ymin, grid_dy, ny)):
            index = np.clip(np.floor((shapes.box[:, axis] - origin) / (step / scale)), 0, n * scale - 1)
            out |= np.where(index == shapes.cell[:, 1 + axis], np.uint8(1 << axis), np.uint8(0))
            beyond |= index > shapes.cell[:, 1 + axis]
        out[beyond] = 4
        return out

    def candidates(a: _Shapes, b: _Shapes, cell_a: np.ndarray, cell_b: np.ndarray):
        """Rows of one block whose boxes meet and that belong to its cell."""
        own = owned(a), owned(b)
        rows = [np.flatnonzero(o < 4) for o in own]
        cells = [c[r] for c, r in zip((cell_a, cell_b), rows)]
        n = int(max(cell_a[-1], cell_b[-1])) + 1
        many = [np.bincount(c, minlength=n) for c in cells]
        ends = [np.append(0, np.cumsum(m)) for m in many]
        alone = many[0] * many[1] >= _OWN_STEP
        for k in np.flatnonzero(alone).tolist():
            ra, rb = (r[e[k] : e[k + 1]] for r, e in zip(rows, ends))
            for i, j in _cell_pairs(a.box[ra], b.box[rb], own[0][ra], own[1][rb]):
                yield ra[i], rb[j]
        (ra, cell_a), (rb, cell_b) = ((r[~alone[c]], c[~alone[c]]) for r, c in zip(rows, cells))
        if len(ra) and len(rb):
            for i, j in _box_pairs(a.box[ra], b.box[rb], cell_a, cell_b):
                i, j = ra[i], rb[j]
                mine = (own[0][i] | own[1][j]) == 3
                yield i[mine], j[mine]

    def pairs(block: pa.Table):
        """Rows of both sides that share a point, a few thousand at a time."""
        keys = np.stack([block.column(c).to_numpy().astype(np.int64) for c in _BLOCK], 1)
        number = np.cumsum(np.append(0, (np.diff(keys, axis=0) != 0).any(1)))
        left = block.column("_left").to_numpy(zero_copy_only=False).astype(bool)
        if left.all() or not left.any():
            return
        a, b = _Shapes(block.filter(pa.array(left)), left_id), _Shapes(block.filter(pa.array(~left)), right_id)
        alike = a.is_convex.all() and b.is_rectangle.all()
        covered: list = []
        for ra, rb in candidates(a, b, number[left], number[~left]):
            if alike:
                hit, rest = _beside(a, b, ra, rb)
            else:
                hit, rest = np.zeros(len(ra), bool), np.ones(len(ra), bool)
                for outline, box, i, j in ((a, b, ra, rb), (b, a, rb, ra)):
                    k = np.flatnonzero(rest & outline.is_convex[i] & box.is_rectangle[j])
                    if len(k):
                        hit[k], rest[k] = _beside(outline, box, i[k], j[k])
            rest = np.flatnonzero(rest)
            if len(rest):
                if not covered:
                    box_a, box_b = corners(a.cell), corners(b.cell)
                    covered += [_covers(a, box_a), _covers(b, box_b), _has_corner(a, box_a), _has_corner(b, box_b)]
                i, j = ra[rest], rb[rest]
                known = (covered[0][i] & covered[3][j]) | (covered[1][j] & covered[2][i])
                unknown = np.flatnonzero(~known)
                known[unknown] = _touching(a, b, i[unknown], j[unknown])
                hit[rest] = known
            yield a, b, ra[hit], rb[hit]

    def sent(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, a, b = 0, None, None

        def batch() -> pa.RecordBatch:
            rows = [np.concatenate([h[k] for h in held]) for k in (0, 1)]
            return pa.record_batch({"a_id": _taken(a.ids, rows[0]), "b_id": _taken(b.ids, rows[1])})

        for a, b, ra, rb in pairs(pa.Table.from_batches(block)):
            held.append((ra, rb))
            count += len(ra)
            if count >= _SENT:
                yield batch()
                held, count = [], 0
        if count:
            yield batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come sorted by block; whole blocks are joined as soon as they are many rows or bytes."""
        held: list[pa.RecordBatch] = []
        last, rows, size = None, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            each = batch.nbytes / batch.num_rows
            keys = np.stack([batch.column(c).to_numpy() for c in _BLOCK], 1).astype(np.int64)
            before = keys[:1] if last is None else last
            begins = np.flatnonzero((np.diff(np.concatenate([before, keys]), axis=0) != 0).any(1))
            last, at = keys[-1:], 0
            for begin in begins.tolist():
                if rows + begin - at >= _GROUP_ROWS or size + (begin - at) * each >= _GROUP_BYTES:
                    yield from sent([*held, batch.slice(at, begin - at)])
                    held, rows, size, at = [], 0, 0.0, begin
            held.append(batch.slice(at))
            rows, size = rows + batch.num_rows - at, size + (batch.num_rows - at) * each
        if held:
            yield from sent(held)

    return run


def _taken(ids: pa.Array, rows: np.ndarray) -> pa.Array:
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return pa.array(ids.to_numpy()[rows], ids.type)
    return ids.take(pa.array(rows))


def exact_join(left: DataFrame, right: DataFrame, grid: Grid, left_id: str, right_id: str, crowded_pairs: int = 4_000_000,
               block_pairs: int = 100_000_000) -> DataFrame:
    """``a_id, b_id`` of shapes that share a point.

    Both sides are stored frames with an id, the box columns and the plain coordinates of ``with_flat``.
    ``crowded_pairs`` is the product of both sides' boxes from which a cell is quartered, ``block_pairs`` that from which
    it is cut into blocks. Blocks go sorted to the tasks, which send pairs on as they are found, so neither the rows
    nor the pairs of a task are ever held together.
    """
    spark = left.sparkSession
    sides = [_placed(df.withColumnRenamed(key, name), grid) for df, key, name in ((left, left_id, "a_id"), (right, right_id, "b_id"))]
    slim = [s.select(*BOX, *_CELL) for s in sides]
    product, splits = F.col("na").cast("double") * F.col("nb"), []
    loads = checkpointed(_loads(*slim))
    for level in range(_DEEPEST):
        size = min(grid.dx, grid.dy) / 2**level
        crowded = loads.where((F.col("level") == level) & (product > crowded_pairs) & (F.col("width") * 2 < size)).select(*_CELL)
        if crowded.isEmpty():
            break
        splits.append(small_side(crowded))
        slim = [_quartered(s, splits[-1], grid) for s in slim]
        loads = checkpointed(_loads(*slim))
    for split in splits:
        sides = [_quartered(s, split, grid) for s in sides]
    hot, rows = _blocks(loads, block_pairs)
    hot = small_side(hot)
    # rows repeated for blocks count, or a task would get more pairs the more its cells are crowded
    total = loads.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.coalesce(F.sum(product), F.lit(0.0)).alias("pairs")).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total["rows"]) // _TASK_ROWS, int(total["pairs"] // _TASK_PAIRS))
    kinds = [s.schema[k].dataType for s, k in zip(sides, ("a_id", "b_id"))]
    dealt = []
    for side, is_left, own, other, i, j in zip(sides, (True, False), ("_pa", "_pb"), ("_pb", "_pa"), ("i", "j"), ("j", "i")):
        cut = side.join(hot, _CELL, "left")
        mine = F.coalesce(F.pmod(F.xxhash64("a_id" if is_left else "b_id"), F.col(own)).cast("int"), F.lit(0))
        cut = cut.withColumns({i: mine, j: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))})
        ids = [F.col(k) if (k == "a_id") == is_left else F.lit(None).cast(kind).alias(k) for k, kind in zip(("a_id", "b_id"), kinds)]
        dealt.append(cut.select(*ids, F.lit(is_left).alias("_left"), *BOX, "flat_x", "flat_y", "flat_ends", "flat_area", *_BLOCK))
    blocks = dealt[0].unionAll(dealt[1]).repartition(tasks, *_BLOCK).sortWithinPartitions(*_BLOCK, "_left")
    out = T.StructType([T.StructField(k, kind) for k, kind in zip(("a_id", "b_id"), kinds)])
    return blocks.mapInArrow(_joined(grid, "a_id", "b_id"), out)
