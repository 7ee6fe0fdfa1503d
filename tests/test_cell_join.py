"""The exact join of a task, against the test of every pair of shapes."""

import numpy as np
import pyarrow as pa
import pytest

from larkfield.spatial import cell_join, grid, segments

ONE_CELL = grid.Grid(-10.0, -10.0, 10.0, 10.0, 1, 1)


def block(left, rings, cell=0, first=0):
    """Rows of one side of a cell: areas of one ring each."""
    n = len(rings)
    lists = lambda values, kind: pa.array([list(v) for v in values], pa.list_(kind))
    ids, none = pa.array(np.arange(n) + first), pa.nulls(n, pa.int64())
    bounds = {name: [f(r[:, k]) for r in rings] for name, k, f in (("xmin", 0, min), ("ymin", 1, min), ("xmax", 0, max), ("ymax", 1, max))}
    places = {"level": 0, "ix": cell, "iy": 0, "i": 0, "j": 0}
    return pa.record_batch({
        "a_id": ids if left else none, "b_id": none if left else ids, "_left": pa.array([left] * n),
        **{k: pa.array(v, pa.float64()) for k, v in bounds.items()},
        "flat_x": lists([r[:, 0] for r in rings], pa.float64()), "flat_y": lists([r[:, 1] for r in rings], pa.float64()),
        "flat_ends": lists([[len(r)] for r in rings], pa.int32()), "flat_area": pa.array([True] * n),
        **{k: pa.array([v] * n, pa.int32()) for k, v in places.items()}})


def joined(batches, where=ONE_CELL):
    return [(a, b) for out in cell_join._joined(where, "a_id", "b_id")(iter(batches)) for a, b in zip(out["a_id"].to_pylist(), out["b_id"].to_pylist())]


def closed(points):
    points = np.array(points, float)
    return np.concatenate([points, points[:1]])


def rectangles(rng, n, unit):
    low = rng.integers(-60, 60, (n, 2)) / unit
    size = rng.integers(1, 30, (n, 2)) / unit
    return [closed([(x, y), (x + w, y), (x + w, y + h), (x, y + h)][:: rng.choice([-1, 1])]) for (x, y), (w, h) in zip(low, size)]


def outlines(rng, n, unit):
    """Triangles with corners on a lattice, convex rings, and rings that only look so."""
    out = []
    for _ in range(n):
        x, y, w, h = *rng.integers(-60, 60, 2) / unit, *rng.integers(1, 30, 2) / unit
        angles = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(5, 12)))
        star = np.arange(5) * 4 * np.pi / 5
        out.append([closed([(x, y), (x + w, y), (x, y + h)]), closed([(x, y), (x, y + h), (x - w, y)]),
                    closed(np.stack([x + w * np.cos(angles), y + h * np.sin(angles)], 1)), closed(np.stack([x + w * np.cos(star), y + h * np.sin(star)], 1)),
                    closed([(x, y), (x + w, y + h), (x + w / 2, y + h / 2)]), closed([(x, y), (x + w, y), (x + w / 4, y + h / 4), (x, y + h)]),
                    closed([(x, y), (x + w, y), (x + w, y), (x, y + h)]), np.array([(x, y), (x + w, y), (x, y + h)], float),
                    closed([(x, y), (x + w, y), (x + 2 * w, y), (x, y + h)])][rng.integers(0, 9)])
    return out


@pytest.mark.parametrize("unit", [3.0, 7.3, 8.0])
@pytest.mark.parametrize("alone", [0, 1 << 30])
def test_convex_outlines_and_rectangles_equal_the_test_of_every_pair(monkeypatch, unit, alone):
    """Many touch in an edge or a corner; both ways round and both sides, in a cell by itself or with others."""
    monkeypatch.setattr(cell_join, "_OWN_STEP", alone)
    monkeypatch.setattr(cell_join, "_STEP", 1000)
    rng = np.random.default_rng(int(unit * 10))
    boxes, shapes = rectangles(rng, 90, unit), outlines(rng, 90, unit)
    pieces = lambda r: np.concatenate([r[:-1], r[1:]], 1)
    near = lambda a, b: (a.min(0) <= b.max(0)).all() and (b.min(0) <= a.max(0)).all()
    for left, right in ((shapes, boxes), (boxes, shapes), (boxes, boxes[::-1]), (shapes, shapes[::-1])):
        want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right)
                if near(a, b) and segments.meet_large(pieces(a), True, pieces(b), True)]
        got = joined([block(False, right), block(True, left)])
        assert sorted(got) == want and len(want) > 300


def test_few_pairs_of_convex_outlines_and_rectangles_need_the_exact_test(monkeypatch):
    rng = np.random.default_rng(1)
    corners = rng.uniform(-5, 5, (400, 2))
    left = [closed([(x, y), (x + 0.7, y), (x, y + 0.7)]) for x, y in corners]
    right = [closed([(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]) for x, y in rng.uniform(-5, 5, (400, 2))]
    tested, real = [], cell_join.meet
    monkeypatch.setattr(cell_join, "meet", lambda a, *rest: tested.append(len(a)) or real(a, *rest))
    assert len(joined([block(False, right), block(True, left)])) > 2000 and sum(tested) < 20


def test_a_task_holds_few_cells_and_sends_pairs_as_they_are_found(monkeypatch):
    """The rows of a cell may come in several batches, and the pairs of one cell go out in several."""
    monkeypatch.setattr(cell_join, "_OWN_STEP", 0)
    monkeypatch.setattr(cell_join, "_GROUP_ROWS", 50)
    monkeypatch.setattr(cell_join, "_SENT", 300)
    monkeypatch.setattr(cell_join, "_STEP", 100)
    where = grid.Grid(0.0, 0.0, 10.0, 1.0, 10, 1)
    at = lambda k, n: [closed([(k + 0.2, 0.2), (k + 0.6, 0.2), (k + 0.6, 0.6), (k + 0.2, 0.6)])] * n
    read = []

    def batches():
        for k in range(10):
            for batch in (block(False, at(k, 40), k, 40 * k), block(True, at(k, 30), k, 30 * k)):
                for begin in range(0, batch.num_rows, 16):
                    read.append(k)
                    yield batch.slice(begin, 16)

    sizes, ahead, pairs = [], [], set()
    for out in cell_join._joined(where, "a_id", "b_id")(batches()):
        rows = list(zip(out["a_id"].to_pylist(), out["b_id"].to_pylist()))
        sizes.append(len(rows))
        ahead.append(read[-1] - rows[0][0] // 30)
        pairs.update(rows)
    assert pairs == {(30 * k + i, 40 * k + j) for k in range(10) for i in range(30) for j in range(40)}
    assert sum(sizes) == 12_000 and max(sizes) < 600 and max(ahead) <= 2


def test_crowded_cells_are_cut_by_rows_too(spark):
    loads = spark.createDataFrame([(0, 1, 1, 1_000_000, 3), (0, 2, 1, 30, 50)], "level int, ix int, iy int, na long, nb long")
    hot, rows = cell_join._blocks(loads, 100_000_000)
    assert [tuple(r) for r in hot.collect()] == [(0, 1, 1, 100, 1)]
    assert [r[0] for r in loads.orderBy("ix").select(rows).collect()] == [1_000_300, 80]
