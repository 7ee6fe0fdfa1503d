"""Buffers against sampled distances, thinning against crossings, inner points against sampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfield.spatial import measures, outline, segments, thinning, wkt


def crossings(rings, x, y):
    """Even-odd count of closed rings at points."""
    odd = np.zeros(x.shape, int)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            if y1 != y2:
                odd += ((y1 > y) != (y2 > y)) & (x1 + (y - y1) * (x2 - x1) / (y2 - y1) > x)
    return odd % 2 == 1


def distances(shape, x, y):
    best = np.full(x.shape, np.inf)
    for points, _, _ in shape:
        for (x1, y1), (x2, y2) in zip(points[:-1], points[1:]) if len(points) > 1 else [(points[0], points[0])]:
            dx, dy = x2 - x1, y2 - y1
            along = np.clip(((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy), 0, 1) if dx or dy else 0
            best = np.minimum(best, np.hypot(x - x1 - along * dx, y - y1 - along * dy))
    return np.where(crossings([p for p, area, _ in shape if area], x, y), 0, best)


def star(rng, n, cx, cy, low, high):
    angle, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(low, high, n)
    ring = np.stack([cx + r * np.cos(angle), cy + r * np.sin(angle)], 1)
    return np.concatenate([ring, ring[:1]])


def square(x, y, size):
    return np.array([[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]], float)


def many_shapes():
    rng = np.random.default_rng(5)
    found = [[(np.array([[0.0, 0.0]]), False, False)], [(square(0, 0, 100), True, False), (square(100, 0, 100), True, False)],
             [(square(0, 0, 300), True, False), (square(100, 100, 100), True, True)],  # the hole closes exactly
             [(square(0, 0, 300), True, False), (square(50, 50, 60), True, True)],  # and vanishes
             [(np.array([[0.0, 0], [100, 0], [0, 0]]), False, False)],
             [(np.array([[0.0, 0], [300, 0], [300, 300], [200, 300], [200, 100], [100, 100], [100, 300], [0, 300], [0, 0]])[::-1], True, False)]]
    for _ in range(12):
        found.append([(star(rng, rng.integers(3, 40), 0, 0, 100, 400), True, False)])
        found.append([(star(rng, 20, 0, 0, 300, 400), True, False), (star(rng, 12, 0, 0, 20, 200)[:: rng.choice([-1, 1])], True, True)])
        found.append([(rng.uniform(-300, 300, (rng.integers(2, 30), 2)), False, False)])
        found.append([(star(rng, 9, -150, 0, 100, 200), True, False), (star(rng, 9, 150, 20, 100, 200), True, False), (rng.uniform(-300, 300, (5, 2)), False, False)])
    return found


def test_buffers_hold_the_points_within_the_distance():
    shapes_ = many_shapes()
    found = outline.buffers(shapes_, np.full(len(shapes_), 50.0), 8)
    x, y = np.meshgrid(np.linspace(-480, 480, 121) + 0.137, np.linspace(-480, 480, 121) + 0.0713)
    for shape, polygons in zip(shapes_, found):
        gap, inside = distances(shape, x, y), crossings([r for part in polygons for r in part], x, y)
        assert not ((gap < 50 * np.cos(np.pi / 32) - 0.01) & ~inside).any() and not ((gap > 50.001) & inside).any()
        assert sum(outline._signed_area(part[0]) > 0 for part in polygons) == len(polygons)
        assert all(outline._signed_area(hole) < 0 for part in polygons for hole in part[1:])


@pytest.mark.parametrize("text, parts, holes", [
    ("POLYGON ((37 55, 37.02 55, 37.02 55.02, 37.01 55.005, 37 55))", 1, 0),
    ("POLYGON ((37 55, 37.02 55, 37.02 55.02, 37 55.02, 37 55), (37.005 55.005, 37.015 55.005, 37.015 55.015, 37.005 55.015, 37.005 55.005))", 1, 1),
    ("MULTIPOLYGON (((37 55, 37.01 55, 37.01 55.01, 37 55)), ((37.05 55, 37.06 55, 37.06 55.01, 37.05 55)))", 2, 0),
    ("MULTIPOINT (37 55, 37.001 55)", 1, 0), ("LINESTRING (37 55, 37.01 55, 37.01 55.01, 37 55.01, 37 55.0005)", 1, 1)])
def test_buffers_as_text(spark, text, parts, holes):
    df = wkt.with_geometry(spark.createDataFrame([(text,), (None,), ("POINT EMPTY",)], "wkt string"), "wkt")
    rows = {r["wkt"]: r for r in measures.buffer_metres(df, 100.0).select("*", wkt.parse_wkt(F.col("buffer")).alias("b")).collect()}
    assert rows[None]["buffer"] is None and not rows["POINT EMPTY"]["buffer_supported"]
    found = rows[text]["b"]["parts"]
    assert len(found) == parts and sum(len(p) - 1 for p in found) == holes
    grown = measures.area_km2(wkt.with_geometry(spark.createDataFrame([(rows[text]["buffer"],)], "wkt string"), "wkt")).first()["area_km2"]
    # sampled in metres around the shape
    rng = np.random.default_rng(1)
    flat = df.where("wkt LIKE '%37%'").select(measures.project(F.col("geom"), F.lit(39.0)).alias("g")).first()["g"]
    shape = [(np.array([(p["x"], p["y"]) for p in ring]), "POLYGON" in text, k > 0) for part in flat["parts"] for k, ring in enumerate(part)]
    low, high = (np.concatenate([s[0] for s in shape]).min(0) - 120, np.concatenate([s[0] for s in shape]).max(0) + 120)
    x, y = rng.uniform(low[0], high[0], 200_000), rng.uniform(low[1], high[1], 200_000)
    sampled = (distances(shape, x, y) <= 100).mean() * np.prod(high - low) / 1e6
    assert grown == pytest.approx(sampled, rel=0.015)


def meets(rings, closed):
    """Pairs of segments that touch although they are not neighbours of a ring."""
    pieces = [(k, i, len(r) - 1, r[i], r[i + 1]) for k, r in enumerate(rings) for i in range(len(r) - 1)]
    bad = 0
    for a, (ka, ia, n, p, q) in enumerate(pieces):
        for kb, ib, _, u, v in pieces[a + 1 :]:
            if ka == kb and (ib - ia == 1 or (closed and ib - ia == n - 1)):
                continue
            bad += bool(segments.segments_meet(np.array([[[*p, *q]]]), np.array([[[*u, *v]]]))[0])
    return bad


def wavy(n, r, wave, begin):
    t = begin + np.linspace(0, 2 * np.pi, n)
    radius = r + wave * np.sin(14 * t)
    ring = np.stack([radius * np.cos(t), radius * np.sin(t)], 1)
    ring[-1] = ring[0]
    return ring


def test_rings_thinned_together_do_not_cross():
    rings = [wavy(170, 1.0, 0.03, 0.0), wavy(170, 0.96, 0.03, 0.3), wavy(170, 0.92, 0.03, 0.6)]
    assert not meets(rings, True)
    apart = [r[thinning.kept_corners([r], True, 0.08)[0]] for r in rings]
    together = [r[k] for r, k in zip(rings, thinning.kept_corners(rings, True, 0.08))]
    assert meets(apart, True) and not meets(together, True)
    assert sum(map(len, together)) < 0.75 * sum(map(len, rings))
    for ring, thin in zip(rings, together):
        assert (thin[0] == thin[-1]).all()
        gap = distances([(thin, False, False)], *ring.T)
        assert gap.max() <= 0.08 + 1e-9


def test_small_rings_do_not_fall_out():
    outline_ = np.array([[0, 0], [1, 0], [1, 1], [0.5, 1.05], [0, 1], [0, 0]], float)
    hole = np.array([[0.45, 1.01], [0.55, 1.01], [0.5, 1.03], [0.45, 1.01]])
    alone, = thinning.kept_corners([outline_], True, 0.1)
    both = thinning.kept_corners([outline_, hole], True, 0.1)
    assert alone.tolist() == [0, 1, 2, 4, 5] and both[0].tolist() == [0, 1, 2, 3, 4, 5] and both[1].tolist() == [0, 1, 2, 3]
    line = np.array([[0, 0], [1, 0.01], [2, 0]], float)
    assert thinning.kept_corners([line], False, 0.1)[0].tolist() == [0, 2]
    assert [k.tolist() for k in thinning.kept_corners([line, np.array([[1, 0.005], [1, 1]])], False, 0.1)] == [[0, 1, 2], [0, 1]]
    assert thinning.kept_corners([np.zeros((0, 2))], True, 1.0)[0].tolist() == []


def test_inner_points_are_as_far_inside_as_any():
    rng = np.random.default_rng(2)
    for _ in range(20):
        rings = [star(rng, 15, 0, 0, 2, 6)]
        if rng.random() < 0.5:
            rings.append(star(rng, 5, 0, 0, 0.2, 0.8))
        x, y, gap = thinning.inner_point(rings)
        gx, gy = rng.uniform(-6, 6, 4000), rng.uniform(-6, 6, 4000)
        shape = [(r, False, False) for r in rings]
        inside = crossings(rings, gx, gy)
        assert crossings(rings, np.array([x]), np.array([y]))[0] and gap == pytest.approx(distances(shape, np.array([x]), np.array([y]))[0])
        assert gap >= distances(shape, gx, gy)[inside].max(initial=0) - 1e-4
    assert thinning.inner_point([np.array([[0, 0], [1, 0], [2, 0], [0, 0]], float)]) is None


def test_inner_label_of_parts_and_other_shapes(spark):
    texts = ["MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 0, 9 0, 9 4, 5 4, 5 0)))", "POINT (1 1)", None, "POLYGON EMPTY"]
    df = wkt.with_geometry(spark.createDataFrame([(t,) for t in texts], "wkt string"), "wkt")
    got = {r["wkt"]: r["label"] for r in measures.inner_label_point(df).collect()}
    assert (got[texts[0]]["x"], got[texts[0]]["y"], got[texts[0]]["gap"]) == pytest.approx((7, 2, 2), abs=1e-4)
    assert got[texts[1]] is None and got[None] is None and got[texts[3]] is None
