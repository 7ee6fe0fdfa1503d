import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkfield.plans.catalog import QUERIES
from larkfield.sinks import features
from larkfield.spatial import grid as g, segments
from larkfield.spatial import measures, projection, shapes, wkt

GRID = g.Grid(0.0, 0.0, 8.0, 4.0, 16, 8)


def boxes(n, seed, spot=0.0):
    """Random and edge-aligned boxes; a share of them at one spot."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if rng.random() < spot:
            out.append((i, 3.1, 1.1, 3.2, 1.2))
            continue
        x, y = rng.randrange(-8, 72) / 8, rng.randrange(-8, 40) / 8
        out.append((i, x, y, x + rng.choice([0, 0.125, 0.5, 3]), y + rng.choice([0, 0.25, 1])))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, xmin double, ymin double, xmax double, ymax double").repartition(3)


def meet(a, b):
    return a[1] <= b[3] and a[3] >= b[1] and a[2] <= b[4] and a[4] >= b[2]


def test_cells_equal_brute_force(spark):
    rows = boxes(500, 2)
    got = {(r["id"], r["cell_id"]) for r in g.with_cells(frame(spark, rows), GRID).collect()}
    wanted = set()
    for r in rows:
        for c in range(16 * 8):
            x, y = c % 16 * 0.5, c // 16 * 0.5
            if meet(r, (0, x, y, x + 0.5, y + 0.5)):
                wanted.add((r[0], c))
    assert got == wanted


def in_grid(r):
    return meet(r, (0, 0.0, 0.0, 8.0, 4.0))


@pytest.mark.parametrize("options", [{}, {"crowded_pairs": 200}, {"crowded_pairs": 200, "salt_rows": 20}, {"salt_rows": 10}])
def test_box_join_equals_all_pairs(spark, options):
    a, b = boxes(400, 3, 0.34), boxes(150, 4, 0.34)
    far = [(9000 + i, 20.0 + i % 3, 9.0, 21.5 + i % 3, 9.5) for i in range(6)]  # outside the grid
    a, b = a + far, b + far
    everywhere = sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
    got = g.box_join(frame(spark, a), frame(spark, b), GRID, "id", "id", **options).select("a_id", "b_id")
    assert sorted(map(tuple, got.collect())) == everywhere
    if not options:
        wanted = sorted((p[0], q[0]) for p in a for q in b if meet(p, q) and in_grid(p) and in_grid(q))
        per_cell = g.box_join(frame(spark, a), frame(spark, b), GRID, "id", "id", dedupe=False)
        assert sorted(map(tuple, per_cell.select("a_id", "b_id").distinct().collect())) == wanted
        assert per_cell.count() == per_cell.distinct().count() > len(wanted)


@pytest.mark.parametrize("options", [{}, {"crowded_pairs": 200}, {"crowded_pairs": 200, "salt_rows": 20}, {"salt_rows": 10}])
def test_boxes_of_one_size_go_to_one_cell(spark, monkeypatch, options):
    rng = random.Random(12)
    a = [(i, x, y, x + 0.3, y + rng.choice([0.1, 0.2])) for i in range(400)
         for x, y in [(rng.choice([rng.uniform(-2, 10), rng.randrange(-8, 72) / 8, 3.1]), rng.choice([rng.uniform(-1, 6), rng.randrange(-8, 40) / 8, 1.1]))]]
    b = boxes(150, 4, 0.34) + [(9000 + i, p[1] + 0.3, p[2] - 0.1, p[1] + 0.3, p[2]) for i, p in enumerate(a[:40])]  # touch at a corner
    placed = []
    join = g.salted_join
    monkeypatch.setattr(g, "salted_join", lambda left, right, *rest, **more: placed.append(left.count()) or join(left, right, *rest, **more))
    got = g.box_join(frame(spark, a), frame(spark, b), GRID, "id", "id", **options).select("a_id", "b_id")
    assert sorted(map(tuple, got.collect())) == sorted((p[0], q[0]) for p in a for q in b if meet(p, q))
    assert placed == [len(a)]


def test_boxes_of_unequal_or_unknown_size_have_no_reach(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (2, 1.0, 1.0, 2.5, 2.0), (3, None, 1.0, 2.0, 2.0)]
    assert g._reach(frame(spark, rows), g.BOX) == (1.5, 1.0)
    for odd in [(4, 0.0, 0.0, 50.0, 1.0), (4, 2.0, 0.0, 1.0, 1.0), (4, 0.0, 0.0, float("inf"), 1.0), (4, 0.0, 0.0, float("nan"), 1.0)]:
        assert g._reach(frame(spark, [*rows, odd]), g.BOX) is None
    assert g._reach(frame(spark, []), g.BOX) is None


def test_corner_mode_misses_crossing_bars(spark):
    a, b = [F.lit(v) for v in (0.0, 1.0, 3.0, 2.0)], [F.lit(v) for v in (1.0, 0.0, 2.0, 3.0)]
    row = spark.range(1).select(g.rect_intersects(a, b).alias("o"), g.rect_intersects(a, b, "corner").alias("c")).first()
    assert (row["o"], row["c"]) == (True, False)


GOOD = {
    "POINT (1 2)": "POINT (1 2)",
    "point(1.5 -2e0)": "POINT (1.5 -2)",
    "MULTIPOINT (1 2, 3 4)": "MULTIPOINT ((1 2), (3 4))",
    "LINESTRING (0 0,1 1 , 2 0)": "LINESTRING (0 0, 1 1, 2 0)",
    "MULTILINESTRING((0 0,1 1),(2 2,3 3))": "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))",
    "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))": "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 6, 7 6, 7 6.5, 6 6)))":
        "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5), (6 6, 7 6, 7 6.5, 6 6)))",
}
BAD = ["", "POINT", "POINT (1)", "POINT (1 x)", "CIRCLE (1 2)", "LINESTRING (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 1))",
       "POLYGON ((0 0, 1 0, 0 0))", "POINT (1 2 3 4)", "POINT (1 2, 3 4)"]


def geoms(spark, texts, schema="wkt string"):
    return wkt.with_geometry(spark.createDataFrame([(t,) for t in texts], schema), "wkt")


def test_wkt_round_trip_and_bad_text(spark):
    rows = geoms(spark, list(GOOD)).select("wkt", wkt.to_wkt(F.col("geom")).alias("t")).collect()
    assert {r["wkt"]: r["t"] for r in rows} == GOOD
    assert [(r["geom"], r["is_bad"]) for r in geoms(spark, BAD).collect()] == [(None, True)] * len(BAD)
    assert geoms(spark, [None]).first()["is_bad"] is False


def test_area_centroid_label(spark):
    out = geoms(spark, list(GOOD)).select("wkt", measures.planar_area(F.col("geom")).alias("a"), measures.centroid(F.col("geom")).alias("c"),
                                          measures.label_point(F.col("geom")).alias("l")).collect()
    got = {r["wkt"]: r for r in out}
    holed = got["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))"]
    assert holed["a"] == pytest.approx(15.5)
    assert holed["c"]["x"] == pytest.approx((16 * 2 - 0.5 * 5 / 3) / 15.5)
    assert holed["c"]["y"] == pytest.approx((16 * 2 - 0.5 * 4 / 3) / 15.5)
    assert got["POINT (1 2)"]["a"] == 0.0 and tuple(got["POINT (1 2)"]["c"]) == (1.0, 2.0)
    two = got[list(GOOD)[-1]]
    assert two["a"] == pytest.approx(0.5 + 8 - 0.25) and two["l"]["x"] > 6


def cell_area(lon, lat, size):
    """Ellipsoidal area in km2 of a cell bounded by meridians and parallels."""
    e = math.sqrt(projection.E2)
    def q(phi):
        s = math.sin(phi)
        return s / (1 - e * e * s * s) + math.atanh(e * s) / e
    b2 = projection.SEMI_MAJOR ** 2 * (1 - projection.E2)
    lo, hi = math.radians(lat), math.radians(lat + size)
    return b2 * math.radians(size) * (q(hi) - q(lo)) / 2 / 1e6


@pytest.mark.parametrize("lon, lat", [(37.5, 55.7), (60.6, 56.8), (-70.2, -33.5), (9.0, 0.1)])
def test_area_against_the_ellipsoid(spark, lon, lat):
    s = 0.01
    ring = f"{lon} {lat}, {lon + s} {lat}, {lon + s} {lat + s}, {lon} {lat + s}, {lon} {lat}"
    row = measures.area_km2(geoms(spark, [f"POLYGON (({ring}))"])).first()
    central = 6 * math.floor(lon / 6) + 3
    scale = 0.9996 * (1 + (math.radians(lon + s / 2 - central) * math.cos(math.radians(lat))) ** 2 / 2)
    assert row["area_km2"] == pytest.approx(cell_area(lon, lat, s) * scale ** 2, rel=2e-5)


def test_centroid_on_a_zone_bound_matches_two_zones(spark):
    df = geoms(spark, ["POINT (36 50)", "POINT (37 50)"])
    assert sorted((r["wkt"], r["zone"]) for r in measures.with_zone(df).collect()) == [("POINT (36 50)", 37), ("POINT (37 50)", 37)]
    rows = measures.with_zone(df, inclusive=True).collect()
    assert sorted((r["wkt"], r["zone"]) for r in rows) == [("POINT (36 50)", 36), ("POINT (36 50)", 37), ("POINT (37 50)", 37)]


def test_projection_round_trip_below_a_millimetre(spark):
    rng = random.Random(7)
    texts = [f"POINT ({39 + rng.uniform(-3, 3)} {rng.uniform(-79, 79)})" for _ in range(200)]
    df = geoms(spark, texts)
    back = projection.unproject(projection.project(F.col("geom"), F.lit(39.0)), F.lit(39.0))
    for r in df.select(wkt.all_points(F.col("geom")).alias("p"), wkt.all_points(back).alias("q")).collect():
        (p,), (q,) = r["p"], r["q"]
        metres = math.hypot((p["x"] - q["x"]) * math.cos(math.radians(p["y"])), p["y"] - q["y"]) * 111_000
        assert metres < 0.001


def test_buffer(spark):
    square = "POLYGON ((37 55, 37.01 55, 37.01 55.01, 37 55.01, 37 55))"
    bent = "POLYGON ((37 55, 37.02 55, 37.02 55.02, 37.01 55.005, 37 55))"
    out = {r["wkt"]: r for r in measures.buffer_metres(geoms(spark, [square, bent, "POINT (37 55)", "LINESTRING (37 55, 37.1 55)"]), 100.0).collect()}
    assert out[bent]["buffer"].startswith("POLYGON") and all(r["buffer_supported"] for r in out.values())
    sized = lambda t: measures.area_km2(geoms(spark, [t])).first()["area_km2"]
    assert sized(out["POINT (37 55)"]["buffer"]) == pytest.approx(math.pi * 0.01, rel=0.01)
    width, height = 0.6396, 1.1134
    assert sized(out[square]["buffer"]) - sized(square) == pytest.approx(2 * (width + height) * 0.1 + math.pi * 0.01, rel=0.01)


def test_within_metres(spark):
    df = geoms(spark, ["POLYGON ((37 55, 37.01 55, 37.01 55.01, 37 55.01, 37 55))"] * 3)
    df = df.withColumn("lat", F.lit(55.005)).withColumn("lon", F.explode(F.array(F.lit(37.005), F.lit(37.011), F.lit(37.012))))
    got = {r["lon"]: r["is_near"] for r in measures.within_metres(df, 100.0, "lon", "lat").collect()}
    assert got == {37.005: True, 37.011: True, 37.012: False}


def test_exact_intersects(spark):
    square = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
    cases = {"POINT (0.5 0.5)": True, "POINT (2 2)": False, "POINT (4 2)": True, "LINESTRING (-1 5, 5 5)": False,
             "LINESTRING (-1 2, 5 2)": True, "POLYGON ((1.5 1.5, 2 1.5, 2 2, 1.5 1.5))": False,
             "POLYGON ((-9 -9, 9 -9, 9 9, -9 9, -9 -9))": True, "MULTIPOINT (9 9, 0.5 3.5)": True,
             "POLYGON ((3.5 3.5, 9 9, 9 3.5, 3.5 3.5))": True, "POLYGON ((4.1 4.1, 9 9, 9 4, 4.1 4.1))": False}
    a = geoms(spark, list(cases)).withColumn("id", F.col("wkt"))
    b = geoms(spark, [square]).withColumn("id", F.lit("sq"))
    got = shapes.geometry_join(a, b, g.Grid(-10, -10, 10, 10, 5, 5), "id", "id").select("a_id").collect()
    assert sorted(r["a_id"] for r in got) == sorted(k for k, v in cases.items() if v)


def test_simplify(spark):
    n = 400
    ring = [(math.cos(t), math.sin(t)) for t in np.linspace(0, 2 * math.pi, n)]
    ring[-1] = ring[0]
    text = "POLYGON ((" + ", ".join(f"{x:.9f} {y:.9f}" for x, y in ring) + "), (0 0, 0.0001 0, 0 0.0001, 0 0))"
    df = geoms(spark, [text, "LINESTRING (0 0, 1 0.00001, 2 0)"])
    out = shapes.simplify(df, "geom", 0.01, "s").select(wkt.to_wkt(F.col("s")).alias("t"), "s").collect()
    outline, hole = out[0]["s"]["parts"][0]
    assert 10 < len(outline) < 60 and len(hole) == 4 and outline[0] == outline[-1]
    assert out[1]["t"] == "LINESTRING (0 0, 2 0)"
    bounded = shapes.simplify_long_text(df, "geom", 1000, 0.01).collect()
    assert len(bounded[0]["poly"]) < 1000 and bounded[1]["poly"] == "LINESTRING (0 0, 1 0.00001, 2 0)"


def test_placemarks(spark):
    rows = [("a", 5, "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))", "x<y"), ("b", 6, "POINT (1 2)", "n"),
            ("c", 7, "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 9 5, 9 9, 5 5)))", None), ("d", 8, "oops", "n")]
    df = spark.createDataFrame(rows, "name string, n int, wkt string, note string")
    good, bad = features.placemarks(df, "polygons", "wkt", "name", excluded=["n"], altitude=3, with_box=True)
    got = {r["name"]: r["value"] for r in good.collect()}
    assert sorted(got) == ["a", "c"] and sorted(r["name"] for r in bad.collect()) == ["b", "d"]
    assert "<innerBoundaryIs><LinearRing><coordinates>1,0.5,3 2,0.5,3 2,1,3 1,0.5,3" in got["a"]
    assert "<description>note: x&lt;y</description>" in got["a"] and "<north>4</north>" in got["a"]
    assert got["c"].count("<Polygon>") == 2 and "<MultiGeometry>" in got["c"] and "note: None" in got["c"]
    assert features.description_columns(["a", "g", "b"], "g", "a", "all", ["b"]) == []


def test_geojson(spark):
    import json

    df = geoms(spark, list(GOOD) + ["bad"]).withColumn("n", F.lit(None).cast("int"))
    rows = [json.loads(r["value"]) for r in features.geojson_features(df, "geom", ["wkt", "n"]).collect()]
    shapes_by_text = {r["properties"]["wkt"]: r["geometry"] for r in rows}
    assert shapes_by_text["bad"] is None
    assert shapes_by_text["MULTIPOINT (1 2, 3 4)"] == {"type": "MultiPoint", "coordinates": [[1, 2], [3, 4]]}
    assert shapes_by_text["MULTILINESTRING((0 0,1 1),(2 2,3 3))"]["coordinates"] == [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]
    assert len(shapes_by_text[list(GOOD)[-1]]["coordinates"]) == 2 and rows[0]["properties"]["n"] is None


def test_geometry_text_over_lines_with_marks_or_empty(spark):
    texts = ["POLYGON ((0 0, 1 0,\n 1 1, 0 0))", "POINT Z (1 2 3)", "pointz(1 2 3)", "POLYGON EMPTY", "MULTIPOINT\nEMPTY", "LINESTRING M (0 0 5, 1 1 6)"]
    rows = wkt.with_geometry(spark.createDataFrame([(t,) for t in texts], "wkt string"), "wkt").collect()
    assert not any(r["is_bad"] for r in rows)
    assert [len(r["geom"]["parts"]) for r in rows] == [1, 1, 1, 0, 0, 1]
    back = wkt.with_geometry(spark.createDataFrame([(t,) for t in texts], "wkt string"), "wkt").select(wkt.to_wkt(F.col("geom")).alias("t"))
    assert [r["t"] for r in back.collect()][1:5] == ["POINT (1 2)", "POINT (1 2)", "POLYGON EMPTY", "MULTIPOINT EMPTY"]


def test_geometry_text_keeps_all_digits(spark):
    rows = wkt.with_geometry(spark.createDataFrame([("POINT (0.1234567890123 1e-10)",)], "wkt string"), "wkt")
    point = rows.select(wkt.parse_wkt(wkt.to_wkt(F.col("geom")))["parts"].alias("p")).first()["p"][0][0][0]
    assert (point["x"], point["y"]) == (0.1234567890123, 1e-10)


def test_every_geometry_has_one_area(spark):
    texts = [None, "POLYGON ((5 50, 7 50, 7 51, 5 51, 5 50))", "POLYGON ((179 0, 180 0, 180 1, 179 1, 179 0))", "POLYGON EMPTY"]
    df = wkt.with_geometry(spark.createDataFrame(list(enumerate(texts)), "id int, wkt string"), "wkt")
    got = {r["id"]: r["area_km2"] for r in measures.area_km2(df).collect()}
    assert len(got) == 4 and got[0] is None and got[1] > 1000 and got[2] > 1000
    assert sorted(r["id"] for r in measures.area_km2(df, inclusive=True).collect()) == [1, 1, 2]


@pytest.mark.parametrize("shift, meets", [(0.0, True), (1.5, True), (2.5, False)])
def test_pairs_of_many_points_in_bounded_arrays(monkeypatch, shift, meets):
    """Two outlines of 10,000 points: no array passes the bound."""
    angle = np.linspace(0, 2 * np.pi, 10_001)
    ring = np.stack([np.cos(angle), np.sin(angle)], 1)
    ring[-1] = ring[0]
    pieces = np.concatenate([ring[:-1], ring[1:]], 1)
    other = pieces * (0.5 if shift == 0 else 1.0) + np.array([shift, 0, shift, 0])
    cells = []
    plain = segments.segments_meet
    monkeypatch.setattr(segments, "segments_meet", lambda a, b: cells.append(a.shape[1] * b.shape[1]) or plain(a, b))
    assert segments.meet_large(pieces, True, other, True) is meets
    assert max(cells, default=0) <= segments.CHUNK


def _random_shapes(rng, n, spread):
    """Boxes, triangles, lines, points, rings and a few large or outlying shapes as text."""
    out = []
    for _ in range(n):
        x, y = rng.uniform(-spread, spread, 2)
        w, h = rng.uniform(0.05, 1.5, 2) * (8 if rng.random() < 0.05 else 1)
        kind = rng.integers(0, 6)
        box = f"({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y})"
        hole = f"({x + w / 4} {y + h / 4}, {x + w / 2} {y + h / 4}, {x + w / 2} {y + h / 2}, {x + w / 4} {y + h / 4})"
        out.append([f"POLYGON ({box})", f"POLYGON (({x} {y}, {x + w} {y}, {x} {y + h}, {x} {y}))", f"LINESTRING ({x} {y}, {x + w} {y + h}, {x + w} {y})",
                    f"POINT ({x} {y})", f"POLYGON ({box}, {hole})", f"MULTIPOLYGON (({box}), (({x - w} {y}, {x - w / 2} {y}, {x - w} {y + h}, {x - w} {y})))"][kind])
    return out


@pytest.mark.parametrize("options", [{}, {"crowded_pairs": 300}, {"crowded_pairs": 20}])
def test_adaptive_cells_give_all_pairs(spark, options):
    """Against the test of all pairs; the grid covers a part of the shapes only, and equal shapes pile up."""
    rng = np.random.default_rng(7)
    texts = [_random_shapes(rng, 120, 6) + ["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"] * 30 + ["POLYGON ((-9 -9, 9 -9, 9 9, -9 9, -9 -9))", "POINT EMPTY"],
             _random_shapes(rng, 100, 6) + ["POINT (0.5 0.5)"] * 30 + ["POINT (50 50)", "POLYGON ((49 49, 51 49, 50 51, 49 49))"]]
    texts[0].append("POLYGON ((40 40, 60 40, 60 60, 40 60, 40 40))")
    frames = [spark.createDataFrame(list(enumerate(t)), "id long, wkt string") for t in texts]
    parsed = [wkt.with_geometry(f, "wkt").drop("wkt") for f in frames]
    got = sorted(map(tuple, shapes.geometry_join(*parsed, g.Grid(-3, -3, 3, 3, 4, 4), "id", "id", **options).collect()))
    sides = []
    for p in parsed:
        rows = []
        for r in p.where("size(geom.parts) > 0").collect():
            segs = [(a["x"], a["y"], b["x"], b["y"]) for part in r["geom"]["parts"] for ring in part for a, b in zip(ring[:-1] or ring, ring[1:] or ring)]
            rows.append((r["id"], np.array(segs), r["geom"]["type"].endswith("POLYGON")))
        sides.append(rows)
    want = sorted((i, j) for i, a, fa in sides[0] for j, b, fb in sides[1] if segments.meet_large(a, fa, b, fb))
    assert got == want and len(want) > 900


@pytest.mark.parametrize("limits", [{}, {"crowded_pairs": 1000, "salt_rows": 50}])
def test_pairs_per_cell_come_in_runs_of_few_right_boxes(spark, limits):
    a = spark.range(200).selectExpr("id", "1.2 + id / 1000 AS xmin", "1.2 AS ymin", "1.5 + id / 1000 AS xmax", "1.5 AS ymax")
    b = spark.range(600).selectExpr("id * 7 % 600 AS id", "1.3 - id / 2000 AS xmin", "1.1 AS ymin", "1.4 AS xmax", "1.6 AS ymax")
    rows = g.box_join(a, b, g.Grid(0.0, 0.0, 4.0, 4.0, 4, 4), "id", "id", dedupe=False, **limits).select("a_id", "b_id", "cell_id").collect()
    met = {(x, y) for x in range(200) for y in range(600)}
    assert len(rows) == len(met) and {(r.a_id, r.b_id) for r in rows} == met and {r.cell_id for r in rows} == {5}
    if not limits:
        near = [len({r.b_id for r in rows[k:k + 2000]}) for k in range(0, len(rows), 2000)]
        assert sum(near) / len(near) < 200


def test_long_routes_are_whole_lines(spark, tmp_path):
    """Routes of one, two and 1,203 stops and one without a supplier: a line each, however many stops."""
    stops = spark.range(1203).selectExpr("id AS l_orderkey", "1 AS l_suppkey", "id * 7 AS l_partkey").unionAll(
        spark.createDataFrame([(5, 2, 3), (6, 3, 4), (9, 3, 8), *[(i, None, i * i) for i in range(700)]], "l_orderkey long, l_suppkey int, l_partkey long"))
    stops.selectExpr("*", "1 AS l_linenumber", "1.0 AS l_quantity").repartition(3).write.parquet(str(tmp_path / "lineitem.parquet"))
    seen = []
    real = shapes.simplify_long_text
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(shapes, "simplify_long_text", lambda df, *args: seen.append(df) or real(df, *args))
        out = QUERIES["simplify_long_text"](spark, str(tmp_path)).collect()
    assert [tuple(r)[:4] for r in out] == [(4, True, True, True)]
    lines = {r["l_suppkey"]: [(p["x"], p["y"]) for p in r["points"]] for r in seen[0].select("l_suppkey", wkt.all_points(F.col("geom")).alias("points")).collect()}
    at = lambda order, part: (order % 64 / 64, part % 64 / 64)
    assert lines == {1: [at(i, i * 7) for i in range(1203)], 2: [at(5, 3)] * 2, 3: [at(6, 4), at(9, 8)], None: [at(i, i * i) for i in range(700)]}
