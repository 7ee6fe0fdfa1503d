"""Grid joins, geometry text and measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkfield.plans.registry import query
from larkfield.session import computed_once, fresh_path
from larkfield.sinks import features
from larkfield.sinks import map_document as map_documents
from larkfield.spatial import grid as g
from larkfield.spatial import measures, shapes, wkt

UNIT_GRID = g.Grid(-1.0, -1.0, 17.0, 17.0, 36, 36)
A_SQL = "a AS (SELECT o_orderkey AS id, ((o_orderkey*37)%1024)/64.0 AS x, ((o_orderkey*101)%1024)/64.0 AS y FROM orders)"
B_SQL = "b AS (SELECT p_partkey AS id, ((p_partkey*53)%1024)/64.0 AS x, ((p_partkey*29)%1024)/64.0 AS y FROM part)"


def _points(df, key, kx, ky):
    return df.select(F.col(key).alias("id"), ((F.col(key) * kx) % 1024 / 64.0).alias("x"),
                     ((F.col(key) * ky) % 1024 / 64.0).alias("y"))


def a_points(t):
    return _points(t.orders, "o_orderkey", 37, 101)


def b_points(t):
    return _points(t.part, "p_partkey", 53, 29)


CELL_SQL = f"""WITH {A_SQL}, cells AS (SELECT CAST(iy.range * 36 + ix.range AS INTEGER) AS cell_id, -1 + ix.range / 2.0 AS x0, -1 + iy.range / 2.0 AS y0 FROM range(0, 36) ix, range(0, 36) iy)
SELECT id, cell_id FROM a JOIN cells ON x - 0.375 <= x0 + 0.5 AND x + 0.375 >= x0 AND y - 0.125 <= y0 + 0.5 AND y + 0.125 >= y0"""


@query("tessellate_cells", CELL_SQL)
def tessellate_cells(t):
    """Cells met by a box around every point."""
    boxes = g.point_box(a_points(t), "x", "y", 0.375, 0.125)
    return g.with_cells(boxes, UNIT_GRID).select("id", "cell_id")


@query("point_box", f"""
WITH {B_SQL} SELECT id, x - 0.25 AS xmin, y - 0.5 AS ymin, x + 0.25 AS xmax, y + 0.5 AS ymax FROM b
""")
def point_box(t):
    return g.point_box(b_points(t), "x", "y", 0.25, 0.5).drop("x", "y")


RECT_SQL = """SELECT l_orderkey, l_partkey, l_orderkey % 16 / 2.0 AS ax, l_partkey % 16 / 2.0 AS ay, l_suppkey % 16 / 2.0 AS bx, l_linenumber / 2.0 AS b_y FROM lineitem"""


@query("rect_intersects", f"""
WITH r AS ({RECT_SQL}) SELECT l_orderkey, l_partkey,
 ax + 3 >= bx AND ax <= bx + 0.5 AND ay + 0.5 >= b_y AND ay <= b_y + 2 AS overlap,
 EXISTS (SELECT 1 FROM (VALUES (0, 0), (0, 2), (0.5, 0), (0.5, 2)) c(dx, dy) WHERE bx + dx BETWEEN ax AND ax + 3 AND b_y + dy BETWEEN ay AND ay + 0.5)
 OR EXISTS (SELECT 1 FROM (VALUES (0, 0), (0, 0.5), (3, 0), (3, 0.5)) c(dx, dy) WHERE ax + dx BETWEEN bx AND bx + 0.5 AND ay + dy BETWEEN b_y AND b_y + 2) AS corner
FROM r
""")
def rect_intersects(t):
    r = t.lineitem.select("l_orderkey", "l_partkey", (F.col("l_orderkey") % 16 / 2.0).alias("ax"),
                          (F.col("l_partkey") % 16 / 2.0).alias("ay"), (F.col("l_suppkey") % 16 / 2.0).alias("bx"),
                          (F.col("l_linenumber") / 2.0).alias("b_y"))
    c = F.col
    a = [c("ax"), c("ay"), c("ax") + 3, c("ay") + 0.5]
    b = [c("bx"), c("b_y"), c("bx") + 0.5, c("b_y") + 2]
    return r.select("l_orderkey", "l_partkey", g.rect_intersects(a, b).alias("overlap"),
                    g.rect_intersects(a, b, "corner").alias("corner"))


@query("grid_spatial_join", f"""
WITH {A_SQL}, {B_SQL}
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.x+0.125>=b.x-0.25 AND a.x-0.125<=b.x+0.25 AND a.y+0.125>=b.y-0.25 AND a.y-0.125<=b.y+0.25
""")
def grid_spatial_join(t):
    a = g.point_box(a_points(t), "x", "y", 0.125, 0.125)
    b = g.point_box(b_points(t), "x", "y", 0.25, 0.25)
    return g.box_join(a, b, UNIT_GRID, "id", "id").select("a_id", "b_id")


@query("grid_spatial_join_per_cell", f"""
WITH {A_SQL}, {B_SQL}, cells AS (SELECT CAST(iy.range * 36 + ix.range AS INTEGER) AS cell_id, -1 + ix.range / 2.0 AS x0, -1 + iy.range / 2.0 AS y0 FROM range(0, 36) ix, range(0, 36) iy),
 ac AS (SELECT a.*, cell_id FROM a JOIN cells ON x - 0.125 <= x0 + 0.5 AND x + 0.125 >= x0 AND y - 0.125 <= y0 + 0.5 AND y + 0.125 >= y0),
 bc AS (SELECT b.*, cell_id FROM b JOIN cells ON x - 0.25 <= x0 + 0.5 AND x + 0.25 >= x0 AND y - 0.25 <= y0 + 0.5 AND y + 0.25 >= y0)
SELECT ac.id AS a_id, bc.id AS b_id, ac.cell_id FROM ac JOIN bc ON ac.cell_id = bc.cell_id AND ac.x+0.125>=bc.x-0.25 AND ac.x-0.125<=bc.x+0.25 AND ac.y+0.125>=bc.y-0.25 AND ac.y-0.125<=bc.y+0.25
""")
def grid_spatial_join_per_cell(t):
    """The form that reports a pair in every cell both boxes meet."""
    a = g.point_box(a_points(t), "x", "y", 0.125, 0.125)
    b = g.point_box(b_points(t), "x", "y", 0.25, 0.25)
    return g.box_join(a, b, UNIT_GRID, "id", "id", dedupe=False).select("a_id", "b_id", "cell_id")


def _text(df, template, *names):
    return F.format_string(template, *[F.col(n) for n in names])


RECTANGLE = "POLYGON ((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s))"
TRIANGLE = "POLYGON ((%1$s %2$s, %3$s %2$s, %1$s %4$s, %1$s %2$s))"


def rectangles(t):
    """Part boxes as geometry text with their bounding box."""
    b = g.point_box(b_points(t), "x", "y", 0.25, 0.25)
    text = F.format_string(RECTANGLE, *[F.col(c).cast("string") for c in g.BOX])
    return b.select("id", text.alias("wkt"), *g.BOX)


def triangles(t):
    """Order boxes cut along the diagonal: right angle at the low corner."""
    a = g.point_box(a_points(t), "x", "y", 0.125, 0.125)
    text = F.format_string(TRIANGLE, *[F.col(c).cast("string") for c in g.BOX])
    return a.select("id", text.alias("wkt"), *g.BOX)


@query("polygon_join_exact", f"""
WITH {A_SQL}, {B_SQL}
SELECT a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.x+0.125>=b.x-0.25 AND a.x-0.125<=b.x+0.25 AND a.y+0.125>=b.y-0.25 AND a.y-0.125<=b.y+0.25
WHERE (greatest(a.x-0.125, b.x-0.25) - (a.x-0.125)) + (greatest(a.y-0.125, b.y-0.25) - (a.y-0.125)) <= 0.25
""")
def polygon_join_exact(t):
    """Triangles against rectangles: grid cells, then boxes, then the exact test."""
    a, b = (wkt.read_geometry(side, "wkt") for side in (triangles(t), rectangles(t)))
    return shapes.geometry_join(a, b, UNIT_GRID, "id", "id").select("a_id", "b_id")


GEOM_SQL = f"""WITH {B_SQL}, k AS (SELECT id, id % 7 AS k, x, y, x + 0.5 AS x2, y + 0.5 AS y2 FROM b)"""


def mixed_geometries(t):
    """All six types, and text that is no geometry, from part keys."""
    p = b_points(t).select("id", (F.col("id") % 7).alias("k"), "x", "y", (F.col("x") + 0.5).alias("x2"),
                           (F.col("y") + 0.5).alias("y2"))
    forms = ["POINT (%1$s %2$s)", "MULTIPOINT ((%1$s %2$s), (%3$s %4$s))", "LINESTRING (%1$s %2$s, %3$s %4$s)",
             "MULTILINESTRING ((%1$s %2$s, %3$s %4$s), (%3$s %2$s, %1$s %4$s))", RECTANGLE,
             "MULTIPOLYGON (((%1$s %2$s, %3$s %2$s, %3$s %4$s, %1$s %2$s)), ((%1$s %2$s, %3$s %4$s, %1$s %4$s, %1$s %2$s)))",
             "POLYGON ((%1$s %2$s, %3$s oops))"]
    numbers = [F.col(c).cast("string") for c in ("x", "y", "x2", "y2")]
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(F.col("k") == i, F.format_string(f, *numbers)).otherwise(text)
    return p.select("id", text.alias("wkt"), "x", "y")


@query("parse_wkt", f"""
{GEOM_SQL} SELECT id, k = 6 AS is_bad, CASE WHEN k < 6 THEN ['POINT', 'MULTIPOINT', 'LINESTRING', 'MULTILINESTRING', 'POLYGON', 'MULTIPOLYGON'][k + 1] END AS type,
 CASE WHEN k < 6 THEN [1, 2, 1, 2, 1, 2][k + 1] END AS parts, CASE WHEN k < 6 THEN [1, 2, 2, 4, 5, 8][k + 1] END AS points,
 CASE WHEN k < 6 THEN x END AS xmin, CASE WHEN k < 6 THEN y END AS ymin, CASE WHEN k = 0 THEN x WHEN k < 6 THEN x2 END AS xmax, CASE WHEN k = 0 THEN y WHEN k < 6 THEN y2 END AS ymax FROM k
""")
def parse_wkt(t):
    parsed = wkt.with_mbr(wkt.read_geometry(mixed_geometries(t), "wkt"))
    return parsed.select("id", "is_bad", "geom.type", F.size("geom.parts").alias("parts"),
                         F.size(wkt.all_points(F.col("geom"))).alias("points"), *g.BOX)


@query("to_wkt", f"""
{GEOM_SQL}, q AS (SELECT id, k, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM k),
 s AS (SELECT id, k, regexp_replace(x::VARCHAR, '\\.0$', '') AS a, regexp_replace(y::VARCHAR, '\\.0$', '') AS b, regexp_replace(x2::VARCHAR, '\\.0$', '') AS c, regexp_replace(y2::VARCHAR, '\\.0$', '') AS d FROM q)
SELECT id, CASE k WHEN 0 THEN 'POINT (' || a || ' ' || b || ')' WHEN 1 THEN 'MULTIPOINT ((' || a || ' ' || b || '), (' || c || ' ' || d || '))'
 WHEN 2 THEN 'LINESTRING (' || a || ' ' || b || ', ' || c || ' ' || d || ')'
 WHEN 3 THEN 'MULTILINESTRING ((' || a || ' ' || b || ', ' || c || ' ' || d || '), (' || c || ' ' || b || ', ' || a || ' ' || d || '))'
 WHEN 4 THEN 'POLYGON ((' || a || ' ' || b || ', ' || c || ' ' || b || ', ' || c || ' ' || d || ', ' || a || ' ' || d || ', ' || a || ' ' || b || '))'
 WHEN 5 THEN 'MULTIPOLYGON (((' || a || ' ' || b || ', ' || c || ' ' || b || ', ' || c || ' ' || d || ', ' || a || ' ' || b || ')), ((' || a || ' ' || b || ', ' || c || ' ' || d || ', ' || a || ' ' || d || ', ' || a || ' ' || b || ')))' END AS text FROM s
""")
def to_wkt(t):
    parsed = wkt.read_geometry(mixed_geometries(t), "wkt")
    return parsed.select("id", wkt.to_wkt(F.col("geom")).alias("text"))


@query("geometry_type_split", f"""
{GEOM_SQL}, p AS (SELECT id, unnest(range(0, [1, 2, 1, 2, 1, 2][k + 1])) AS part, ['POINT', 'POINT', 'LINESTRING', 'LINESTRING', 'POLYGON', 'POLYGON'][k + 1] AS simple_type FROM k WHERE k < 6)
SELECT id, CAST(part AS INTEGER) AS part, simple_type FROM p
""")
def geometry_type_split(t):
    parsed = wkt.read_geometry(mixed_geometries(t), "wkt")
    return wkt.split_parts(parsed).select("id", "part", "simple_type")


@query("centroid", f"""
WITH {A_SQL} SELECT id, round(x - 0.125 + 0.25 / 3, 9) AS cx, round(y - 0.125 + 0.25 / 3, 9) AS cy, 0.03125::DOUBLE AS area FROM a
""")
def centroid(t):
    parsed = wkt.read_geometry(triangles(t), "wkt")
    c = measures.centroid(F.col("geom"))
    return parsed.select("id", F.round(c["x"], 9).alias("cx"), F.round(c["y"], 9).alias("cy"),
                         measures.planar_area(F.col("geom")).alias("area"))


@query("extent_filter", f"""
WITH {B_SQL} SELECT id FROM b WHERE x - 0.25 < 3
""")
def extent_filter(t):
    return wkt.extent_filter(wkt.read_geometry(rectangles(t), "wkt"), 3.0).select("id")


@query("ring_roles", f"""
WITH {B_SQL} SELECT id, 0 AS ring, false AS is_hole, 1 AS fill, 5 AS points FROM b UNION ALL SELECT id, 1, true, 0, 4 FROM b
""")
def ring_roles(t):
    """Rectangles with a triangular hole."""
    c = [F.col(n).cast("string") for n in g.BOX]
    middle = [F.col(n).cast("string") for n in ("x", "y")]
    form = RECTANGLE[:-1] + ", (%5$s %6$s, %3$s %6$s, %3$s %4$s, %5$s %6$s))"
    boxes = g.point_box(b_points(t), "x", "y", 0.25, 0.25)
    parsed = wkt.read_geometry(boxes.select("id", F.format_string(form, *c, *middle).alias("wkt")), "wkt")
    return wkt.ring_roles(parsed).select("id", "ring", "is_hole", "fill", F.size("points").alias("points"))


@query("label_point", f"""
WITH {A_SQL} SELECT id, round(x - 0.125 + 0.25 / 3, 9) AS lx, round(y - 0.125 + 0.25 / 3, 9) AS ly FROM a
""")
def label_point(t):
    parsed = wkt.read_geometry(triangles(t), "wkt")
    p = measures.label_point(F.col("geom"))
    return parsed.select("id", F.round(p["x"], 9).alias("lx"), F.round(p["y"], 9).alias("ly"))


AREA_SQL = f"""WITH {B_SQL}, s AS (SELECT id, x - 0.25 AS x1, y - 0.25 + 40 AS y1, x + 0.25 AS x2, y + 0.25 + 40 AS y2, x AS cx FROM b),
 z AS (SELECT range AS zone, range * 6 - 186.0 AS lo, range * 6 - 180.0 AS hi, range * 6 - 183.0 AS cm FROM range(1, 61)),
 v AS (SELECT id, zone, cm, unnest([0, 1, 2, 3]) AS i, x1, y1, x2, y2 FROM s JOIN z ON cx BETWEEN lo AND hi),
 p AS (SELECT id, zone, cm, i, radians(CASE WHEN i IN (0, 3) THEN x1 ELSE x2 END::DOUBLE - cm) AS dl, radians(CASE WHEN i < 2 THEN y1 ELSE y2 END::DOUBLE) AS phi, 0.0066943799901413165::DOUBLE AS e2 FROM v),
 q AS (SELECT *, e2 / (1 - e2) AS ep, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(phi) ** 2) AS n, tan(phi) ** 2 AS t, e2 / (1 - e2) * cos(phi) ** 2 AS c, dl * cos(phi) AS a,
  6378137.0::DOUBLE * ((1 - e2/4 - 3*e2**2/64 - 5*e2**3/256) * phi - (3*e2/8 + 3*e2**2/32 + 45*e2**3/1024) * sin(2*phi) + (15*e2**2/256 + 45*e2**3/1024) * sin(4*phi) - (35*e2**3/3072) * sin(6*phi)) AS m FROM p),
 u AS (SELECT id, zone, i, 0.9996::DOUBLE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18*t + t**2 + 72*c - 58*ep) * a**5 / 120) AS ex,
  0.9996::DOUBLE * (m + n * tan(phi) * (a**2 / 2 + (5 - t + 9*c + 4*c**2) * a**4 / 24 + (61 - 58*t + t**2 + 600*c - 330*ep) * a**6 / 720)) AS ny FROM q)
SELECT a.id, a.zone::INTEGER AS zone, round(abs(sum(a.ex * b.ny - b.ex * a.ny)) / 2 / 1e6, 3) AS area FROM u a JOIN u b ON a.id = b.id AND a.zone = b.zone AND b.i = (a.i + 1) % 4 GROUP BY 1, 2"""


def northern_rectangles(t):
    boxes = g.point_box(b_points(t).withColumn("y", F.col("y") + 40), "x", "y", 0.25, 0.25)
    text = F.format_string(RECTANGLE, *[F.col(c).cast("string") for c in g.BOX])
    return wkt.read_geometry(boxes.select("id", "x", "y", text.alias("wkt")), "wkt")


@query("area_km2", AREA_SQL)
def area_km2(t):
    """Area in the UTM zone of the centroid; a centroid on a zone bound gives two rows."""
    zoned = measures.with_zone(northern_rectangles(t), inclusive=True)
    area = measures.planar_area(measures.project(F.col("geom"), F.col("central"))) / 1e6
    return zoned.select("id", "zone", F.round(area, 3).alias("area"))


HALF_OPEN_SQL = AREA_SQL.replace("cx BETWEEN lo AND hi", "cx >= lo AND cx < hi")


@query("area_every_row", f"""
SELECT id, area FROM ({HALF_OPEN_SQL}) UNION ALL SELECT p_partkey + 1000000, NULL FROM part WHERE p_size = 7
""")
def area_every_row(t):
    """One row for each geometry, whichever zone bound it lies on, and for rows without one."""
    without = t.part.where("p_size = 7").select((F.col("p_partkey") + 1000000).alias("id"), F.lit(None).cast("double").alias("x"),
                                                F.lit(None).cast("double").alias("y"), F.lit(None).cast("string").alias("wkt"))
    rows = northern_rectangles(t).select("id", "x", "y", "wkt").unionByName(without)
    return measures.area_km2(wkt.read_geometry(rows, "wkt")).select("id", F.round("area_km2", 3).alias("area"))


@query("buffer_metres", "SELECT count(*) AS n, true AS all_supported, true AS all_wider, true AS all_near FROM part")
def buffer_metres(t):
    """Buffers of all boxes: each lies around its box, by about the distance in every direction."""
    out = measures.buffer_metres(northern_rectangles(t), 100.0)
    both = computed_once(out, _o=wkt.mbr(F.col("geom")), _b=wkt.mbr(wkt.parse_wkt(F.col("buffer"))))
    o, b, degree = F.col("_o"), F.col("_b"), 100.0 / 111_320.0
    wider = (b["xmin"] < o["xmin"]) & (b["xmax"] > o["xmax"]) & (b["ymin"] < o["ymin"]) & (b["ymax"] > o["ymax"])
    near = ((b["ymax"] - o["ymax"]).between(0.98 * degree, 1.02 * degree)
            & ((b["xmax"] - o["xmax"]) * F.cos(F.radians(o["ymin"])) < 1.05 * degree))
    return both.agg(F.count("*").alias("n"), F.bool_and("buffer_supported").alias("all_supported"),
                    F.coalesce(F.bool_and(wider), F.lit(False)).alias("all_wider"), F.coalesce(F.bool_and(near), F.lit(False)).alias("all_near"))


#: Right-angled shapes around a point, rings with the outside on their right: kind, ring, corner, corners of the ring, offsets.
_CORNERS = {0: [[(-2, -2), (2, -2), (2, 0), (0, 0), (0, 2), (-2, 2)]],
            1: [[(-2, -2), (2, -2), (2, 2), (-2, 2)], [(-1, -1), (-1, 1), (1, 1), (1, -1)]],
            2: [[(-2, -2), (-1, -2), (-1, -1), (-2, -1)], [(1, 1), (2, 1), (2, 2), (1, 2)]]}
_CORNER_ROWS = ", ".join(f"({kind}, {ring}, {i}, {len(corners)}, {dx / 8}, {dy / 8})" for kind, rings in _CORNERS.items()
                         for ring, corners in enumerate(rings) for i, (dx, dy) in enumerate(corners))


@query("buffer_any_shape", f"""
WITH {B_SQL}, s AS (SELECT id, id % 3 AS kind, x + 0.0078125 AS x, y + 40 AS y FROM b),
 v AS (SELECT id, c.*, x + dx AS lon, y + dy AS lat, 6 * floor((x - CASE s.kind WHEN 0 THEN 1 / 24.0 ELSE 0 END) / 6) + 3 AS cm
  FROM s JOIN (VALUES {_CORNER_ROWS}) c(kind, ring, i, n, dx, dy) ON c.kind = s.kind),
 p AS (SELECT *, radians(lon::DOUBLE - cm) AS dl, radians(lat::DOUBLE) AS phi, 0.0066943799901413165::DOUBLE AS e2 FROM v),
 q AS (SELECT *, e2 / (1 - e2) AS ep, 6378137.0::DOUBLE / sqrt(1 - e2 * sin(phi) ** 2) AS nu, tan(phi) ** 2 AS t, e2 / (1 - e2) * cos(phi) ** 2 AS c, dl * cos(phi) AS a,
  6378137.0::DOUBLE * ((1 - e2/4 - 3*e2**2/64 - 5*e2**3/256) * phi - (3*e2/8 + 3*e2**2/32 + 45*e2**3/1024) * sin(2*phi) + (15*e2**2/256 + 45*e2**3/1024) * sin(4*phi) - (35*e2**3/3072) * sin(6*phi)) AS m FROM p),
 u AS (SELECT id, kind, ring, i, n, 0.9996::DOUBLE * nu * (a + (1 - t + c) * a**3 / 6 + (5 - 18*t + t**2 + 72*c - 58*ep) * a**5 / 120) AS ex,
  0.9996::DOUBLE * (m + nu * tan(phi) * (a**2 / 2 + (5 - t + 9*c + 4*c**2) * a**4 / 24 + (61 - 58*t + t**2 + 600*c - 330*ep) * a**6 / 720)) AS ny FROM q),
 e AS (SELECT k.id, k.kind, k.ex * o.ny - o.ex * k.ny AS twice, sqrt((o.ex - k.ex) ** 2 + (o.ny - k.ny) ** 2) AS len,
  atan2((k.ex - h.ex) * (o.ny - k.ny) - (k.ny - h.ny) * (o.ex - k.ex), (k.ex - h.ex) * (o.ex - k.ex) + (k.ny - h.ny) * (o.ny - k.ny)) AS turn
  FROM u k JOIN u o ON o.id = k.id AND o.ring = k.ring AND o.i = (k.i + 1) % k.n JOIN u h ON h.id = k.id AND h.ring = k.ring AND h.i = (k.i + k.n - 1) % k.n),
 w AS (SELECT id, kind, sum(twice / 2 + 100 * len + CASE WHEN turn > 0 THEN 5000 * ceil(turn / (pi() / 16) - 1e-9) * sin(turn / ceil(turn / (pi() / 16) - 1e-9))
  ELSE -10000 * tan(-turn / 2) END) / 1e6 AS km2 FROM e GROUP BY 1, 2)
SELECT id, [1, 1, 2][kind + 1] AS parts, [1, 2, 2][kind + 1] AS rings, round(km2, 2) AS km2 FROM w
""")
def buffer_any_shape(t):
    """Buffers of bent polygons, polygons with a hole and pairs of polygons: their parts, rings and areas."""
    def ring(corners) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat((F.col("x") + dx / 8).cast("string"), F.lit(" "), (F.col("y") + dy / 8).cast("string"))
                                                       for dx, dy in [*corners, corners[0]]]), F.lit(")"))

    points = b_points(t).select("id", (F.col("id") % 3).alias("kind"), (F.col("x") + 1 / 128).alias("x"), (F.col("y") + 40).alias("y"))
    one, hole, two = ([ring(c) for c in _CORNERS[k]] for k in range(3))
    text = (F.when(F.col("kind") == 0, F.concat(F.lit("POLYGON ("), *one, F.lit(")")))
            .when(F.col("kind") == 1, F.concat(F.lit("POLYGON ("), hole[0], F.lit(", "), hole[1], F.lit(")")))
            .otherwise(F.concat(F.lit("MULTIPOLYGON (("), two[0], F.lit("), ("), two[1], F.lit("))"))))
    rows = wkt.read_geometry(points.select("id", text.alias("wkt")), "wkt")
    zoned = measures.with_zone(measures.buffer_metres(rows, 100.0), "geom")
    found = computed_once(zoned, _b=wkt.parse_wkt(F.col("buffer")))
    area = measures.planar_area(measures.project(F.col("_b"), F.col("central"))) / 1e6
    return found.select("id", F.size("_b.parts").alias("parts"), F.size(F.flatten("_b.parts")).alias("rings"), F.round(area, 2).alias("km2"))


@query("within_metres", "SELECT p_partkey AS id, true AS is_near, false AS is_far_near FROM part")
def within_metres(t):
    """Points 0.001 and 0.02 degrees east of a box: at these latitudes at most 86 m and at least 190 m away."""
    rows = northern_rectangles(t).withColumns({"lon": F.col("x") + 0.251, "far": F.col("x") + 0.27})
    near = measures.within_metres(rows, 100.0, "lon", "y")
    return measures.within_metres(near, 100.0, "far", "y", output="is_far_near").select("id", "is_near", "is_far_near")


@query("simplify_long_text", """
WITH c AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS n, true AS ends_stay, true AS only_own_points, true AS never_more, true AS some_fewer FROM c
""")
def simplify_long_text(t):
    """The whole route of each supplier as one line, thinned when the text is long."""
    from larkfield.operators.ranking import ordered_chunks

    p = F.concat(((F.col("l_orderkey") % 64) / 64.0).cast("string"), F.lit(" "), ((F.col("l_partkey") % 64) / 64.0).cast("string"))
    stops = t.lineitem.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", p.alias("at"))
    order = [(c, "asc") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")]
    chunks = ordered_chunks(stops, ["l_suppkey"], order, "at", "stops", chunk=500)
    in_order = F.array_sort(F.collect_list(F.struct("chunk_no", "stops")))
    lines = chunks.groupBy("l_suppkey").agg(F.flatten(in_order["stops"]).alias("stops"))
    # a route of one stop is drawn as a line to itself, so that no route is left out
    drawn = F.when(F.size("stops") > 1, F.col("stops")).otherwise(F.concat("stops", "stops"))
    text = F.concat(F.lit("LINESTRING ("), F.array_join(drawn, ", "), F.lit(")"))
    parsed = wkt.read_geometry(lines.select("l_suppkey", text.alias("wkt")), "wkt")
    out = shapes.simplify_long_text(parsed, "geom", 2000, 0.25)
    points = computed_once(out, _a=wkt.all_points(F.col("geom")), _b=wkt.all_points(wkt.parse_wkt(F.col("poly"))))
    a, b = F.col("_a"), F.col("_b")
    ends = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.element_at(a, -1) == F.element_at(b, -1))
    return points.agg(F.count("*").alias("n"), F.bool_and(ends).alias("ends_stay"), F.bool_and(F.size(F.array_except(b, a)) == 0).alias("only_own_points"),
                      F.bool_and(F.size(b) <= F.size(a)).alias("never_more"), F.bool_or(F.size(b) < F.size(a)).alias("some_fewer"))


@query("simplify_keeps_rings", f"""
WITH {B_SQL}, s AS (SELECT id, id % 4 AS kind, x::DOUBLE AS x, y::DOUBLE AS y FROM b)
SELECT id, kind, 1 + 4 + CASE WHEN kind IN (1, 2) THEN 1 ELSE 0 END AS outline, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 4 END AS hole,
 CASE WHEN kind IN (1, 2) THEN y + 1.0625 ELSE y + 1 END AS top FROM s
""")
def simplify_keeps_rings(t):
    """Boxes with a low peak in the middle of the upper side, which thinning would cut off.

    Kind 0 has nothing under the peak. In kinds 1 and 2 a hole reaches into it, so the outline would be crossed, or a
    small hole lies in it whole and would fall out. The hole of kind 3 has a peak of its own that goes.
    """
    p = b_points(t).select("id", (F.col("id") % 4).alias("kind"), "x", "y")

    def ring(*corners) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat((F.col("x") + dx).cast("string"), F.lit(" "), (F.col("y") + dy).cast("string"))
                                                       for dx, dy in [*corners, corners[0]]]), F.lit(")"))

    outline = ring((0, 0), (1, 0), (1, 1), (0.5, 1.0625), (0, 1))
    holes = [ring((0.25, 0.5), (0.75, 0.5), (0.5, 1.03125)), ring((0.4375, 1.015625), (0.5625, 1.015625), (0.5, 1.03125)),
             ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.5), (0.5, 0.53125), (0.25, 0.5))]
    hole = F.when(F.col("kind") == 1, holes[0]).when(F.col("kind") == 2, holes[1]).when(F.col("kind") == 3, holes[2])
    text = F.concat(F.lit("POLYGON ("), F.concat_ws(", ", outline, hole), F.lit(")"))
    rows = wkt.read_geometry(p.select("id", "kind", text.alias("wkt")), "wkt")
    rings = F.get(F.col("s.parts"), F.lit(0))
    out = computed_once(shapes.simplify(rows, "geom", 0.125, "s"), _r=rings)
    size = lambda i: F.coalesce(F.size(F.get("_r", F.lit(i))), F.lit(0))
    top = F.array_max(F.transform(F.get("_r", F.lit(0)), lambda p: p["y"]))
    return out.select("id", "kind", size(0).alias("outline"), F.when(F.get("_r", F.lit(1)).isNull(), 0).otherwise(size(1)).alias("hole"), top.alias("top"))


@query("inner_label_point", f"""
WITH {B_SQL}, s AS (SELECT id, id % 2 AS kind, x::DOUBLE AS x, y::DOUBLE AS y FROM b),
 r AS (SELECT *, CASE kind WHEN 0 THEN 5 - sqrt(12.0) ELSE 5 * sqrt(2.0) / (1 + sqrt(2.0)) END AS gap FROM s)
SELECT id, round(CASE kind WHEN 0 THEN x + gap ELSE x + 8 - gap END, 4) AS lx, round(CASE kind WHEN 0 THEN y + gap ELSE y + 8 - gap END, 4) AS ly, round(gap, 4) AS gap,
 true AS is_inside, kind = 1 AS centre_is_inside FROM r
""")
def inner_label_point(t):
    """Where a label fits in a U-shape, whose centroid lies outside, and in a box with a hole near a corner.

    The widest circle of the U touches two sides and the inner corner: 2 wide on the left and 3 at the foot it has radius
    5 - sqrt(12).
    """
    p = b_points(t).select("id", (F.col("id") % 2).alias("kind"), "x", "y")

    def ring(*corners) -> Column:
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat((F.col("x") + dx).cast("string"), F.lit(" "), (F.col("y") + dy).cast("string"))
                                                       for dx, dy in [*corners, corners[0]]]), F.lit(")"))

    u = ring((0, 0), (19, 0), (19, 20), (18, 20), (18, 3), (2, 3), (2, 20), (0, 20))
    holed = F.concat_ws(", ", ring((0, 0), (8, 0), (8, 8), (0, 8)), ring((1, 1), (3, 1), (3, 3), (1, 3)))
    text = F.concat(F.lit("POLYGON ("), F.when(F.col("kind") == 0, u).otherwise(holed), F.lit(")"))
    rows = wkt.read_geometry(p.select("id", text.alias("wkt")), "wkt")
    out = computed_once(measures.inner_label_point(rows), _c=measures.centroid(F.col("geom")))
    inside = lambda c: measures.point_in_polygon(F.col("geom"), F.col(f"{c}.x"), F.col(f"{c}.y"))
    return out.select("id", *[F.round(f"label.{c}", 4).alias(n) for c, n in (("x", "lx"), ("y", "ly"), ("gap", "gap"))],
                      inside("label").alias("is_inside"), inside("_c").alias("centre_is_inside"))


GEOJSON_SQL = f"""WITH {B_SQL}, s AS (SELECT id, regexp_replace(x::DOUBLE::VARCHAR, '\\.0$', '') AS a, regexp_replace(y::DOUBLE::VARCHAR, '\\.0$', '') AS b FROM b)
SELECT '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || a || ',' || b || ']}},"properties":{{"id":' || id || '}}}}' AS value FROM s"""


@query("write_geojson", GEOJSON_SQL)
def write_geojson(t):
    """The same features by way of their files."""
    p, path = b_points(t), fresh_path(t.spark, "geojson")
    text = F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string"))
    features.write_geojson(wkt.read_geometry(p.select("id", text.alias("wkt")), "wkt"), "geom", ["id"], path)
    return t.spark.read.text(path)


@query("geojson_features", GEOJSON_SQL)
def geojson_features(t):
    p = b_points(t)
    text = F.format_string("POINT (%s %s)", F.col("x").cast("string"), F.col("y").cast("string"))
    return features.geojson_features(wkt.read_geometry(p.select("id", text.alias("wkt")), "wkt"), "geom", ["id"])


def _kml(layer: str, *parts: str) -> str:
    """SQL text of a shape: coordinates of its parts in, one or several elements out."""
    tag = {"points": "Point", "lines": "LineString", "polygons": "Polygon"}[layer]
    inner = lambda c: f"'<outerBoundaryIs><LinearRing><coordinates>' || {c} || '</coordinates></LinearRing></outerBoundaryIs>'"
    body = inner if layer == "polygons" else lambda c: f"'<coordinates>' || {c} || '</coordinates>'"
    shapes = " || ".join(f"'<{tag}><extrude>1</extrude><altitudeMode>relativeToGround</altitudeMode>' || {body(c)} || '</{tag}>'" for c in parts)
    return shapes if len(parts) == 1 else f"'<MultiGeometry>' || {shapes} || '</MultiGeometry>'"


def _layer_sql(layer: str, first: int, single: str, *several: str) -> str:
    """SQL of a layer's placemarks: type number ``first`` has one part, the next has several."""
    return f"""WITH {B_SQL}, k AS (SELECT id, id % 7 AS k, x, y, x + 0.5 AS x2, y + 0.5 AS y2 FROM b),
 s AS (SELECT id, k, {", ".join(f"regexp_replace({c}::DOUBLE::VARCHAR, '\\.0$', '') AS {n}" for c, n in (("x", "a"), ("y", "b"), ("x2", "c"), ("y2", "d")))} FROM k),
 n AS (SELECT id, k, a || ',' || b || ',5' AS ab, c || ',' || d || ',5' AS cd, c || ',' || b || ',5' AS cb, a || ',' || d || ',5' AS ad FROM s)
SELECT 'p' || id AS name, '<Placemark><name>p' || id || '</name><description>id: ' || id || chr(10) || 'kind: a &amp; b</description>' ||
 CASE WHEN k = {first} THEN {_kml(layer, single)} ELSE {_kml(layer, *several)} END || '</Placemark>' AS value FROM n WHERE k IN ({first}, {first + 1})"""


def _labelled(t):
    return mixed_geometries(t).select("id", F.concat(F.lit("p"), "id").alias("label"), F.lit("a & b").alias("kind"), "wkt")


@query("placemarks", _layer_sql("points", 0, "ab", "ab", "cd"))
def placemarks(t):
    """The point layer of a table that holds every geometry type, points and multipoints."""
    return features.placemarks(_labelled(t), "points", "wkt", "label", altitude=5)[0]


@query("placemarks_lines", _layer_sql("lines", 2, "ab || ' ' || cd", "ab || ' ' || cd", "cb || ' ' || ad"))
def placemarks_lines(t):
    """The line layer, written to files and read back."""
    path = fresh_path(t.spark, "placemarks")
    features.write_placemarks(_labelled(t), "lines", "wkt", path, f"{path}-bad", name="label", altitude=5)
    value = F.col("value")
    # a description holds a line break, so a placemark is written on two lines
    rows = t.spark.read.option("lineSep", "</Placemark>\n").text(path)
    return rows.select(F.regexp_extract(value, "<name>([^<]*)<", 1).alias("name"), F.concat(value, F.lit("</Placemark>")).alias("value"))


@query("map_document", _layer_sql("lines", 2, "ab || ' ' || cd", "ab || ' ' || cd", "cb || ' ' || ad"))
def map_document(t):
    """The line layer as linked documents of at most 40 placemarks; what their tiles hold together."""
    path = fresh_path(t.spark, "map")
    map_documents.write_map_document(_labelled(t), "lines", "wkt", path, f"{path}-bad", most=40, name="label", altitude=5)
    tiles = t.spark.read.text(f"{path}/tiles", wholetext=True)
    value = F.explode(F.expr("regexp_extract_all(value, '(?s)<Placemark>.*?</Placemark>', 0)"))
    return tiles.select(value.alias("value")).select(F.regexp_extract("value", "<name>([^<]*)<", 1).alias("name"), "value")


@query("placemarks_polygons", _layer_sql("polygons", 4, "ab || ' ' || cb || ' ' || cd || ' ' || ad || ' ' || ab",
                                         "ab || ' ' || cb || ' ' || cd || ' ' || ab", "ab || ' ' || cd || ' ' || ad || ' ' || ab"))
def placemarks_polygons(t):
    return features.placemarks(_labelled(t), "polygons", "wkt", "label", altitude=5)[0]


@query("placemarks_set_aside", f"""
WITH {B_SQL} SELECT id FROM b WHERE id % 7 NOT IN (4, 5)
""")
def placemarks_set_aside(t):
    rows = mixed_geometries(t).select("id", F.concat(F.lit("p"), "id").alias("label"), "wkt")
    return features.placemarks(rows, "polygons", "wkt", "label")[1].select("id")
