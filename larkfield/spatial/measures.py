"""Area, centroid, distance and buffers of geometry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.joins import range_join
from larkfield.session import computed_once
from larkfield.spatial.projection import project, unproject, utm_zones
from larkfield.spatial.outline import outlines
from larkfield.spatial.shapes import flat_columns
from larkfield.spatial.thinning import inner_points
from larkfield.spatial.wkt import all_points, let, to_wkt


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1),
                      lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def ring_moments(ring: Column) -> Column:
    """Signed area and first moments, measured from the ring's first point."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def from_origin(origin: Column) -> Column:
        def step(p: Column, q: Column) -> Column:
            return F.struct((p["x"] - origin["x"]).alias("px"), (p["y"] - origin["y"]).alias("py"),
                            (q["x"] - origin["x"]).alias("qx"), (q["y"] - origin["y"]).alias("qy"))

        def weighed(e: Column) -> Column:
            cross = e["px"] * e["qy"] - e["qx"] * e["py"]
            return F.struct(cross.alias("c"), (e["px"] + e["qx"]).alias("sx"), (e["py"] + e["qy"]).alias("sy"))

        n = F.size(ring)
        moves = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), step)
        return F.aggregate(F.transform(moves, weighed), zero, lambda acc, w: F.struct(
            (acc["a"] + w["c"] / 2).alias("a"), (acc["mx"] + w["sx"] * w["c"] / 6).alias("mx"),
            (acc["my"] + w["sy"] * w["c"] / 6).alias("my")))

    return let(F.get(ring, F.lit(0)), from_origin)


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, v: acc + v)


def _field(array: Column, name: str) -> Column:
    return F.transform(array, lambda item: item[name])


def _rings_area(rings: Column) -> Column:
    """Area of one part: its outline without the holes."""
    sizes = F.transform(rings, lambda r: F.abs(ring_moments(r)["a"]))
    return let(sizes, lambda v: 2 * F.get(v, F.lit(0)) - _sum(v))


def planar_area(geom: Column) -> Column:
    """Area of polygons, holes taken off; 0 for points and lines."""
    def of(g: Column) -> Column:
        area = _sum(F.transform(g["parts"], _rings_area))
        return F.when(g["type"].endswith("POLYGON"), area).when(g.isNotNull(), F.lit(0.0))

    return let(geom, of)


def _centre(kind: Column, parts: Column) -> Column:
    def weighted(rings: Column) -> Column:
        def one(r: Column, i: Column) -> Column:
            def signed(m: Column) -> Column:
                # Outline counts positive, holes negative, whatever their direction.
                sign = F.signum(m["a"]) * F.when(i == 0, 1.0).otherwise(-1.0)
                o = F.get(r, F.lit(0))
                return F.struct((sign * m["a"]).alias("a"), (sign * (m["mx"] + m["a"] * o["x"])).alias("mx"),
                                (sign * (m["my"] + m["a"] * o["y"])).alias("my"))
            return let(ring_moments(r), signed)
        return F.transform(rings, one)

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    total = F.aggregate(F.flatten(F.transform(parts, weighted)), zero, lambda acc, t: F.struct(
        *[(acc[n] + t[n]).alias(n) for n in ("a", "mx", "my")]))
    vertices = F.struct(*[let(_field(F.flatten(F.flatten(parts)), n), lambda v: _sum(v) / F.nullif(F.size(v), F.lit(0))).alias(n)
                          for n in ("x", "y")])
    balanced = let(total, lambda t: F.when(t["a"] != 0, F.struct(
        (t["mx"] / t["a"]).alias("x"), (t["my"] / t["a"]).alias("y"))))
    return F.when(kind.endswith("POLYGON"), F.coalesce(balanced, vertices)).otherwise(vertices)


def centroid(geom: Column) -> Column:
    """Centre of gravity ``struct<x, y>``: of the area, else of the vertices."""
    return F.when(geom.isNotNull(), let(geom, lambda g: _centre(g["type"], g["parts"])))


def label_point(geom: Column) -> Column:
    """Place for a label: the centroid of the largest part, the first of equal ones."""
    def of(g: Column) -> Column:
        sized = F.transform(g["parts"], lambda r, i: F.struct(
            _rings_area(r).alias("size"), (-i).alias("order"), r.alias("rings")))
        best = F.aggregate(sized, F.struct(F.lit(-1.0).alias("size"), F.lit(0).alias("i")),
                           lambda acc, s: F.when(s["size"] > acc["size"], F.struct(
                               s["size"].alias("size"), (-s["order"]).alias("i"))).otherwise(acc))
        return let(F.get(g["parts"], best["i"]), lambda rings: _centre(g["type"], F.array(rings)))

    return F.when(geom.isNotNull(), let(geom, of))


def with_zone(df: DataFrame, geom: str = "geom", inclusive: bool = False) -> DataFrame:
    """Add the UTM zone whose longitudes hold the centroid, and its central meridian.

    Every row stays and comes once: a zone takes its western bound (the last one both), and a row
    without a geometry, or with its centroid off the map, has NULL. With ``inclusive`` both bounds
    count: a centroid on a bound gives two rows, and rows without a zone go.
    """
    located = computed_once(df, _cx=centroid(F.col(geom))["x"])
    if not inclusive:
        x = F.col("_cx")
        zone = F.when(x.between(-180, 180), F.least(F.floor((x + 180) / 6) + 1, F.lit(60))).cast("int")
        return located.withColumn("zone", zone).withColumn("central", F.col("zone") * 6.0 - 183).drop("_cx")
    zones = utm_zones(df.sparkSession)
    return range_join(located, "_cx", zones, "lon_min", "lon_max", 6.0).drop("_cx", "lon_min", "lon_max")


def area_km2(df: DataFrame, geom: str = "geom", output: str = "area_km2", inclusive: bool = False) -> DataFrame:
    """Area in square kilometres, measured in the geometry's own UTM zone; NULL without one."""
    zoned = with_zone(df, geom, inclusive)
    area = planar_area(project(F.col(geom), F.col("central"))) / 1e6
    return zoned.withColumn(output, area).drop("zone", "central")


def buffer_metres(df: DataFrame, metres: float, geom: str = "geom", output: str = "buffer",
                  quadrant_steps: int = 8) -> DataFrame:
    """Buffer of any shape as geometry text in degrees, built in the geometry's own UTM zone.

    Exact up to the circle's polygon of four times ``quadrant_steps`` corners: points, bent lines, holes and
    several parts give one polygon or several. A shape without a zone, an empty one, or one whose
    outline cannot be closed has NULL, and ``<output>_supported`` is false.
    """
    if not metres > 0:
        raise ValueError("a buffer needs a distance above 0")
    zoned = with_zone(df, geom)
    placed = lambda g: F.forall(all_points(g), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    metric = computed_once(zoned, _utm=let(project(F.col(geom), F.col("central")), lambda g: F.when(placed(g), g)))
    utm = F.col("_utm")
    columns = [*flat_columns(utm), F.transform(utm["parts"], F.size), utm["type"]]
    grown = metric.withColumn("_rings", outlines(*columns, F.lit(float(metres)), F.lit(quadrant_steps)))
    parts = F.zip_with("_rings.x", "_rings.y", lambda xs, ys: F.zip_with(xs, ys, lambda x, y: F.zip_with(
        x, y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))))
    kind = F.when(F.size("_rings.x") > 1, F.lit("MULTIPOLYGON")).otherwise(F.lit("POLYGON"))
    shape = F.struct(kind.alias("type"), parts.alias("parts"))
    text = F.when(F.col("_rings.x").isNotNull(), to_wkt(unproject(shape, F.col("central"))))
    return (grown.withColumn(output, text).withColumn(f"{output}_supported", F.col(output).isNotNull())
            .drop("_utm", "_rings", "zone", "central"))


def inner_label_point(df: DataFrame, geom: str = "geom", output: str = "label", precision: float = 1e-6) -> DataFrame:
    """Add ``struct<x, y, gap>``: the point inside a polygon farthest from its edge, and how far that is.

    Unlike the centroid it always lies inside, also of bent shapes and rings. Of several parts the roomiest
    one has it; shapes other than polygons have NULL. ``precision`` is a share of the shape's width.
    """
    g = F.col(geom)
    area = g["type"].endswith("POLYGON")
    columns = [F.when(area, c) for c in (*flat_columns(g), F.transform(g["parts"], F.size))]
    found = computed_once(df, _p=inner_points(*columns, F.lit(float(precision))))
    return found.withColumn(output, F.when(F.col("_p.gap").isNotNull(), F.col("_p"))).drop("_p")


def segment_distance(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Distance from a point to the segment p-q."""
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    length = dx * dx + dy * dy
    along = F.coalesce(((x - p["x"]) * dx + (y - p["y"]) * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = x - p["x"] - along * dx, y - p["y"] - along * dy
    return F.sqrt(ex * ex + ey * ey)


def point_in_polygon(geom: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside."""
    edges = F.flatten(F.transform(F.flatten(geom["parts"]), _edges))

    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > y) != (q["y"] > y)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return spans & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def distance_metres(geom: Column, x: Column, y: Column) -> Column:
    """Distance from a point to a projected geometry; 0 inside a polygon."""
    edges = F.flatten(F.transform(F.flatten(geom["parts"]), _edges))
    nearest = F.array_min(F.transform(edges, lambda e: segment_distance(x, y, e["p"], e["q"])))
    lone = F.array_min(F.transform(all_points(geom), lambda p: F.sqrt(
        F.pow(x - p["x"], F.lit(2.0)) + F.pow(y - p["y"], F.lit(2.0)))))
    inside = geom["type"].endswith("POLYGON") & point_in_polygon(geom, x, y)
    return F.when(inside, F.lit(0.0)).otherwise(F.coalesce(nearest, lone))


def within_metres(df: DataFrame, metres: float, lon: str, lat: str, geom: str = "geom",
                  output: str = "is_near") -> DataFrame:
    """Is a point within a distance of the row's geometry? Exact for every shape."""
    zoned = with_zone(df, geom)
    point = F.struct(F.lit("POINT").alias("type"), F.array(F.array(F.array(F.struct(
        F.col(lon).alias("x"), F.col(lat).alias("y"))))).alias("parts"))
    at = F.get(all_points(project(point, F.col("central"))), F.lit(0))
    moved = computed_once(zoned, _utm=project(F.col(geom), F.col("central")), _at=at)
    near = distance_metres(F.col("_utm"), F.col("_at.x"), F.col("_at.y")) <= metres
    return moved.withColumn(output, near).drop("_utm", "_at", "zone", "central")
