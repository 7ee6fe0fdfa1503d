"""Geometry features as GeoJSON and KML text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.functions.text import describe_row
from larkfield.session import computed_once
from larkfield.spatial.wkt import _number, mbr, parse_wkt

# Layers and the geometry types each one takes.
LAYERS = {
    "points": ("POINT", "MULTIPOINT"),
    "lines": ("LINESTRING", "MULTILINESTRING"),
    "polygons": ("POLYGON", "MULTIPOLYGON"),
}
GEOJSON_NAMES = {
    "POINT": "Point", "MULTIPOINT": "MultiPoint", "LINESTRING": "LineString",
    "MULTILINESTRING": "MultiLineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon",
}


def _list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def geojson_geometry(geom: Column) -> Column:
    """The geometry as a GeoJSON object in text form."""
    point = lambda p: F.concat(F.lit("["), _number(p["x"]), F.lit(","), _number(p["y"]), F.lit("]"))
    ring = lambda r: _list(F.transform(r, point))
    rings = lambda part: _list(F.transform(part, ring))
    kind, parts = geom["type"], geom["parts"]
    first = F.get(parts, F.lit(0))
    only = F.get(first, F.lit(0))
    body = (F.when(kind == "POINT", point(F.get(only, F.lit(0)))).when(kind == "LINESTRING", ring(only))
            .when(kind == "POLYGON", rings(first)).when(kind == "MULTIPOLYGON", _list(F.transform(parts, rings)))
            .when(kind == "MULTILINESTRING", _list(F.transform(parts, lambda p: ring(F.get(p, F.lit(0))))))
            .otherwise(_list(F.transform(parts, lambda p: point(F.get(F.get(p, F.lit(0)), F.lit(0)))))))
    names = F.create_map(*[F.lit(v) for kv in GEOJSON_NAMES.items() for v in kv])
    return F.when(geom.isNotNull(), F.concat(
        F.lit('{"type":"'), F.element_at(names, kind), F.lit('","coordinates":'), body, F.lit("}")))


def geojson_features(df: DataFrame, geom: str, properties: Sequence[str]) -> DataFrame:
    """One GeoJSON feature per row, in the column ``value``."""
    props = F.to_json(F.struct(*properties), {"ignoreNullFields": "false"}) if properties else F.lit("{}")
    shape = F.coalesce(geojson_geometry(F.col(geom)), F.lit("null"))
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), props,
                              F.lit("}")).alias("value"))


def write_geojson(df: DataFrame, geom: str, properties: Sequence[str], path: str) -> None:
    """Newline-delimited GeoJSON features."""
    geojson_features(df, geom, properties).write.mode("overwrite").text(path)


def description_columns(columns: Sequence[str], geometry: str, name: str | None,
                        wanted: str | Sequence[str] | None = "all",
                        excluded: Sequence[str] = ()) -> list[str]:
    """Columns of the description: the wanted ones, or all but geometry, name and excluded."""
    if wanted is None:
        return []
    if wanted != "all":
        return [c for c in wanted if c not in excluded]
    return [c for c in columns if c not in (geometry, name) and c not in excluded]


def _escaped(text: Column) -> Column:
    out = F.regexp_replace(text, "&", "&amp;")
    return F.regexp_replace(F.regexp_replace(out, "<", "&lt;"), ">", "&gt;")


def _coordinates(points: Column, altitude: float) -> Column:
    tail = F.lit(f",{altitude:g}")
    return F.concat(F.lit("<coordinates>"), F.array_join(F.transform(points, lambda p: F.concat(
        _number(p["x"]), F.lit(","), _number(p["y"]), tail)), " "), F.lit("</coordinates>"))


def _boundary(tag: str, points: Column, altitude: float) -> Column:
    return F.concat(F.lit(f"<{tag}><LinearRing>"), _coordinates(points, altitude), F.lit(f"</LinearRing></{tag}>"))


def _shape(layer: str, part: Column, altitude: float) -> Column:
    mode = "<altitudeMode>relativeToGround</altitudeMode>"
    outer = F.get(part, F.lit(0))
    if layer == "points":
        return F.concat(F.lit(f"<Point><extrude>1</extrude>{mode}"), _coordinates(outer, altitude), F.lit("</Point>"))
    if layer == "lines":
        return F.concat(F.lit(f"<LineString><extrude>1</extrude>{mode}"), _coordinates(outer, altitude),
                        F.lit("</LineString>"))
    holes = F.transform(F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0))),
                        lambda r: _boundary("innerBoundaryIs", r, altitude))
    return F.concat(F.lit(f"<Polygon><extrude>1</extrude>{mode}"), _boundary("outerBoundaryIs", outer, altitude),
                    F.array_join(holes, ""), F.lit("</Polygon>"))


def _time(begin: str | None, end: str | None) -> Column:
    if begin is None:
        return F.lit("")
    if end is None or end == begin:
        return F.concat(F.lit("<TimeStamp><when>"), F.col(begin).cast("string"), F.lit("</when></TimeStamp>"))
    return F.concat(F.lit("<TimeSpan><begin>"), F.col(begin).cast("string"), F.lit("</begin><end>"),
                    F.col(end).cast("string"), F.lit("</end></TimeSpan>"))


def _region(geom: Column) -> Column:
    b = mbr(geom)
    return F.concat(F.lit("<Region><LatLonAltBox><north>"), _number(b["ymax"]), F.lit("</north><south>"),
                    _number(b["ymin"]), F.lit("</south><east>"), _number(b["xmax"]), F.lit("</east><west>"),
                    _number(b["xmin"]), F.lit("</west></LatLonAltBox></Region>"))


def placemarks(df: DataFrame, layer: str, geometry: str, name: str | None = None,
               description: str | Sequence[str] | None = "all", excluded: Sequence[str] = (),
               altitude: float = 0, row_id: str | None = None, begin: str | None = None,
               end: str | None = None, with_box: bool = False, keep_box: bool = False) -> tuple[DataFrame, DataFrame]:
    """One KML placemark per geometry text, and the rows that have none.

    ``layer`` is points, lines or polygons. The name is a column, or ``row_id`` where no
    name column is given. Multi-part geometries become one multi-geometry; rings after the
    first are holes; the altitude is added to every vertex. Rows whose text cannot be read
    or is of another type come back in the second frame. ``keep_box`` adds the bounding box as columns.
    """
    if layer not in LAYERS:
        raise ValueError(f"layer must be one of {sorted(LAYERS)}")
    label = name or row_id
    if label is None:
        raise ValueError("name the rows with a name column or a row_id column")
    wanted = description_columns(df.columns, geometry, label, description, excluded)
    read = computed_once(df, _g=parse_wkt(F.col(geometry)))
    fits = F.coalesce(F.col("_g")["type"].isin(*LAYERS[layer]), F.lit(False))
    good, bad = read.where(fits), read.where(~fits).select(*df.columns)
    shapes = F.transform(F.col("_g")["parts"], lambda part: _shape(layer, part, altitude))
    body = F.when(F.col("_g")["type"].startswith("MULTI"), F.concat(
        F.lit("<MultiGeometry>"), F.array_join(shapes, ""), F.lit("</MultiGeometry>"))).otherwise(F.get(shapes, F.lit(0)))
    pieces = [F.lit("<Placemark><name>"), _escaped(F.coalesce(F.col(label).cast("string"), F.lit(""))), F.lit("</name>")]
    if wanted:
        pieces += [F.lit("<description>"), _escaped(describe_row(wanted)), F.lit("</description>")]
    pieces.append(_time(begin, end))
    if with_box:
        pieces.append(_region(F.col("_g")))
    text = F.concat(*pieces, body, F.lit("</Placemark>"))
    box = [mbr(F.col("_g"))[c].alias(c) for c in ("xmin", "ymin", "xmax", "ymax")] if keep_box else []
    return good.select(F.col(label).alias("name"), text.alias("value"), *box), bad


def write_placemarks(df: DataFrame, layer: str, geometry: str, path: str, bad_path: str, **options) -> None:
    """Placemark lines to ``path``; rows with a bad geometry to ``bad_path``.

    Many tasks write, so each file holds placemarks only; ``map_document`` writes documents that open.
    """
    good, bad = placemarks(df, layer, geometry, **options)
    good.select("value").write.mode("overwrite").text(path)
    bad.write.mode("overwrite").parquet(bad_path)
