"""Geometry text to nested arrays and back, as column expressions.

A geometry is ``struct<type, parts>``; a part is an array of rings or lines, a ring an
array of points ``struct<x, y>``. In polygons the first ring of a part is its outline and
the others are holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.session import computed_once, dealt

TYPES = ["POINT", "MULTIPOINT", "LINESTRING", "MULTILINESTRING", "POLYGON", "MULTIPOLYGON"]
GEOMETRY = "struct<type:string,parts:array<array<array<struct<x:double,y:double>>>>>"
# Text may span lines; a Z or M mark and its numbers are read over; EMPTY has no parts.
_OUTLINE = r"(?is)^\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:Z|M)?\s*(\(.*\)|EMPTY)\s*$"
_NEXT_RING = r"\)\s*,\s*\("
_NEXT_POLYGON = r"\)\s*\)\s*,\s*\(\s*\("


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s(]+|[\s)]+$", "")


def _points(text: Column) -> Column:
    def numbers(n: Column) -> Column:
        x, y = F.get(n, F.lit(0)).try_cast("double"), F.get(n, F.lit(1)).try_cast("double")
        return F.when(F.size(n).between(2, 3), F.struct(x.alias("x"), y.alias("y")))

    def point(pair: Column) -> Column:
        read = let(F.split(F.btrim(pair, F.lit(" \t\r\n")), r"\s+"), numbers)
        return let(read, lambda p: F.when(p["x"].isNotNull() & p["y"].isNotNull(), p))

    return F.transform(F.split(text, ","), point)


def parse_wkt(text: Column) -> Column:
    """Geometry struct of the six simple types; NULL for text that is not one of them."""
    pieces = F.struct(F.upper(F.concat(F.regexp_extract(text, _OUTLINE, 1), F.regexp_extract(text, _OUTLINE, 2)))
                      .alias("kind"), F.regexp_extract(text, _OUTLINE, 3).alias("body"))
    return let(pieces, _geometry).cast(GEOMETRY)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _geometry(pieces: Column) -> Column:
    kind, body = pieces["kind"], pieces["body"]
    parts = (F.when(F.upper(body) == "EMPTY", F.array().cast("array<string>"))
             .when(kind == "MULTIPOLYGON", F.split(_bare(body), _NEXT_POLYGON))
             .when(kind == "MULTILINESTRING", F.split(_bare(body), _NEXT_RING))
             .when(kind == "MULTIPOINT", F.split(F.regexp_replace(body, r"[()]", ""), ","))
             .when(kind != "", F.array(_bare(body))))
    rings = F.transform(parts, lambda part: F.transform(
        F.split(part, _NEXT_RING), lambda ring: _points(ring)))

    def checked(r: Column) -> Column:
        least = F.when(kind.endswith("POLYGON"), 4).when(kind.endswith("LINESTRING"), 2).otherwise(1)
        closed = ~kind.endswith("POLYGON")
        good = F.forall(F.flatten(r), lambda ring: F.forall(ring, lambda p: p.isNotNull())
                        & (F.size(ring) >= least) & (closed | (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)))
                        & (~kind.endswith("POINT") | (F.size(ring) == 1)))
        return F.when(good, F.struct(kind.alias("type"), r.alias("parts")))

    return let(rings, checked)


def with_geometry(df: DataFrame, text: str, output: str = "geom", bad: str = "is_bad") -> DataFrame:
    """Add the geometry and a flag for text that cannot be read; no stand-in shape is made."""
    return computed_once(df, **{output: parse_wkt(F.col(text))}).withColumn(
        bad, F.col(text).isNotNull() & F.col(output).isNull())


def read_geometry(df: DataFrame, text: str, output: str = "geom", bad: str = "is_bad") -> DataFrame:
    """``with_geometry`` on rows dealt to all cores first, in no order.

    Reading text, and what is done with a shape afterwards, takes far longer than the bytes of a table tell.
    """
    return with_geometry(dealt(df), text, output, bad)


def _number(value: Column) -> Column:
    """All digits of the double, written out where 20 decimals hold them, without a needless ``.0``."""
    def written(text: Column) -> Column:
        plain = text.try_cast("decimal(38,20)")
        whole = F.when(text.contains("E") & (plain.cast("double") == text.cast("double")),
                       F.regexp_replace(plain.cast("string"), r"(\.\d*?)0+$", "$1")).otherwise(text)
        return F.regexp_replace(whole, r"\.0?$", "")

    return let(value.cast("double").cast("string"), written)


def to_wkt(geom: Column) -> Column:
    """Geometry text with all digits, so that it reads back as the same numbers."""
    def ring(points: Column) -> Column:
        return F.array_join(F.transform(points, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"]))), ", ")

    def rings(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda r: F.concat(F.lit("("), ring(r), F.lit(")"))), ", ")

    def written(g: Column) -> Column:
        kind, parts = g["type"], g["parts"]
        single = F.get(parts, F.lit(0))
        wrapped = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("("), rings(p), F.lit(")"))), ", ")
        listed = F.array_join(F.transform(parts, rings), ", ")
        body = (F.when(kind.isin("POINT", "LINESTRING"), rings(single))
                .when(kind == "MULTIPOLYGON", F.concat(F.lit("("), wrapped, F.lit(")")))
                .when(kind == "POLYGON", F.concat(F.lit("("), rings(single), F.lit(")")))
                .otherwise(F.concat(F.lit("("), listed, F.lit(")"))))
        return F.when(g.isNotNull(), F.concat(kind, F.lit(" "), F.when(F.size(parts) == 0, F.lit("EMPTY")).otherwise(body)))

    return let(geom, written)


def all_points(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def mbr(geom: Column) -> Column:
    """Bounding box ``struct<xmin, ymin, xmax, ymax>``."""
    def bounds(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                        F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))

    return let(geom, lambda g: F.when(g.isNotNull(), let(all_points(g), bounds)))


def with_mbr(df: DataFrame, geom: str = "geom") -> DataFrame:
    return computed_once(df, _b=mbr(F.col(geom))).select(*df.columns, "_b.xmin", "_b.ymin", "_b.xmax", "_b.ymax")


def split_parts(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per part of a geometry: ``part`` (from 0), the simple type and the geometry."""
    rows = df.select("*", F.posexplode(F.col(geom)["parts"]).alias("part", "_rings"))
    simple = F.regexp_replace(F.col(geom)["type"], "^MULTI", "")
    piece = F.struct(simple.alias("type"), F.array("_rings").alias("parts"))
    return rows.withColumn("simple_type", simple).withColumn(geom, piece).drop("_rings")


def ring_roles(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per ring of polygon parts: part, ring, ``is_hole``, ``fill`` and its points."""
    parts = df.where(F.col(geom)["type"].endswith("POLYGON")).select(
        "*", F.posexplode(F.col(geom)["parts"]).alias("part", "_rings"))
    rings = parts.select("*", F.posexplode("_rings").alias("ring", "points")).drop("_rings")
    return rings.withColumn("is_hole", F.col("ring") > 0).withColumn("fill", (F.col("ring") == 0).cast("int"))


def extent_filter(df: DataFrame, xmin_below: float, geom: str = "geom") -> DataFrame:
    """Geometries that reach west of a longitude."""
    return df.where(mbr(F.col(geom))["xmin"] < xmin_below)
