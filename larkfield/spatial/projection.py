"""Longitude and latitude to UTM metres and back, as column expressions.

Transverse Mercator series of Snyder, Map Projections: A Working Manual (USGS Professional
Paper 1395, 1987), on the WGS 84 ellipsoid. Northings have no false offset, so values
south of the equator are negative and shapes across it stay whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ellipsoid and UTM constants.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
SCALE = 0.9996
FALSE_EASTING = 500000.0

E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
_M0 = 1 - E2 / 4 - 3 * E2 ** 2 / 64 - 5 * E2 ** 3 / 256
_M2 = 3 * E2 / 8 + 3 * E2 ** 2 / 32 + 45 * E2 ** 3 / 1024
_M4 = 15 * E2 ** 2 / 256 + 45 * E2 ** 3 / 1024
_M6 = 35 * E2 ** 3 / 3072
_E1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))


def utm_zones(spark: SparkSession) -> DataFrame:
    """The 60 zones: ``zone, lon_min, lon_max, central``; neighbours share a bound."""
    zone = F.col("id").cast("int")
    return spark.range(1, 61).select(zone.alias("zone"), (zone * 6.0 - 186).alias("lon_min"),
                                     (zone * 6.0 - 180).alias("lon_max"), (zone * 6.0 - 183).alias("central"))


def _powers(value: Column, *exponents: int) -> list[Column]:
    return [F.pow(value, F.lit(float(e))) for e in exponents]


def project_points(points: Column, central: Column) -> Column:
    """Array of (longitude, latitude) points to an array of UTM (x, y) points in metres.

    Two transforms: the first holds the terms that the second uses several times.
    """
    def terms(p: Column) -> Column:
        phi = F.radians(p["y"])
        cos, sin, tan = F.cos(phi), F.sin(phi), F.tan(phi)
        meridian = SEMI_MAJOR * (_M0 * phi - _M2 * F.sin(2 * phi) + _M4 * F.sin(4 * phi) - _M6 * F.sin(6 * phi))
        return F.struct((SEMI_MAJOR / F.sqrt(1 - E2 * sin * sin)).alias("n"), (tan * tan).alias("t"),
                        (EP2 * cos * cos).alias("c"), (F.radians(p["x"] - central) * cos).alias("a"),
                        tan.alias("tan"), meridian.alias("m"))

    def place(s: Column) -> Column:
        t, c, a = s["t"], s["c"], s["a"]
        a2, a3, a4, a5, a6 = _powers(a, 2, 3, 4, 5, 6)
        x = SCALE * s["n"] * (a + (1 - t + c) * a3 / 6
                              + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a5 / 120) + FALSE_EASTING
        y = SCALE * (s["m"] + s["n"] * s["tan"] * (
            a2 / 2 + (5 - t + 9 * c + 4 * c * c) * a4 / 24
            + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a6 / 720))
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(F.transform(points, terms), place)


def unproject_points(points: Column, central: Column) -> Column:
    """Array of UTM (x, y) points in metres back to (longitude, latitude)."""
    def footpoint(p: Column) -> Column:
        mu = p["y"] / SCALE / (SEMI_MAJOR * _M0)
        phi = (mu + (3 * _E1 / 2 - 27 * _E1 ** 3 / 32) * F.sin(2 * mu)
               + (21 * _E1 ** 2 / 16 - 55 * _E1 ** 4 / 32) * F.sin(4 * mu)
               + (151 * _E1 ** 3 / 96) * F.sin(6 * mu) + (1097 * _E1 ** 4 / 512) * F.sin(8 * mu))
        return F.struct(phi.alias("phi"), p["x"].alias("x"))

    def terms(s: Column) -> Column:
        sin, cos, tan = F.sin(s["phi"]), F.cos(s["phi"]), F.tan(s["phi"])
        w = 1 - E2 * sin * sin
        n = SEMI_MAJOR / F.sqrt(w)
        return F.struct(s["phi"].alias("phi"), cos.alias("cos"), (EP2 * cos * cos).alias("c"), (tan * tan).alias("t"),
                        (tan * w / (1 - E2)).alias("ratio"), ((s["x"] - FALSE_EASTING) / (n * SCALE)).alias("d"))

    def place(s: Column) -> Column:
        c, t, d = s["c"], s["t"], s["d"]
        d2, d3, d4, d5, d6 = _powers(d, 2, 3, 4, 5, 6)
        lat = s["phi"] - s["ratio"] * (
            d2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * d4 / 24
            + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * d6 / 720)
        lon = (d - (1 + 2 * t + c) * d3 / 6
               + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * d5 / 120) / s["cos"]
        return F.struct((central + F.degrees(lon)).alias("x"), F.degrees(lat).alias("y"))

    return F.transform(F.transform(F.transform(points, footpoint), terms), place)


def project(geom: Column, central: Column) -> Column:
    """A whole geometry in UTM metres of the zone with the given central meridian."""
    return _each_ring(geom, lambda ring: project_points(ring, central))


def unproject(geom: Column, central: Column) -> Column:
    return _each_ring(geom, lambda ring: unproject_points(ring, central))


def _each_ring(geom: Column, change) -> Column:
    parts = F.transform(geom["parts"], lambda part: F.transform(part, change))
    return F.when(geom.isNotNull(), F.struct(geom["type"].alias("type"), parts.alias("parts")))
