"""Shapes as plain coordinate arrays: exact joins and simplified outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.session import checkpointed
from larkfield.spatial.cell_join import exact_join
from larkfield.spatial.grid import Grid
from larkfield.spatial.thinning import thinned_rings
from larkfield.spatial.wkt import all_points, to_wkt, with_mbr


def flat_columns(geom: Column) -> list[Column]:
    """Coordinates as plain arrays, and the end position of every ring."""
    points = all_points(geom)
    rings = F.flatten(geom["parts"])
    ends = F.aggregate(rings, F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(
        F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + F.size(r))))
    return [F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]), ends]


FLAT = ("flat_x", "flat_y", "flat_ends", "flat_area")


def with_flat(df: DataFrame, geom: str) -> DataFrame:
    """Add the plain coordinate arrays that the exact test reads, once per geometry."""
    x, y, ends = flat_columns(F.col(geom))
    area = F.coalesce(F.col(geom)["type"].endswith("POLYGON"), F.lit(False))
    return df.select("*", *[c.alias(n) for c, n in zip((x, y, ends, area), FLAT)])


def geometry_join(left: DataFrame, right: DataFrame, grid: Grid, left_id: str, right_id: str,
                  geom: str = "geom", **options) -> DataFrame:
    """``a_id, b_id`` of geometries that share a point; touching counts, each pair comes once.

    Rows whose geometry is NULL have no box and pair with nothing; shapes outside the grid are joined by its
    border cells. Both sides are written once with their boxes and plain coordinates, because the cells are
    counted before they are joined and reading geometry text is the costly step.
    """
    sides = [checkpointed(with_flat(with_mbr(df.select(key, geom), geom), geom).drop(geom)
                          .where(F.col("xmin").isNotNull()))
             for df, key in ((left, left_id), (right, right_id))]
    return exact_join(*sides, grid, left_id, right_id, **options)


def simplify(df: DataFrame, geom: str, tolerance: float, output: str) -> DataFrame:
    """Drop vertices that lie within ``tolerance`` of the remaining line, unless a ring would be crossed.

    All rings and lines of a shape are thinned together: none comes to cross or touch another or itself where
    it did not before, holes stay in their outlines, and rings keep at least four points.
    """
    g = F.col(geom)
    thinned = df.withColumn("_t", thinned_rings(*flat_columns(g), F.lit(float(tolerance)),
                                                 g["type"].endswith("POLYGON")))
    rings = F.zip_with("_t.x", "_t.y", lambda xs, ys: F.zip_with(
        xs, ys, lambda x, y: F.struct(x.alias("x"), y.alias("y"))))
    sizes = F.transform(g["parts"], F.size)

    def part(_: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda acc, n: acc + n)
        return F.slice(rings, before + 1, F.get(sizes, i))

    shape = F.struct(g["type"].alias("type"), F.transform(g["parts"], part).alias("parts"))
    return thinned.withColumn(output, F.when(g.isNotNull(), shape)).drop("_t")


def simplify_long_text(df: DataFrame, geom: str, limit: int = 32_000, tolerance: float = 0.001,
                       output: str = "poly") -> DataFrame:
    """Geometry text, simplified only where it would reach ``limit`` characters."""
    text = df.withColumn("_full", to_wkt(F.col(geom)))
    long = F.length("_full") >= limit
    # Short geometries enter the Python step as NULL and cost nothing there.
    thinned = simplify(text.withColumn("_long", F.when(long, F.col(geom))), "_long", tolerance, "_thin")
    return thinned.withColumn(output, F.when(long, to_wkt(F.col("_thin"))).otherwise(F.col("_full"))
                              ).drop("_full", "_long", "_thin")
