"""Regular grids: cells of a rectangle, and joins of boxes through their cells."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.operators.joins import hot_keys, salted_join
from larkfield.session import checkpointed, dealt, small_side

BOX = ("xmin", "ymin", "xmax", "ymax")
PAIRS_PER_BOX = 8
FINEST = 64
#: Boxes are of about one size if none is wider than this many times the mean.
ONE_SIZE = 2.0
#: Right boxes of a run, which meets the left boxes of its cell in turn, and runs from which a cell is worth cutting into them.
RUN_BOXES, RUNS_PER_BOX = 64, 4


@dataclass(frozen=True)
class Grid:
    """``nx * ny`` equal cells; the cell id is ``iy * nx + ix``, counted from the low corner."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float
    nx: int
    ny: int

    @property
    def dx(self) -> float:
        return (self.xmax - self.xmin) / self.nx

    @property
    def dy(self) -> float:
        return (self.ymax - self.ymin) / self.ny


# The country-wide grid of the published spatial query.
COUNTRY_GRID = Grid(-180.0, 40.0, 180.0, 80.0, 100, 100)


def _first_index(low: Column, origin, step, n: int) -> Column:
    return F.greatest(F.ceil((low - origin) / step - 1).cast("int"), F.lit(0))


def _last_index(high: Column, origin, step, n: int) -> Column:
    return F.least(F.floor((high - origin) / step).cast("int"), F.lit(n - 1))


def _owner_index(value: Column, origin, step, n) -> Column:
    index = F.floor((value - origin) / step).cast("int")
    return F.least(F.greatest(index, F.lit(0)), F.lit(n - 1) if isinstance(n, int) else n - 1)


def _product(ix0: Column, ix1: Column, iy0: Column, iy1: Column, nx) -> Column:
    rows = F.transform(F.sequence(iy0, iy1), lambda iy: F.transform(
        F.sequence(ix0, ix1), lambda ix: iy * nx + ix))
    return F.flatten(rows)


def tessellate(xmin: Column, ymin: Column, xmax: Column, ymax: Column, grid: Grid, clamp: bool = False) -> Column:
    """Ids of the cells that a rectangle meets, edges included; none outside the grid.

    The index range follows from the edges, so the cost is the number of cells met and
    not the size of the grid. With ``clamp`` border cells take what lies outside.
    """
    ix0, ix1 = _first_index(xmin, grid.xmin, grid.dx, grid.nx), _last_index(xmax, grid.xmin, grid.dx, grid.nx)
    iy0, iy1 = _first_index(ymin, grid.ymin, grid.dy, grid.ny), _last_index(ymax, grid.ymin, grid.dy, grid.ny)
    if clamp:
        return _product(F.least(ix0, F.lit(grid.nx - 1)), F.greatest(ix1, F.lit(0)), F.least(iy0, F.lit(grid.ny - 1)), F.greatest(iy1, F.lit(0)), F.lit(grid.nx))
    # Without the guard sequence(3, 1) would count down.
    return F.when((ix0 <= ix1) & (iy0 <= iy1), _product(ix0, ix1, iy0, iy1, F.lit(grid.nx))
                  ).otherwise(F.array().cast("array<int>"))


def with_cells(df: DataFrame, grid: Grid, box: Sequence[str] = BOX, output: str = "cell_id", clamp: bool = False) -> DataFrame:
    """One row per cell that the box of the row meets."""
    return df.withColumn(output, F.explode(tessellate(*[F.col(c) for c in box], grid, clamp)))


def point_box(df: DataFrame, x: str, y: str, dx: float, dy: float) -> DataFrame:
    """Add the rectangle ``point +- delta``."""
    return df.select("*", (F.col(x) - dx).alias("xmin"), (F.col(y) - dy).alias("ymin"),
                     (F.col(x) + dx).alias("xmax"), (F.col(y) + dy).alias("ymax"))


def rect_contains(rect: Sequence[Column], x: Column, y: Column) -> Column:
    xmin, ymin, xmax, ymax = rect
    return (x >= xmin) & (x <= xmax) & (y >= ymin) & (y <= ymax)


def rect_intersects(a: Sequence[Column], b: Sequence[Column], mode: str = "overlap") -> Column:
    """Do two rectangles meet, edges included?

    ``corner`` asks only whether one holds a corner of the other and so misses crossing
    bars; it is there for comparison with older results.
    """
    if mode == "overlap":
        return (a[2] >= b[0]) & (a[0] <= b[2]) & (a[3] >= b[1]) & (a[1] <= b[3])
    if mode != "corner":
        raise ValueError("mode must be 'overlap' or 'corner'")
    hit = F.lit(False)
    for one, other in ((a, b), (b, a)):
        for x in (other[0], other[2]):
            for y in (other[1], other[3]):
                hit = hit | rect_contains(one, x, y)
    return hit


def _side(df: DataFrame, key: str, box: Sequence[str], prefix: str, extra: Sequence[str]) -> DataFrame:
    return df.select(F.col(key).alias(f"{prefix}_id"),
                     *[F.col(c).alias(f"{prefix}_{n}") for c, n in zip(box, BOX)],
                     *[F.col(c).alias(f"{prefix}_{c}") for c in extra])


def _cell_loads(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boxes of both sides per cell that both have: at most one row per grid cell.

    Stored, because it is read twice and one pass over the boxes is enough.
    """
    both = a.select("cell_id", F.lit(1).alias("na"), F.lit(0).alias("nb")).unionAll(
        b.select("cell_id", F.lit(0).alias("na"), F.lit(1).alias("nb")))
    counts = both.groupBy("cell_id").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    return checkpointed(counts.where((F.col("na") > 0) & (F.col("nb") > 0)))


def _refined(df: DataFrame, prefix: str, grid: Grid, parts: DataFrame | None) -> DataFrame:
    """Give rows of crowded cells the numbers of the finer cells they meet, others 0; ``_parts`` stays."""
    if parts is None:
        return df.withColumns({"sub_id": F.lit(0), "_parts": F.lit(None).cast("int")})
    joined = df.join(parts, "cell_id", "left")
    n = F.col("_parts")
    x0 = F.lit(grid.xmin) + (F.col("cell_id") % grid.nx) * grid.dx
    y0 = F.lit(grid.ymin) + F.floor(F.col("cell_id") / grid.nx) * grid.dy
    low = lambda c, o, d: F.least(F.greatest(F.ceil((c - o) / (F.lit(d) / n) - 1).cast("int"), F.lit(0)), n - 1)
    high = lambda c, o, d: F.greatest(F.least(F.floor((c - o) / (F.lit(d) / n)).cast("int"), n - 1), F.lit(0))
    ix0, ix1 = low(F.col(f"{prefix}_xmin"), x0, grid.dx), high(F.col(f"{prefix}_xmax"), x0, grid.dx)
    iy0, iy1 = low(F.col(f"{prefix}_ymin"), y0, grid.dy), high(F.col(f"{prefix}_ymax"), y0, grid.dy)
    # Rounding at an edge may turn a touching range around by one: order both ends.
    cells = _product(F.least(ix0, ix1), F.greatest(ix0, ix1), F.least(iy0, iy1), F.greatest(iy0, iy1), n)
    listed = F.when(n.isNull(), F.array(F.lit(0))).otherwise(F.transform(cells, lambda c: c + 1))
    return joined.withColumn("sub_id", F.explode(listed))


def _owned(grid: Grid) -> Column:
    """True in the one cell that holds the low corner of the overlap of both boxes."""
    x, y = F.greatest("a_xmin", "b_xmin"), F.greatest("a_ymin", "b_ymin")
    ix, iy = _owner_index(x, grid.xmin, grid.dx, grid.nx), _owner_index(y, grid.ymin, grid.dy, grid.ny)
    n = F.col("_parts")
    sx = _owner_index(x, F.lit(grid.xmin) + ix * grid.dx, F.lit(grid.dx) / n, n)
    sy = _owner_index(y, F.lit(grid.ymin) + iy * grid.dy, F.lit(grid.dy) / n, n)
    return (F.col("cell_id") == iy * grid.nx + ix) & (F.col("sub_id") == F.when(n.isNull(), 0).otherwise(sy * n + sx + 1))


def _reach(left: DataFrame, box: Sequence[str]) -> tuple[float, float] | None:
    """Width and height of the widest box if all are of about one size, else None."""
    spans = [F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1])]
    seen = left.agg(*[f(s.cast("double")) for s in spans for f in (F.min, F.avg, F.max)]).first()
    if any(v is None for v in seen):
        return None
    fine = [0 <= low and most <= ONE_SIZE * mean and math.isfinite(most) for low, mean, most in (seen[:3], seen[3:])]
    return (seen[2], seen[5]) if all(fine) else None


def _anchored(df: DataFrame, prefix: str, grid: Grid, reach: tuple[float, float] | None, parts: DataFrame | None = None,
              refine: bool = False) -> DataFrame:
    """Rows under the cell of their low corner or, given the ``reach`` of such boxes, under all cells with corners of boxes they meet.

    With ``refine`` rows that have a ``cell_id`` get the numbers of the finer cells in the same way, 0 in cells that are not cut.
    """
    ends = []
    for k, axis in enumerate("xy"):
        low, high = F.col(f"{prefix}_{axis}min"), F.col(f"{prefix}_{axis}max")
        if reach is None:
            ends.append((low, low))
        else:  # somewhat wider, as the widths and the differences are rounded
            ends.append((low - reach[k] - (F.abs(low) + reach[k]) * 1e-9, high))
    span = lambda e, o, d, n: [_owner_index(v, o, d, n) for v in e]
    if not refine:
        x, y = span(ends[0], grid.xmin, grid.dx, grid.nx), span(ends[1], grid.ymin, grid.dy, grid.ny)
        return df.withColumn("cell_id", F.explode(_product(x[0], F.greatest(*x), y[0], F.greatest(*y), F.lit(grid.nx))))
    if parts is None:
        return df.withColumn("sub_id", F.lit(0))
    n = F.col("_parts")
    x0 = F.lit(grid.xmin) + (F.col("cell_id") % grid.nx) * grid.dx
    y0 = F.lit(grid.ymin) + F.floor(F.col("cell_id") / grid.nx) * grid.dy
    x, y = span(ends[0], x0, F.lit(grid.dx) / n, n), span(ends[1], y0, F.lit(grid.dy) / n, n)
    finer = F.transform(_product(x[0], F.greatest(*x), y[0], F.greatest(*y), n), lambda c: c + 1)
    joined = df.join(parts, "cell_id", "left")
    return joined.withColumn("sub_id", F.explode(F.when(n.isNull(), F.array(F.lit(0))).otherwise(finer))).drop("_parts")


def _cut_in_runs(keys: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    size, names = RUN_BOXES, [f"_{c}" for c in BOX]  # plain values: executors need not have this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.stack([batch.column(k).to_numpy() for k in keys], 1)
            first = np.flatnonzero(np.append(True, (np.diff(cells, axis=0) != 0).any(1)))
            many = np.diff(np.append(first, len(cells)))
            cell = np.repeat(np.arange(len(first)), many)
            place = np.arange(len(cells)) - first[cell]
            # upright strips of whole runs, about as many as a strip has runs; rows come sorted by xmin
            runs = -(-many // size)
            strip = place // (size * -(-runs // np.ceil(np.sqrt(runs)).astype(int)))[cell]
            order = np.lexsort((batch.column("_ymin").to_numpy(), strip, cell))
            begin = np.flatnonzero(place % size == 0)
            values = batch.column("items").take(pa.array(order))
            items = pa.ListArray.from_arrays(pa.array(np.append(begin, len(cells)), pa.int32()), values)
            # what is no number is above all numbers in Spark; a bound may have been rounded
            bounds = [np.nextafter(f.reduceat(batch.column(n).to_numpy()[order], begin), end)
                      for n, f, end in zip(names, (np.fmin, np.fmin, np.maximum, np.maximum), (-np.inf, -np.inf, np.inf, np.inf))]
            yield pa.record_batch({**{k: batch.column(k).take(pa.array(begin)) for k in keys}, "items": items,
                                   **{n: pa.array(v) for n, v in zip(names, bounds)}})

    return run


def _in_runs(df: DataFrame, prefix: str, keys: Sequence[str] = ("cell_id",)) -> DataFrame:
    """Rows of a cell as lists of at most ``RUN_BOXES`` that lie close together, and the box ``_xmin`` ... around each list.

    A crowded cell spreads over several tasks.
    """
    boxes = [F.col(f"{prefix}_{c}").cast("double").alias(f"_{c}") for c in BOX]
    rows = df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias("items"), *boxes)
    order = [*keys, *[f"items.{prefix}_{c}" for c in BOX], f"items.{prefix}_id"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    fields.append(T.StructField("items", T.ArrayType(rows.schema["items"].dataType)))
    return spread.mapInArrow(_cut_in_runs(tuple(keys)), T.StructType([*fields, *[T.StructField(f"_{c}", T.DoubleType()) for c in BOX]]))


def _run_pairs(a: DataFrame, b: DataFrame, keys: Sequence[str], hot: DataFrame, salt_rows: int, hint: str | None, meets: Column) -> DataFrame:
    """Pairs of a and b that meet, by runs of b; a run whose box a row of a does not meet is not opened."""
    near = rect_intersects([F.col(f"a_{c}") for c in BOX], [F.col(f"_{c}") for c in BOX])
    joined = salted_join(_in_runs(b, "b", keys), a, keys, near, hot, salt_rows, hint=hint)
    return joined.select(*[c for c in a.columns if c not in keys], "cell_id", F.inline("items")).where(meets)


def box_join(left: DataFrame, right: DataFrame, grid: Grid, left_id: str, right_id: str,
             left_box: Sequence[str] = BOX, right_box: Sequence[str] = BOX,
             left_extra: Sequence[str] = (), right_extra: Sequence[str] = (), dedupe: bool = True,
             crowded_pairs: int = 20_000_000, salt_rows: int = 500_000) -> DataFrame:
    """Pairs of boxes that meet, found by an equi-join on grid cells.

    With ``dedupe`` a pair appears once; boxes outside the grid count to its border cells, so no pair is lost. If all
    left boxes are of about one size, each goes only to the cell of its low corner, and a right box to all cells where
    such corners of boxes that it meets can be. Else a pair is made in the cell that holds the low corner of the overlap. Without
    ``dedupe`` the pair appears in every cell of the grid both boxes meet, with its ``cell_id``; the right boxes of a cell
    then come in runs, each with the left boxes that meet the box around it in turn, so that few pairs are compared and near rows
    repeat few ids and are stored in few bytes. With ``dedupe`` and left boxes of one size runs are made where cells are full.

    A cell with very many boxes of both sides is cut into finer cells; what stays hot, such
    as many equal boxes, is spread by salting. Columns: ``a_id, b_id, cell_id``, the boxes
    as ``a_xmin`` ... and the extra columns as ``a_<name>``, ``b_<name>``.
    """
    # a small file is read by few tasks, which would list the cells of all its boxes
    a, b = dealt(_side(left, left_id, left_box, "a", left_extra)), dealt(_side(right, right_id, right_box, "b", right_extra))
    reach = _reach(left, left_box) if dedupe else None
    if reach:
        a, b = _anchored(a, "a", grid, None), _anchored(b, "b", grid, reach)
    else:
        a, b = (with_cells(df, grid, [f"{p}_{c}" for c in BOX], clamp=dedupe) for df, p in ((a, "a"), (b, "b")))
    meets = rect_intersects([F.col(f"a_{c}") for c in BOX], [F.col(f"b_{c}") for c in BOX])
    counts = _cell_loads(a, b)
    product = F.col("na").cast("double") * F.col("nb")
    load = F.greatest(product / crowded_pairs, F.col("na") / salt_rows, F.col("nb") / salt_rows)
    seen = counts.agg((F.sum(product) / F.sum("na")).alias("growth"), F.max(product).alias("most")).first()
    growth = seen["growth"] or 0
    in_runs = not dedupe or bool(reach) and growth > RUNS_PER_BOX * RUN_BOXES
    # A finer cut divides the candidate pairs of a cell by about the number of parts. It stops at
    # FINEST, since wide boxes are repeated in every part; what is still crowded then is salted.
    # A run is one candidate, whatever it holds.
    fit = crowded_pairs * (RUN_BOXES if in_runs else 1)
    cut = F.when(F.lit(dedupe) & (product > fit), F.least(F.lit(FINEST), F.ceil(F.sqrt(product / fit))).cast("int"))
    # Where pairs far outnumber boxes, shuffling the boxes is the small part and evens out
    # the work; otherwise Spark may broadcast a small side.
    hint = "merge" if growth > PAIRS_PER_BOX else None
    if not dedupe:
        hot = counts.where(load > 1).select("cell_id", F.ceil(F.col("nb") / RUN_BOXES).alias("_left"), F.col("na").alias("_right"))
        return _run_pairs(a, b, ["cell_id"], hot, salt_rows, hint, meets)
    parts = small_side(counts.select("cell_id", cut.alias("_parts")).where("_parts IS NOT NULL")) if dedupe and (seen["most"] or 0) > fit else None
    if reach:
        a, b = _anchored(a, "a", grid, None, parts, refine=True), _anchored(b, "b", grid, reach, parts, refine=True)
    else:
        a, b = _refined(a, "a", grid, parts), _refined(b, "b", grid, parts).drop("_parts")
    keys = ["cell_id", "sub_id"]
    hot = counts.where((load > 1) & cut.isNull()).select(
        "cell_id", F.lit(0).alias("sub_id"), F.col("na").alias("_left"), F.col("nb").alias("_right"))
    if parts is not None:
        of_a, of_b = (hot_keys(side.where("sub_id > 0"), keys, salt_rows) for side in (a, b))
        finer = of_a.withColumnRenamed("_rows", "_left").join(of_b.withColumnRenamed("_rows", "_right"), keys, "full")
        hot = hot.unionByName(finer)
    if in_runs:
        of_runs = hot.select(*keys, F.ceil(F.col("_right") / RUN_BOXES).alias("_left"), F.col("_left").alias("_right"))
        return _run_pairs(a, b, keys, of_runs, salt_rows, hint, meets)
    condition = meets if reach else meets & _owned(grid)
    return salted_join(a, b, keys, condition, hot, salt_rows, hint=hint).drop("sub_id", "_parts")
