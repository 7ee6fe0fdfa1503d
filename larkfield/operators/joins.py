"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.session import checkpointed, small_side

SALT_ROWS = 500_000


def with_group_values(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a per-group table to every row; NULL keys match NULL keys."""
    extra = [c for c in values.columns if c not in keys]
    side = small_side(values.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)],
                                    *extra))
    match = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(side, match, "left").select(*df.columns, *extra)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = SALT_ROWS) -> DataFrame:
    """All keys with over ``min_rows`` rows, and ``_rows``: a stored frame, never a list.

    It has at most one row for every ``min_rows`` rows of ``df``. The counting is a partial
    aggregation, so a hot key is reduced before the shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return checkpointed(counts.where(F.col("_rows") > min_rows))


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str],
                condition: Column | None = None, hot: DataFrame | None = None,
                min_rows: int = SALT_ROWS, check_right: bool = True, hint: str | None = None) -> DataFrame:
    """Inner equi-join on ``keys`` with hot keys spread over several tasks.

    A key with many left rows gets several left salts by hash and its right rows are
    repeated for each of them, and the other way round, so every pair is made exactly once.
    Other keys join unsalted. ``hot`` has the keys, ``_left`` and ``_right`` rows of hot keys when
    the caller knows them; ``check_right=False`` skips counting a right side without hot keys.
    ``hint`` names a join strategy for the right side. Key names must be equal on both
    sides and other names distinct.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_keys(left, keys, min_rows).withColumnRenamed("_rows", "_left")
        if check_right:
            hot = hot.join(hot_keys(right, keys, min_rows).withColumnRenamed("_rows", "_right"), keys, "full")
        else:
            hot = hot.withColumn("_right", F.lit(0))
    parts = lambda c: F.ceil(F.greatest(F.coalesce(c, F.lit(0)), F.lit(1)) / min_rows).cast("int")
    table = checkpointed(hot.select(*keys, parts("_left").alias("_n"), parts("_right").alias("_m")).where("_n > 1 OR _m > 1"))
    if table.isEmpty():
        joined = left.join(right if hint is None else right.hint(hint), keys)
        return joined if condition is None else joined.where(condition)
    table = small_side(table)

    def spread(df: DataFrame, own: str, own_count: str, other: str, other_count: str) -> DataFrame:
        row = F.xxhash64(*[F.col(c) for c in df.columns if c not in keys], F.spark_partition_id())
        salted = df.join(table, keys, "left").withColumn(
            own, F.coalesce(F.pmod(row, F.col(own_count)), F.lit(0)).cast("int"))
        repeats = F.sequence(F.lit(0), F.coalesce(F.col(other_count), F.lit(1)) - 1)
        return salted.withColumn(other, F.explode(repeats)).drop("_n", "_m")

    repeated = spread(right, "_rs", "_m", "_ls", "_n")
    repeated = repeated if hint is None else repeated.hint(hint)
    joined = spread(left, "_ls", "_n", "_rs", "_m").join(repeated, [*keys, "_ls", "_rs"]).drop("_ls", "_rs")
    return joined if condition is None else joined.where(condition)


def bind_columns(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The columns of ``other`` beside those of ``df``, row by row through ``key``, never by position.

    Every key must occur once on either side and on both, or it is an error: a missing prediction
    must not shift or drop a row. One aggregation over the keys checks this.
    """
    sides = df.select(F.col(key).alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        other.select(F.col(key).alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    wrong = sides.groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(
        (F.col("a") != 1) | (F.col("b") != 1) | F.col("k").isNull())
    bad = wrong.limit(3).collect()
    if bad:
        raise ValueError(f"keys that are missing or double, with their rows on both sides: {[tuple(r) for r in bad]}")
    extra = other.select(F.col(key).alias("_key"), *[c for c in other.columns if c != key])
    return df.join(extra, F.col(key) == F.col("_key")).drop("_key")


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str,
               width: float) -> DataFrame:
    """Pairs with ``low <= value <= high``, both ends included.

    Every range is listed under the fixed-width cells it touches and a point looks up
    its own cell, so no row is compared with all ranges. ``width`` near the usual range
    length keeps the list short. A value on a shared bound matches both ranges.
    """
    cell = F.floor(F.col(value) / width)
    cells = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    listed = (ranges.where(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(cells)))
    inside = F.col(value).between(F.col(low), F.col(high))
    return (points.withColumn("_cell", cell).join(small_side(listed), "_cell")
            .where(inside).drop("_cell"))
