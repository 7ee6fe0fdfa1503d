"""Grouped summaries. All of them combine partial results before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.joins import with_group_values
from larkfield.operators.ranking import next_values


def group_max_ordered(df: DataFrame, group: Sequence[str], value: str, output: str) -> DataFrame:
    """Largest value per group, largest groups first."""
    out = df.groupBy(*group).agg(F.max(value).alias(output))
    return out.orderBy(F.col(output).desc_nulls_last(), *group)


def skew_report(df: DataFrame, group: Sequence[str], unit: str, size: str, units: int,
                scale: float = 1024.0 ** 3) -> DataFrame:
    """How unevenly each table lies over its units (partitions, nodes).

    ``current`` is the space used, ``skewed`` what it would cost if every unit were as
    full as the fullest, ``wasted`` the difference, ``skew_unit`` the fullest unit (the
    highest number when several are), and two skew factors.
    """
    top = F.max(F.struct(size, unit))
    totals = df.groupBy(*group).agg(
        (F.sum(size) / scale).cast("decimal(9,2)").alias("current"),
        (F.max(size) / scale * units).cast("decimal(9,2)").alias("skewed"),
        top[unit].alias("skew_unit"), F.max(size).alias("_max"), F.avg(size).alias("_avg"))
    return totals.select(
        *group, "current", "skewed", (F.col("skewed") - F.col("current")).alias("wasted"), "skew_unit",
        (F.col("_max") / F.nullif("_avg", F.lit(0.0))).cast("decimal(5,2)").alias("skew_factor"),
        (100 - F.col("_avg") / F.nullif("_max", F.lit(0)) * 100).cast("decimal(3,0)")
        .alias("skew_percent")).orderBy(F.col("wasted").desc_nulls_last(), *group)


def mark_group_maximum(df: DataFrame, group: Sequence[str], value: str, output: str) -> DataFrame:
    """True on rows that hold the largest value of their group.

    The maxima are aggregated and joined back; a window would sort a hot group in one task.
    """
    peaks = df.groupBy(*group).agg(F.max(value).alias("_peak"))
    joined = with_group_values(df, peaks, group)
    return joined.withColumn(output, F.coalesce(F.col(value) == F.col("_peak"), F.lit(False))
                             ).drop("_peak")


def value_counts(df: DataFrame, columns: Sequence[str], output: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(output))


def group_mean(df: DataFrame, group: Sequence[str], value: str, output: str,
               nulls: str = "ignore") -> DataFrame:
    """Mean per group; ``nulls='all'`` makes a group with any NULL give NULL."""
    if nulls not in ("ignore", "all"):
        raise ValueError("nulls must be 'ignore' or 'all'")
    mean: Column = F.avg(value)
    if nulls == "all":
        mean = F.when(F.count(F.lit(1)) == F.count(value), mean)
    return df.groupBy(*group).agg(mean.alias(output))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, NULLs, smallest, mean and largest value, in one pass."""
    stats = df.agg(*[F.struct(
        F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(c).isNull()).alias("nulls"), F.min(c).cast("double").alias("smallest"),
        F.avg(c).alias("mean"), F.max(c).cast("double").alias("largest")).alias(c) for c in columns])
    return stats.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def conditional_min_max(df: DataFrame, condition: Column, value: str) -> DataFrame:
    """One row: smallest and largest value among rows that meet the condition."""
    chosen = F.when(condition, F.col(value))
    return df.agg(F.min(chosen).alias("low"), F.max(chosen).alias("high"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """One row: positives, negatives and negatives per positive."""
    y = F.col(label)
    counts = df.agg(F.count_if(y == 1).alias("positives"), F.count_if(y != 1).alias("negatives"))
    return counts.withColumn("pos_weight", F.col("negatives") / F.nullif("positives", F.lit(0)))


def first_of_each(df: DataFrame, value: str, order: str, columns: Mapping[str, str]) -> DataFrame:
    """For each distinct value, the columns of its first row."""
    return df.groupBy(value).agg(F.min(order).alias(order),
                                 *[F.min_by(c, order).alias(o) for o, c in columns.items()])


def stop_pairs(stops: DataFrame, route: str, order: str, columns: Sequence[str],
               tie: Sequence[str] = (), n_ranges: int | None = None) -> DataFrame:
    """Consecutive stops of each route: every column beside its ``next_`` value."""
    keys = [(order, "asc"), *[(t, "asc") for t in tie]]
    return next_values(stops, keys, [route], {f"next_{c}": c for c in columns}, n_ranges)


def route_totals(legs: DataFrame, route: str, order: str, duration: str, distance: str, wait: str,
                 tie: Sequence[str] = ()) -> DataFrame:
    """Totals per route from its legs in order.

    Each leg starts at a stop with a waiting time in half hours. The first stop does not
    wait; the return leg is left out of ``proper_distance``. Duration is in hours.
    """
    key = F.struct(order, *tie)
    ends = legs.groupBy(route).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    marked = with_group_values(legs, ends, [route])
    waiting = F.when(key != F.col("_first"), F.col(wait) * 30 * 60).otherwise(0)
    inner = F.when(key != F.col("_last"), F.col(distance)).otherwise(0)
    return marked.groupBy(route).agg(
        F.sum(distance).alias("distance"), F.sum(inner).alias("proper_distance"),
        ((F.sum(duration) + F.sum(waiting)) / 3600.0).alias("duration"),
        F.count(F.lit(1)).alias("legs"))


def node_stats(stations: DataFrame, traffic: DataFrame, edges: DataFrame) -> DataFrame:
    """Per station: traffic, users and number of connections.

    ``stations(id, name, line)``, ``traffic(name, line, total_traffic, user_count)``,
    ``edges(station1, station2)``; a station without traffic or edges counts 0.
    """
    load = traffic.groupBy("name", "line").agg(F.sum("total_traffic").alias("total_traffic"),
                                               F.sum("user_count").alias("user_count"))
    ends = edges.select(F.explode(F.array("station1", "station2")).alias("id"))
    degree = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return (stations.join(load, ["name", "line"], "left").join(degree, "id", "left")
            .select("id", "name", "line", *[F.coalesce(F.col(c), F.lit(0)).alias(c)
                                            for c in ("total_traffic", "user_count", "degree")]))
