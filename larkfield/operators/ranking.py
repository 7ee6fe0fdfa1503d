"""Ranks, running sums and neighbours over data too large for one sorted task.

``Window.orderBy`` without a partition key moves every row to one task, and
``Window.partitionBy(key)`` does the same for a key that holds a third of the rows.
Here rows are spread by ranges of the whole sort key (group, order columns and
tie-breaker together) and stored, with the number of their range beside them. The
window runs inside a range and the totals of earlier ranges are added. The stored
numbers never change, so a recomputed task puts a row where it was. How rows are
spread decides only how even the work is; the plan is the same at every size.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.operators.joins import hot_keys
from larkfield.session import checkpointed, small_side

BUCKET = "_range"
_ROWS_PER_RANGE = 2_000_000

OrderItem = tuple[str, str]


@dataclass
class RangedFrame:
    """A stored frame whose rows carry the number of their sort-key range.

    ``counts`` has the rows of each range, ``divided`` the groups that lie in several.
    """

    df: DataFrame
    group: list[str]
    order: list[OrderItem]
    counts: dict[int, int]
    divided: list[tuple]

    @property
    def n_rows(self) -> int:
        return sum(self.counts.values())

    @property
    def n_ranges(self) -> int:
        return len(self.counts)

    def sort_columns(self) -> list[Column]:
        return [_sort_column(item) for item in self.order]


def _sort_column(item: OrderItem) -> Column:
    name, direction = item
    column = F.col(name)
    return column.desc_nulls_last() if direction == "desc" else column.asc_nulls_last()


def range_split(df: DataFrame, order: Sequence[OrderItem], group: Sequence[str] = (),
                n_ranges: int | None = None) -> RangedFrame:
    """Store the rows with a range number along ``group`` then ``order``.

    ``order`` must end in a column that makes the key unique, or ties stay arbitrary.
    There are as many ranges as the session has shuffle partitions, or ``n_ranges``. Spark
    samples the sort key and shuffles once; everything after reads the stored rows.
    """
    group, order = list(group), list(order)
    n = n_ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [_sort_column(i) for i in [*((g, "asc") for g in group), *order]]
    stored = checkpointed(df.repartitionByRange(n, *keys).withColumn(BUCKET, F.spark_partition_id()))
    ends = []
    if group:  # the first and the last group of a range, in sort order
        key = F.struct(*[part for i, g in enumerate(group) for part in (F.col(g).isNull().alias(f"n{i}"), F.col(g).alias(f"g{i}"))])
        ends = [F.min(key).alias("low"), F.max(key).alias("high")]
    rows = sorted(stored.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), *ends).collect(), key=lambda r: r[BUCKET])  # a row per range
    value = lambda key: tuple(key[f"g{i}"] for i in range(len(group)))
    divided = [value(one["high"]) for one, two in zip(rows, rows[1:]) if value(one["high"]) == value(two["low"])] if group else []
    return RangedFrame(stored, group, order, {r[BUCKET]: r["n"] for r in rows}, list(dict.fromkeys(divided)))


def _of_divided(ranged: RangedFrame) -> DataFrame:
    """The rows of groups that lie in several ranges; all rows if there are no groups."""
    if not ranged.group:
        return ranged.df
    fields = [T.StructField(f"_d{i}", ranged.df.schema[g].dataType) for i, g in enumerate(ranged.group)]
    divided = ranged.df.sparkSession.createDataFrame(ranged.divided, T.StructType(fields))
    match = [F.col(g).eqNullSafe(F.col(f"_d{i}")) for i, g in enumerate(ranged.group)]
    return ranged.df.join(F.broadcast(divided), match, "left_semi")  # at most one group per range


def _carried_totals(ranged: RangedFrame, sums: Mapping[str, str]) -> DataFrame | None:
    """Count, sums and numbers of values of earlier ranges, for groups that lie in several.

    At most two rows per range, however many groups there are.
    """
    if ranged.n_ranges <= 1 or (ranged.group and not ranged.divided):
        return None
    aggregates = [F.count(F.lit(1)).alias("_carried")]
    for name, c in sums.items():
        aggregates += [F.sum(c).alias(f"_carried_sum_{name}"), F.count(c).alias(f"_carried_n_{name}")]
    totals = _of_divided(ranged).groupBy(BUCKET, *ranged.group).agg(*aggregates)
    earlier = Window.partitionBy(*(ranged.group or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in totals.columns if c.startswith("_carried")]
    return totals.select(F.col(BUCKET).alias("_b"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(ranged.group)], *carried)


def _hot_groups(df: DataFrame, group: Sequence[str], hot_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Split off the rows of groups too large for one task: (other rows, rows of hot groups)."""
    hot = hot_keys(df, group, hot_rows)
    if hot.isEmpty():
        return df, None
    keys = small_side(hot.select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(group)]))
    match = [F.col(g).eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(group)]
    return df.join(keys, match, "left_anti"), df.join(keys, match, "left_semi")


def running(df: DataFrame, order: Sequence[OrderItem], group: Sequence[str] = (),
            rank: str | None = "rank", sums: Mapping[str, str] | None = None,
            n_ranges: int | None = None, ranged: RangedFrame | None = None,
            hot_rows: int = _ROWS_PER_RANGE) -> DataFrame:
    """Row number and running sums along ``order``, restarting per ``group``.

    ``sums`` maps an output column to the input column to add up. Groups of at most
    ``hot_rows`` rows take one shuffle by group; larger ones are cut into ranges.
    """
    sums = dict(sums or {})
    if group and ranged is None and n_ranges is None:
        cold, hot = _hot_groups(df, group, hot_rows)
        window = Window.partitionBy(*group).orderBy(*[_sort_column(i) for i in order])
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = [F.row_number().over(window).cast("long").alias(rank)] if rank else []
        columns += [F.sum(source).over(window).alias(name) for name, source in sums.items()]
        out = cold.select(*df.columns, *columns)
        if hot is None:
            return out
        return out.unionByName(running(hot, order, group, rank, sums, ranged=range_split(hot, order, group)))
    ranged = ranged or range_split(df, order, group, n_ranges)
    out = ranged.df
    window = Window.partitionBy(BUCKET, *ranged.group).orderBy(*ranged.sort_columns())
    window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = _carried_totals(ranged, sums)
    if carried is not None:
        match = out[BUCKET] == carried["_b"]
        for i, g in enumerate(ranged.group):
            match = match & out[g].eqNullSafe(carried[f"_g{i}"])
        out = out.join(F.broadcast(carried), match, "left")
    base = lambda name: F.coalesce(F.col(name), F.lit(0)) if carried is not None else F.lit(0)
    columns = [F.col(c) for c in df.columns]
    if rank:
        columns.append((F.row_number().over(window) + base("_carried")).cast("long").alias(rank))
    for name, source in sums.items():
        # NULL until the group has shown its first value, as a plain window has it
        seen = F.count(source).over(window) + base(f"_carried_n_{name}") > 0
        columns.append(F.when(seen, F.coalesce(F.sum(source).over(window), F.lit(0)) + base(f"_carried_sum_{name}")).alias(name))
    return out.select(*columns)


def row_numbers(df: DataFrame, order: Sequence[OrderItem], name: str = "rank",
                group: Sequence[str] = (), n_ranges: int | None = None) -> DataFrame:
    """``ROW_NUMBER`` over the whole frame or per group, without a single-task sort."""
    return running(df, order, group, rank=name, n_ranges=n_ranges)


def quantile_buckets(df: DataFrame, order: Sequence[OrderItem], buckets: int = 99,
                     name: str = "bucket_value", n_ranges: int | None = None) -> DataFrame:
    """Bucket 1..``buckets`` by rank: ``((rank - 1) * buckets) div rows + 1``.

    Bucket 1 holds the first rows of ``order``. This is not ``ntile``: with fewer rows
    than buckets some bucket numbers stay unused.
    """
    ranged = range_split(df, order, (), n_ranges)
    ranked = running(df, order, rank="_rank", ranged=ranged)
    bucket = F.expr(f"((_rank - 1) * {int(buckets)}L) div {max(ranged.n_rows, 1)}L + 1")
    return ranked.select(*df.columns, bucket.alias(name))


def first_rows(df: DataFrame, order: Sequence[OrderItem], k: int, n_ranges: int | None = None) -> DataFrame:
    """The first ``k`` rows of ``order``, in that order, whatever ``k`` is.

    Ranges before the one that holds row ``k`` are taken whole, and only that one is ranked;
    each range is sorted where it lies, so the rows come out in order without one sorting task.
    """
    ranged = range_split(df, order, (), n_ranges)
    before, last = 0, -1
    for number, count in sorted(ranged.counts.items()):
        if before + count >= k:
            last = number
            break
        before += count
    else:  # fewer rows than asked for: all ranges whole
        last = max(ranged.counts, default=-1) + 1
    inside = Window.partitionBy(BUCKET).orderBy(*ranged.sort_columns())
    whole = ranged.df.where(F.col(BUCKET) < last)
    edge = ranged.df.where(F.col(BUCKET) == last).withColumn("_r", F.row_number().over(inside)).where(F.col("_r") <= k - before)
    parts = [p.sortWithinPartitions(*ranged.sort_columns()).select(*df.columns) for p in (whole, edge)]
    return parts[0].unionByName(parts[1])


def next_values(df: DataFrame, order: Sequence[OrderItem], group: Sequence[str],
                columns: Mapping[str, str], n_ranges: int | None = None,
                hot_rows: int = _ROWS_PER_RANGE) -> DataFrame:
    """``LEAD`` by one row inside each group; a hot group spans several tasks.

    ``columns`` maps an output column to the column of the following row. In a hot group
    the last row of a range takes its value from the first row of the next range that
    holds rows of the group.
    """
    if group and n_ranges is None:
        cold, hot = _hot_groups(df, group, hot_rows)
        window = Window.partitionBy(*group).orderBy(*[_sort_column(i) for i in order])
        out = cold.select(*df.columns, *[F.lead(c).over(window).alias(o) for o, c in columns.items()])
        if hot is None:
            return out
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return out.unionByName(next_values(hot, order, group, columns, max(2, n)))
    ranged = range_split(df, order, group, n_ranges)
    window = Window.partitionBy(BUCKET, *ranged.group).orderBy(*ranged.sort_columns())
    following = F.struct(*[F.col(c) for c in columns.values()])
    inside = ranged.df.select("*", F.lead(following).over(window).alias("_next"))
    if ranged.n_ranges <= 1 or (ranged.group and not ranged.divided):
        return inside.select(*df.columns, *[F.col("_next")[c].alias(o) for o, c in columns.items()])
    # First row per (range, divided group): at most two rows per range.
    firsts = (_of_divided(ranged).withColumn("_k", F.row_number().over(window)).where("_k = 1")
              .select(BUCKET, *ranged.group, *dict.fromkeys(columns.values())))
    across = Window.partitionBy(*(ranged.group or [F.lit(0)])).orderBy(BUCKET)
    carried = firsts.select(
        F.col(BUCKET).alias("_b"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(ranged.group)],
        F.lead(following).over(across).alias("_carried"))
    match = inside[BUCKET] == carried["_b"]
    for i, g in enumerate(ranged.group):
        match = match & inside[g].eqNullSafe(carried[f"_g{i}"])
    joined = inside.join(F.broadcast(carried), match, "left")
    following = F.coalesce(F.col("_next"), F.col("_carried"))
    return joined.select(*df.columns, *[following[c].alias(o) for o, c in columns.items()])


def ordered_chunks(df: DataFrame, group: Sequence[str], order: Sequence[OrderItem], value: str,
                   name: str = "values", chunk: int = 10_000,
                   n_ranges: int | None = None) -> DataFrame:
    """Ordered list of ``value`` per group: always (group, ``chunk_no``, list) rows.

    Row ``chunk_no`` holds the entries from ``chunk_no * chunk`` on, at most ``chunk`` of them,
    so no list outgrows a task and no entry is lost.
    """
    placed = running(df.select(*dict.fromkeys([*group, *[n for n, _ in order], value])),
                     order, group, rank="_pos", n_ranges=n_ranges)
    placed = placed.withColumn("chunk_no", F.expr(f"(_pos - 1) div {int(chunk)}L"))
    pairs = F.array_sort(F.collect_list(F.struct("_pos", F.col(value).alias("_v"))))
    return (placed.groupBy(*group, "chunk_no")
            .agg(F.transform(pairs, lambda p: p["_v"]).alias(name)))


def values_at_ranks(df: DataFrame, column: str, ranks: Sequence[int],
                    n_ranges: int | None = None) -> dict[int, float]:
    """The values at the given ascending ranks (1 = smallest); a few rows reach the driver."""
    # Equal values collapse first, so a value that fills a third of the rows is one row here.
    tallied = df.groupBy(column).agg(F.count("*").alias("_c"))
    summed = running(tallied, [(column, "asc")], rank=None, sums={"_to": "_c"}, n_ranges=n_ranges)
    wanted = df.sparkSession.createDataFrame([(r,) for r in ranks], "_r long")
    inside = (F.col("_r") <= F.col("_to")) & (F.col("_r") > F.col("_to") - F.col("_c"))
    found = summed.join(F.broadcast(wanted), inside).select("_r", column)
    return {r["_r"]: r[column] for r in found.collect()}


__all__ = ["RangedFrame", "first_rows", "next_values", "ordered_chunks",
           "quantile_buckets", "range_split", "row_numbers", "running", "values_at_ranks"]
