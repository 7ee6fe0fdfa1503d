"""Wide and long forms, sets of rows, ordered lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import ordered_chunks


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "var_name",
                 value: str = "var_value", as_type: str = "string") -> DataFrame:
    """One row per named column; NULL values are kept and all values share one type."""
    typed = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return typed.unpivot(list(ids), list(columns), name, value)


def wide_to_map(df: DataFrame, ids: Sequence[str], columns: Sequence[str], output: str = "var_map",
                as_type: str = "string") -> DataFrame:
    """The named columns as one map column."""
    pairs = [x for c in columns for x in (F.lit(c), F.col(c).cast(as_type))]
    return df.select(*ids, F.create_map(*pairs).alias(output))


def explode_map(df: DataFrame, ids: Sequence[str], column: str, name: str = "var_name",
                value: str = "var_value") -> DataFrame:
    return df.select(*ids, F.explode(column).alias(name, value))


def union_all(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, columns matched by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def collect_ordered(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], value: str,
                    name: str, chunk: int = 10_000) -> DataFrame:
    """Ordered list per group, split into numbered chunks when a group is long."""
    return ordered_chunks(df, group, order, value, name, chunk)
