"""Column lists, names and NULL handling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def normalize_names(df: DataFrame, case: str | None = "upper") -> DataFrame:
    """Rename every column to upper or lower case; ``None`` keeps the names."""
    if case is None:
        return df
    if case not in ("upper", "lower"):
        raise ValueError("case must be 'upper', 'lower' or None")
    names = [getattr(c, case)() for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError("column names collide after changing case")
    return df.toDF(*names)


def update_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """Set ``column`` where ``condition`` holds; a NULL condition keeps the old value."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def apply_to_columns(df: DataFrame, outputs: dict[str, str],
                     transform: Callable[[Column], Column]) -> DataFrame:
    """Add ``transform(source)`` as a new column for every ``output: source`` pair."""
    return df.select("*", *[transform(F.col(s)).alias(o) for o, s in outputs.items()])


def null_report(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, nulls)`` for every column, from one pass over the data."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "nulls")


def any_null(df: DataFrame) -> bool:
    """True when a row holds a NULL; reading stops at the first one."""
    condition = F.lit(False)
    for c in df.columns:
        condition = condition | F.col(c).isNull()
    return not df.where(condition).isEmpty()


def any_null_by(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group, does a row hold a NULL? One ``<column>_missing`` for each column, from one aggregation."""
    return df.groupBy(*group).agg(*[F.bool_or(F.col(c).isNull()).alias(f"{c}_missing") for c in columns])


def list_columns(spark: SparkSession, table: str) -> DataFrame:
    """Rows ``(position, column_name, type_name)`` of a table or view."""
    fields = spark.table(table).schema.fields
    rows = [(i + 1, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "position int, column_name string, type_name string")


SKEW_KURT = re.compile(r"(^|_)(kurt|sk)(_|$)")


@dataclass
class ColumnGroups:
    """Columns of a wide table by role."""

    index: list[str]
    binary: list[str]
    categorical: list[str]
    numeric: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @property
    def kept(self) -> list[str]:
        return self.index + self.binary + self.categorical + self.numeric


def column_groups(columns: Sequence[str], index: Iterable[str], binary: Iterable[str] = (),
                  categorical: Iterable[str] = (), bad: Iterable[str] = (),
                  drop_skew_kurt: bool = True) -> ColumnGroups:
    """Split names into index, binary, categorical and numeric, in table order.

    Names in ``bad``, and those of skewness or kurtosis measures, are dropped; index
    columns are kept even then. What is in no list is numeric.
    """
    index, binary, categorical, bad = set(index), set(binary), set(categorical), set(bad)
    if drop_skew_kurt:
        bad |= {c for c in columns if SKEW_KURT.search(c)}
    groups = ColumnGroups([], [], [])
    for c in columns:
        if c in index:
            groups.index.append(c)
        elif c in bad:
            groups.dropped.append(c)
        elif c in binary:
            groups.binary.append(c)
        elif c in categorical:
            groups.categorical.append(c)
        else:
            groups.numeric.append(c)
    return groups


def guess_key(columns: Sequence[str], wanted: str | None = None) -> str:
    """Distribution key: the wanted column, else SUBS_ID, MSISDN or the first column.

    A wanted name that does not exist falls back to the first column.
    """
    if wanted is not None:
        return wanted if wanted in columns else columns[0]
    for name in ("SUBS_ID", "MSISDN"):
        if name in columns:
            return name
    return columns[0]
