"""File sources: Parquet trees, delimited text, positional text."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.functions.columns import ColumnGroups
from larkfield.functions.text import decode_flag

BAD_ROW = "_bad_row"


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table or view."""
    return spark.table(name)


def scan_partitioned(spark: SparkSession, root: str, condition: Column | str | None = None) -> DataFrame:
    """A partitioned Parquet tree; conditions on partition columns prune folders."""
    df = spark.read.parquet(root)
    return df if condition is None else df.where(condition)


def read_delimited(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
                   sep: str = ",", header: bool = True, null_value: str | None = None) -> DataFrame:
    """Delimited text with a given schema; no pass over the data to guess types."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    return reader.csv(path)


def names_from_frame(names: DataFrame, column: str = "col_name") -> list[str]:
    """Column names listed in a small frame, in its row order."""
    return [r[0] for r in names.select(column).collect()]


def import_with_names(spark: SparkSession, path: str | Sequence[str],
                      names: Sequence[str] | None = None, names_file: str | None = None,
                      sep: str = ",", types: Mapping[str, str] | None = None,
                      null_value: str = "\\N") -> DataFrame:
    """Headerless text under the given names: a list, or a CSV with a ``col_name`` column.

    Columns without an entry in ``types`` are read as text.
    """
    if names_file is not None:
        names = names_from_frame(spark.read.option("header", True).csv(names_file))
    if not names:
        raise ValueError("column names are not defined")
    types = types or {}
    schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
    return read_delimited(spark, path, schema, sep, header=False, null_value=null_value)


def read_positional_text(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str],
                         groups: ColumnGroups, sep: str = "\x01", null_value: str = "\\N",
                         numeric_type: str = "double", strict_flags: bool = False) -> DataFrame:
    """Headerless text whose columns are known by position.

    Index and categorical columns come as text, numeric ones as ``numeric_type``; binary
    columns are decoded as flags, so ``\\N`` in them is 0 and in all others NULL. Dropped
    columns are never parsed into the result. Rows that do not fit the schema keep their
    text in ``_bad_row`` instead of vanishing.
    """
    numeric, binary = set(groups.numeric), set(groups.binary)
    fields = [T.StructField(c, T.StringType()) for c in columns]
    fields.append(T.StructField(BAD_ROW, T.StringType()))
    raw = (spark.read.schema(T.StructType(fields)).option("sep", sep).option("mode", "PERMISSIVE")
           .option("quote", "").option("columnNameOfCorruptRecord", BAD_ROW).csv(path))
    selected, unreadable = [], F.lit(False)
    for c in columns:
        if c not in groups.kept:
            continue
        value = F.nullif(F.col(c), F.lit(null_value))
        if c in binary:
            value = decode_flag(F.col(c), strict=strict_flags)
        elif c in numeric:
            number = value.try_cast(numeric_type)
            unreadable = unreadable | (value.isNotNull() & number.isNull())
            value = number
        selected.append(value.alias(c))
    kept = F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    bad = F.coalesce(F.col(BAD_ROW), F.when(unreadable, kept))
    return raw.select(*selected, bad.alias(BAD_ROW))


def set_aside(df: DataFrame, marker: str = BAD_ROW) -> tuple[DataFrame, DataFrame]:
    """Split into (good rows without the marker column, bad rows)."""
    return df.where(F.col(marker).isNull()).drop(marker), df.where(F.col(marker).isNotNull())


def from_columns(spark: SparkSession, data: Mapping[str, Iterable] | pd.DataFrame,
                 schema: T.StructType | str | None = None) -> DataFrame:
    """A frame from in-memory columns or a pandas frame."""
    frame = data if isinstance(data, pd.DataFrame) else pd.DataFrame(dict(data))
    return spark.createDataFrame(frame, schema) if schema else spark.createDataFrame(frame)
