"""Parameterised SQL as a frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkfield.functions.columns import normalize_names


def sql_select(spark: SparkSession, text: str, params: Sequence[Any] | Mapping[str, Any] | None = None,
               infer_types: bool = True, case: str | None = "upper") -> DataFrame:
    """Run SQL with ``?`` (sequence) or ``:name`` (mapping) parameters.

    ``infer_types=False`` gives every column as text. An empty result keeps its columns.
    """
    if not text or not text.strip():
        raise ValueError("the query is empty")
    df = spark.sql(text, args=params) if params else spark.sql(text)
    if not infer_types:
        df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])
    return normalize_names(df, case)


def preview(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """The first rows in a fixed order."""
    return df.orderBy(*order).limit(rows)


def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns)."""
    return df.count(), len(df.columns)


def dtypes(df: DataFrame) -> dict[str, str]:
    return dict(df.dtypes)
