"""File sinks. Every writer keeps one output file per task; nothing is merged on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import OrderItem, first_rows


def write_delimited_dir(df: DataFrame, path: str, sep: str = ",", header: bool = False,
                        null_value: str = "\\N") -> None:
    """Delimited files that replace the folder."""
    (df.write.mode("overwrite").option("sep", sep).option("header", header)
     .option("nullValue", null_value).csv(path))


def write_csv_frame(df: DataFrame, path: str) -> None:
    """CSV with a header line in each file and no row numbers."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value per line; NULL gives no line."""
    lines = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value"))
    lines.write.mode("overwrite").text(path)


def export_topk(df: DataFrame, ids: Sequence[str], order: Sequence[OrderItem], k: int, path: str) -> None:
    """Ids of the best ``k`` rows of ``order`` as headerless CSV."""
    first_rows(df, order, k).select(*ids).write.mode("overwrite").csv(path)
