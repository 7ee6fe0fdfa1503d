"""Validated table loads."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.functions.columns import any_null, guess_key, normalize_names
from larkfield.operators.joins import with_group_values
from larkfield.session import checkpointed, small_side

MAX_TEXT = 3000
FIELD_WIDTH = 255

# Warehouse type of each column type.
WAREHOUSE_TYPES = {
    T.ShortType: "SMALLINT", T.IntegerType: "INTEGER", T.LongType: "BIGINT",
    T.FloatType: "FLOAT", T.DoubleType: "FLOAT",
}


def longest_text(df: DataFrame) -> int:
    """Length of the longest text over all text columns; 0 without any."""
    lengths = [F.max(F.length(f.name)) for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not lengths:
        return 0
    longest = lengths[0] if len(lengths) == 1 else F.greatest(*lengths)
    return df.agg(longest.alias("n")).first()["n"] or 0


def type_map(df: DataFrame, max_text: int = MAX_TEXT) -> dict[str, str]:
    """Warehouse type per column; text columns share the length of the longest text.

    Text longer than ``max_text`` and unknown types are errors.
    """
    unknown = [f.name for f in df.schema
               if not isinstance(f.dataType, (T.StringType, *WAREHOUSE_TYPES))]
    if unknown:
        raise TypeError(f"no warehouse type for columns {unknown}")
    longest = longest_text(df)
    if longest > max_text:
        raise ValueError(f"a text of {longest} characters is over the limit of {max_text}")
    return {f.name: WAREHOUSE_TYPES.get(type(f.dataType), f"VARCHAR({longest})") for f in df.schema}


def type_table(df: DataFrame, max_text: int = MAX_TEXT) -> DataFrame:
    """The type map as rows ``(column_name, sql_type)``."""
    return df.sparkSession.createDataFrame(list(type_map(df, max_text).items()),
                                           "column_name string, sql_type string")


def split_dates(df: DataFrame) -> DataFrame:
    """Replace each date or time column by ``_year``, ``_month``, ``_day`` at the end."""
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    dates = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    parts = []
    for c in dates:
        parts += [F.year(c).alias(f"{c}_year"), F.month(c).alias(f"{c}_month"),
                  F.dayofmonth(c).alias(f"{c}_day")]
    return df.select(*[c for c in df.columns if c not in dates], *parts)


def prepare_load(df: DataFrame, check_nulls: bool = True) -> DataFrame:
    """Upper-case names and split dates; any NULL is an error."""
    if check_nulls and any_null(df):
        raise ValueError("NULL values are not supported here; fill them before loading")
    return split_dates(normalize_names(df, "upper"))


def replace_table(df: DataFrame, table: str, key: str | None = None,
                  buckets: int | None = None) -> DataFrame:
    """Check, prepare and write a table anew, clustered by its distribution key.

    Within a bucketed write a hot key stays whole in its bucket, as bucketing demands;
    without ``buckets`` the rows keep the partitions they have, so none is overloaded.
    """
    ready = prepare_load(df)
    type_map(ready)
    chosen = guess_key(ready.columns, key)
    writer = ready.write.mode("overwrite")
    if buckets:
        writer = writer.bucketBy(buckets, chosen)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def append_columns(df: DataFrame, table: str, columns: Sequence[str]) -> None:
    """Append the chosen columns, in the order of the table's own columns."""
    df.select(*columns).write.insertInto(table)


@dataclass
class StagedLoad:
    """A bulk load: rows accepted, rows refused by format, rows refused as duplicates."""

    loaded: DataFrame
    errors_1: DataFrame
    errors_2: DataFrame


def staged_bulk_load(spark: SparkSession, path: str, columns: Sequence[str], key: Sequence[str] = (),
                     sep: str = "\t", quotes: bool = False, skip_header: bool = False,
                     width: int = FIELD_WIDTH) -> StagedLoad:
    """Read delimited text, every field at most ``width`` characters.

    ``errors_1`` holds the text of rows with too few or too many fields or a field that is
    too long. ``errors_2`` holds what else came for a key already loaded, one row per
    distinct line with its number of ``copies``. Of the lines of one key the smallest is
    loaded, so the outcome does not depend on row order. Every line is in exactly one frame, but for
    the first line of each file with ``skip_header``. The files are read once: the three frames
    come from the stored lines.
    """
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = checkpointed(spark.read.text(path).select(F.col("value").alias("_line"), place.alias("_at")))
    if skip_header:
        # numbers rise along a file's first block, so its smallest is the first line
        heads = lines.where("_at.file_block_start = 0").groupBy("_at.file_path").agg(F.min("_at.n").alias("_head"))
        lines = lines.join(small_side(heads.select("_head")), F.col("_at.n") == F.col("_head"), "left_anti")
    lines = lines.select("_line")
    if quotes:
        schema = ", ".join(f"`{c}` string" for c in columns)
        rows = lines.select("_line", F.from_csv("_line", schema, {"sep": sep}).alias("_r"))
        rows = rows.select("_line", "_r.*")
        outside_quotes = _literal_pattern(sep) + r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
        complete = F.size(F.split("_line", outside_quotes)) == len(columns)
    else:
        parts = F.split("_line", _literal_pattern(sep))
        rows = lines.select("_line", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(columns)])
        complete = F.size(parts) == len(columns)
    short = F.lit(True)
    for c in columns:
        short = short & (F.coalesce(F.length(c), F.lit(0)) <= width)
    rows = rows.withColumn("_ok", F.coalesce(complete & short, F.lit(False)))
    good = rows.where("_ok").select("_line", *columns)
    bad = rows.where("NOT _ok").select(F.col("_line").alias("line"))
    if not key:
        none = good.where(F.lit(False)).select(*columns, F.lit(0).cast("long").alias("copies"))
        return StagedLoad(good.select(*columns), bad, none)
    tallies = good.groupBy("_line", *columns).agg(F.count("*").alias("_n"))
    first = tallies.groupBy(*key).agg(F.min("_line").alias("_first"))
    marked = with_group_values(tallies, first, key)
    is_first = F.col("_line") == F.col("_first")
    loaded = marked.where(is_first).select(*columns)
    copies = F.col("_n") - F.when(is_first, 1).otherwise(0)
    extra = marked.select(*columns, copies.alias("copies")).where("copies > 0")
    return StagedLoad(loaded, bad, extra)


def _literal_pattern(sep: str) -> str:
    """The separator as a regular expression that matches only itself."""
    return r"\Q" + sep + r"\E"
