"""Database sources and sinks over Spark's JDBC connector."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, query: str | None = None, table: str | None = None,
                 properties: Mapping[str, str] | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Reader options for one query or one table."""
    if (query is None) == (table is None):
        raise ValueError("give either a query or a table")
    source = {"query": query} if query is not None else {"dbtable": table}
    return {"url": url, "fetchsize": str(fetch_size), **source, **dict(properties or {})}


def jdbc_read(spark: SparkSession, url: str, query: str | None = None, table: str | None = None,
              properties: Mapping[str, str] | None = None, require_rows: bool = False) -> DataFrame:
    """A query or table of a database; ``require_rows`` fails on an empty result.

    One connection reads it all: for large tables use :func:`jdbc_read_partitioned`.
    """
    df = spark.read.format("jdbc").options(**jdbc_options(url, query, table, properties)).load()
    if require_rows and df.isEmpty():
        raise ValueError("the query returned no rows")
    return df


def jdbc_read_partitioned(spark: SparkSession, url: str, table: str, column: str, lower: int,
                          upper: int, partitions: int,
                          properties: Mapping[str, str] | None = None) -> DataFrame:
    """A table read by several tasks, split by ranges of a numeric key.

    Rows outside ``lower..upper`` are read too, by the first and last task.
    """
    if partitions < 1 or upper <= lower:
        raise ValueError("need partitions >= 1 and lower < upper")
    return spark.read.jdbc(url, table, column=column, lowerBound=lower, upperBound=upper,
                           numPartitions=partitions, properties=dict(properties or {}))


def import_table(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int,
                 partitions: int, target: str, properties: Mapping[str, str] | None = None) -> None:
    """Copy a table to Parquet; the target folder must not exist yet."""
    df = jdbc_read_partitioned(spark, url, table, column, lower, upper, partitions, properties)
    df.write.mode("errorifexists").parquet(target)


def jdbc_write(df: DataFrame, url: str, table: str, mode: str = "append", batch_size: int = 10_000,
               partitions: int | None = None, properties: Mapping[str, str] | None = None) -> None:
    """Append rows to a database table; ``partitions`` limits the open connections."""
    rows = df if partitions is None else df.coalesce(partitions)
    rows.write.jdbc(url, table, mode=mode,
                    properties={"batchsize": str(batch_size), **dict(properties or {})})


def export_delimited(spark: SparkSession, path: str, schema: str, url: str, table: str,
                     sep: str = "\t", properties: Mapping[str, str] | None = None) -> None:
    """Load a delimited folder into a database table."""
    jdbc_write(spark.read.schema(schema).option("sep", sep).csv(path), url, table,
               properties=properties)
