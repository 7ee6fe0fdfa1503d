"""Score publishing: buckets, partitioned score tables, model registries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.operators.ranking import quantile_buckets
from larkfield.session import checkpointed, small_side

ROWS_PER_FILE = 1_000_000

SCORE_COLUMNS = ["report_date", "subs_id", "model_id", "model_version", "probability",
                 "bucket_value", "segment_id", "load_id"]


def next_model_id(model_desc: DataFrame, column: str = "model_id") -> DataFrame:
    """One row ``next_model_id``; an empty registry starts at 1."""
    return model_desc.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_model_id"))


def bucket_table(predictions: DataFrame, probability: str | None, subs_id: str = "subs_id", *,
                 as_of: dt.date | None = None, model_id: int = 1, model_version: int = 1,
                 segment_id: int = 1, load_id: int = 0, condition: Column | str | None = None,
                 buckets: int = 99, n_ranges: int | None = None) -> DataFrame:
    """Score rows ready to publish: bucket 1 is the best 1/99 of the scores.

    ``as_of`` defaults to the current date; the report date lies three days before it.
    ``probability=None`` publishes constant ones in bucket 1. Equal scores are ordered
    by subscriber, so repeated runs give the same buckets.
    """
    rows = predictions if condition is None else predictions.where(condition)
    day = F.current_date() if as_of is None else F.lit(as_of)
    score = F.lit(1.0) if probability is None else F.col(probability)
    rows = rows.select(F.col(subs_id).alias("subs_id"), score.alias("probability"))
    if probability is None:
        rows = rows.withColumn("bucket_value", F.lit(1).cast("long"))
    else:
        rows = quantile_buckets(rows, [("probability", "desc"), ("subs_id", "asc")], buckets,
                                n_ranges=n_ranges)
    return (rows.withColumn("report_date", F.date_sub(day, 3))
            .withColumn("model_id", F.lit(model_id)).withColumn("model_version", F.lit(model_version))
            .withColumn("segment_id", F.lit(segment_id)).withColumn("load_id", F.lit(load_id))
            .select(*SCORE_COLUMNS))


def score_partitions(scores: DataFrame, first_day: dt.date, last_day: dt.date,
                     segments: tuple[int, ...] = (1, 2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """Split into (accepted, rejected) and name the partition of each accepted row.

    Days outside ``first_day..last_day`` have no partition, so those rows are returned
    apart. A segment outside the list, or NULL, goes to the partition ``unknown``.
    """
    inside = F.coalesce(F.col("report_date").between(F.lit(first_day), F.lit(last_day)), F.lit(False))
    part = F.when(F.col("segment_id").isin(*segments), F.col("segment_id").cast("string"))
    accepted = scores.where(inside).withColumn("segment_part", F.coalesce(part, F.lit("unknown")))
    return accepted, scores.where(~inside)


def write_partitioned_scores(scores: DataFrame, path: str, first_day: dt.date, last_day: dt.date,
                             rejected_path: str, mode: str = "append") -> None:
    """Write accepted rows by day and segment; rejected rows go to ``rejected_path``.

    The rows are stored, so that scores are computed once, and counted by (day, segment). Each
    of these is written by a task for every ``ROWS_PER_FILE`` of its rows, however many it holds.
    """
    accepted, rejected = score_partitions(checkpointed(scores), first_day, last_day)
    days = ["report_date", "segment_part"]
    files = F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).cast("int").alias("_files")
    sized = accepted.join(small_side(accepted.groupBy(*days).agg(files)), days)
    spread = sized.repartition(*days, F.pmod(F.xxhash64("subs_id"), F.col("_files"))).drop("_files")
    spread.write.mode(mode).partitionBy("report_date", "segment_part").parquet(path)
    rejected.write.mode(mode).parquet(rejected_path)


def registry_rows(scores: DataFrame, model_name: str, segment_name: str) -> dict[str, DataFrame]:
    """Rows that one publication adds to the model, segment and load registries."""
    model = scores.select("model_id").distinct().withColumn("model_name", F.lit(model_name))
    segment = (scores.select("model_id", "segment_id").distinct()
               .withColumn("segment_name", F.lit(segment_name)))
    marker = scores.select("report_date", "model_id", "model_version").distinct()
    return {"model_desc": model, "segment_desc": segment, "scoring_to_load": marker}


def publish(scores: DataFrame, paths: dict[str, str], model_name: str, segment_name: str) -> None:
    """Append scores and registry rows; the load marker comes last, after all data is in place.

    The scores are stored first, so a model behind them runs once.
    """
    scores = checkpointed(scores)
    rows = registry_rows(scores, model_name, segment_name)
    scores.write.mode("append").parquet(paths["scoring"])
    for name in ("model_desc", "segment_desc", "scoring_to_load"):
        rows[name].write.mode("append").parquet(paths[name])
