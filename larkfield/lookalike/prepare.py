"""Training frames for look-alike models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.functions.features import clean_features
from larkfield.operators.sampling import hide_positives, sample_negatives

NULL_MARKER = "\\N"


def build_target(df: DataFrame, target: str | None = None, to_target: str | None = None,
                 negative: int = 0, output: str = "target") -> DataFrame:
    """Add the label: a given column, or 1 where ``to_target`` holds a value.

    ``\\N`` and NULL in ``to_target`` mean no value and give ``negative`` (0 or -1).
    """
    if target is not None:
        if target not in df.columns:
            raise ValueError(f"{target} column not found")
        return df.withColumn(output, F.col(target).cast("int"))
    if to_target is None:
        raise ValueError("target column is not defined")
    empty = F.col(to_target).isNull() | (F.col(to_target).cast("string") == NULL_MARKER)
    return df.withColumn(output, F.when(empty, negative).otherwise(1))


@dataclass
class Prepared:
    """A training frame: id, features, ``target`` as trained and ``orig_target`` as known."""

    df: DataFrame
    key: str
    features: list[str]


def prepare(df: DataFrame, key: str, features: Sequence[str], target: str | None = None,
            to_target: str | None = None, n_sample: int = 100_000, hidden_size: int = 0,
            process: bool = True, three_class: bool = False, salt: str = "hide") -> Prepared:
    """Label, sample and clean a table.

    Unlabelled rows are 0, or -1 in the three-class form where 0 means a known negative.
    The first ``n_sample`` unlabelled rows by key and all labelled rows are kept;
    ``hidden_size`` random positives (all, if there are fewer) are relabelled as unlabelled
    for validation.
    Cleaning is the same for training and scoring: use :func:`prepare_features` there.
    """
    unlabelled = -1 if three_class else 0
    labelled = build_target(df, target, to_target, unlabelled).select(key, *features, "target")
    others = (0,) if three_class else ()
    rows = sample_negatives(labelled, "target", key, n_sample, 1, unlabelled, others)
    if hidden_size > 0:
        rows = hide_positives(rows, "target", key, hidden_size, salt, 1, unlabelled)
    else:
        rows = rows.withColumn("orig_target", F.col("target"))
    return Prepared(prepare_features(rows) if process else rows, key, list(features))


def prepare_features(df: DataFrame) -> DataFrame:
    """The feature clean-up of training, for the table to be scored."""
    return clean_features(df)
