"""Positive-unlabelled labelling in rounds.

``ys`` is 1 for positive, 0 for negative and -1 for undecided rows. Each round trains on the
current labels, scores all rows and decides undecided rows whose score lies outside the
range of the positives' scores.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.lookalike.forest import ForestModel, train_forest
from larkfield.lookalike.models import random_forest, score, train
from larkfield.session import checkpointed


def relabel(df: DataFrame, score_column: str = "p1", ys: str = "ys") -> DataFrame:
    """Undecided rows above the best positive become 1, below the worst positive 0."""
    positive = F.when(F.col(ys) > 0, F.col(score_column))
    bounds = df.agg(F.struct(F.min(positive).alias("low"), F.max(positive).alias("high"))).scalar()
    undecided, p = F.col(ys) < 0, F.col(score_column)
    decided = (F.when(undecided & (p > bounds["high"]), 1).when(undecided & (p < bounds["low"]), 0)
               .otherwise(F.col(ys)))
    return df.withColumn(ys, decided)


def start_labels(df: DataFrame, target: str = "target") -> DataFrame:
    """``ys = 2 * target - 1``: unlabelled rows start undecided."""
    return df.withColumn("ys", F.col(target) * 2 - 1)


def first_step(df: DataFrame, features: Sequence[str], make_estimator: Callable = random_forest) -> DataFrame:
    """Train on the 0/1 target, score and decide."""
    rows = start_labels(df).withColumn("label", F.col("target").cast("double"))
    model = train(rows, features, make_estimator())
    keep = [c for c in rows.columns if c not in ("label", "p1")]
    return relabel(checkpointed(score(model, rows, features, keep, class_index=1)))


def second_step(df: DataFrame, features: Sequence[str], make_estimator: Callable = random_forest) -> DataFrame:
    """Train on the current three-level labels, score class 1 and decide."""
    rows = df.drop("p1").withColumn("label", (F.col("ys") + 1).cast("double"))
    model = train(rows, features, make_estimator())
    keep = [c for c in rows.columns if c != "label"]
    return relabel(checkpointed(score(model, rows, features, keep, class_index=2)))


def run_rounds(df: DataFrame, key: str, features: Sequence[str], make_estimator: Callable = random_forest,
               max_rounds: int = 10, three_class: bool = False, drop_undecided: bool = True) -> DataFrame:
    """Repeat until no label changes, at most ``max_rounds`` times; a warning tells if they still changed.

    Every round ends in a checkpoint: the next one trains on stored rows, and a lost
    executor does not set off the retraining of earlier rounds.
    """
    if df.where("target = 1").isEmpty():
        raise ValueError("there is no positive row to learn from")
    if three_class:
        current = checkpointed(df.withColumn("ys", F.col("target")))
    else:
        current = checkpointed(first_step(df, features, make_estimator))
    for _ in range(max_rounds):
        before = F.col("ys").alias("_before")
        kept = current.select("*", before)
        after = checkpointed(second_step(kept, features, make_estimator))
        current = after.drop("_before")
        if after.where(F.col("ys") != F.col("_before")).isEmpty():
            break
    else:
        if max_rounds:
            warnings.warn(f"labels still changed after {max_rounds} rounds", stacklevel=2)
    return current.where("ys <> -1") if drop_undecided else current


def train_full_model(labelled: DataFrame, features: Sequence[str], trees: int = 100, depth: int = 20,
                     columns: float = 0.9) -> ForestModel:
    """Final forest on decided rows; ``columns`` is the share of the features that each tree is given."""
    rows = labelled.where("ys <> -1").withColumn("label", F.col("ys").cast("double"))
    return train_forest(rows, features, trees=trees, depth=depth, column_rate=columns)


def score_all(model: ForestModel, df: DataFrame, key: str) -> DataFrame:
    """Score the whole table, cleaned like the training rows; ids travel with their row."""
    return model.score(df, [key])
