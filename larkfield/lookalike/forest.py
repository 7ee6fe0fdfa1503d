"""Forest whose trees each see their own rows and columns.

Spark's forest draws columns anew at every node. Here every tree is grown apart on rows weighted by a
Poisson draw and on a drawn share of the columns, as a rate per tree asks for; inside a tree
the usual draw per node stays. The grown trees are kept and scored as flat arrays.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.lookalike.flat_trees import FlatTrees, walked
from larkfield.lookalike.models import fill_missing
from larkfield.lookalike.target_codes import ordered_by_target
from larkfield.operators.sampling import poisson_weight
from larkfield.session import checkpointed


@dataclass
class ForestModel:
    """Feature stages, the trees, and the columns that each tree was given."""

    stages: PipelineModel
    trees: FlatTrees
    features: list[str]
    inputs: list[str]
    masks: list[list[str]]

    def score(self, df: DataFrame, keep: Sequence[str], class_index: int = 1, output: str = "p1") -> DataFrame:
        """The kept columns and the mean over the trees of the class's share in a row's leaf."""
        rows = self.stages.transform(fill_missing(df, self.features))
        return walked(rows, self.trees, self.inputs, keep, {output: T.DoubleType()}, lambda p, _: {output: p[:, :, class_index].mean(1)})


def train_forest(df: DataFrame, features: Sequence[str], label: str = "label", trees: int = 100, depth: int = 20,
                 column_rate: float = 0.9, row_rate: float = 0.632, per_node: str = "sqrt", seed: int = 1,
                 parallelism: int = 4) -> ForestModel:
    """Grow ``trees`` trees; each has ``column_rate`` of the columns and draws rows at ``row_rate``.

    A few trees grow side by side, each as a distributed job over the stored rows. Rows are drawn by a number
    that they are stored with, so a lost executor does not change a draw.
    """
    if not 0 < column_rate <= 1 or not row_rate > 0:
        raise ValueError("column_rate must be above 0 and at most 1, row_rate above 0")
    features = list(features)
    coded, codes, inputs = ordered_by_target(fill_missing(df, features), features, label)
    stages = PipelineModel(codes)
    columns = [*inputs, F.col(label).cast("double").alias("_y"), F.monotonically_increasing_id().alias("_row")]
    rows = checkpointed(coded.select(*columns))
    count = max(1, round(column_rate * len(inputs)))

    def grow(i: int) -> tuple:
        chosen = set(random.Random(f"{seed}/{i}").sample(inputs, count))
        mask = [c for c in inputs if c in chosen]
        drawn = rows.withColumn("_w", poisson_weight(f"{seed}/{i}", "_row", float(row_rate)).cast("double")).where("_w > 0")
        learner = RandomForestClassifier(numTrees=1, maxDepth=depth, featureSubsetStrategy=per_node, bootstrap=False, seed=seed + i,
                                         labelCol="_y", featuresCol="_v", weightCol="_w", maxMemoryInMB=512)
        return learner.fit(VectorAssembler(inputCols=mask, outputCol="_v").transform(drawn)), mask

    with ThreadPool(parallelism) as pool:
        grown = pool.map(inheritable_thread_target(df.sparkSession)(grow), range(trees))
    place = {c: i for i, c in enumerate(inputs)}
    masks = [mask for _, mask in grown]
    flat = FlatTrees.of(df.sparkSession, [m for m, _ in grown], [[place[c] for c in mask] for mask in masks], parallelism)
    return ForestModel(stages, flat, features, list(inputs), masks)
