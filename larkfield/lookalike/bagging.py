"""Bagging for positive and unlabelled rows.

Each estimator sees all positives and its own draw of unlabelled rows and features. Draws
come from a hash of estimator number and row id, so which rows an estimator saw can be
worked out again at any time and no index lists are stored.
"""

from __future__ import annotations

import random
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.lookalike.flat_trees import FlatTrees, is_tree, walked
from larkfield.lookalike.models import fill_missing
from larkfield.operators.sampling import hash_share, poisson_weight


@dataclass
class BaggingPU:
    """Settings of the ensemble; ``fit`` gives a :class:`BaggingPUModel`.

    ``max_samples`` is a number of unlabelled rows or a share of them, ``max_features`` a
    number or share of features. With ``bootstrap`` rows are drawn with replacement by a
    Poisson weight of the same expected size, otherwise by a hash cut.
    """

    estimator: object = None
    n_estimators: int = 10
    max_samples: float | int = 1.0
    max_features: float | int = 1.0
    bootstrap: bool = True
    bootstrap_features: bool = False
    oob_score: bool = True
    warm_start: bool = False
    parallelism: int = 2
    seed: int = 1
    label: str = "label"
    weight: str | None = None
    fitted: BaggingPUModel | None = field(default=None, repr=False)

    def fit(self, df: DataFrame, key: str, features: Sequence[str]) -> BaggingPUModel:
        """Train the ensemble; label 1 is positive, anything lower unlabelled."""
        features = list(features)
        if self.oob_score and not self.bootstrap:
            raise ValueError("out-of-bag scores need bootstrap draws")
        if self.oob_score and self.warm_start:
            raise ValueError("out-of-bag scores are not available with a warm start")
        unlabelled = df.where(F.col(self.label) < 1).count()
        share = self.max_samples / max(unlabelled, 1) if isinstance(self.max_samples, int) else self.max_samples
        if not 0 < share <= 1:
            raise ValueError("max_samples must be above 0 and at most the number of unlabelled rows")
        count = self.max_features if isinstance(self.max_features, int) else int(self.max_features * len(features))
        if not 0 < count <= len(features):
            raise ValueError("max_features must be above 0 and at most the number of features")
        known = list(self.fitted.members) if self.warm_start and self.fitted else []
        if self.n_estimators < len(known):
            raise ValueError(f"n_estimators={self.n_estimators} is below the {len(known)} already fitted")
        if known and self.n_estimators == len(known):
            warnings.warn("a warm start with the same n_estimators fits nothing new", stacklevel=2)
            return self.fitted
        rows = fill_missing(df, features).persist()
        draw = Draw(key, self.label, share, self.bootstrap, self.seed)

        def train(i: int) -> tuple:
            picker = random.Random(f"{self.seed}/{i}")
            names = picker.choices(features, k=count) if self.bootstrap_features else picker.sample(features, count)
            chosen = [f for f in features if f in set(names)]
            weight = draw.weight(i) if self.weight is None else draw.weight(i) * F.col(self.weight)
            sample = rows.withColumn("_w", weight.cast("double")).where("_w > 0").withColumn(
                "_y", (F.col(self.label) >= 1).cast("double"))
            assembled = VectorAssembler(inputCols=chosen, outputCol=f"_v{i}").transform(sample)
            base = self.estimator or DecisionTreeClassifier(maxDepth=5, seed=self.seed)
            # Parameters are passed per fit: threads share the estimator object.
            wanted = {"labelCol": "_y", "featuresCol": f"_v{i}", "weightCol": "_w",
                      "probabilityCol": f"_p{i}", "rawPredictionCol": f"_r{i}", "predictionCol": f"_c{i}"}
            settings = {getattr(base, name): column for name, column in wanted.items() if base.hasParam(name)}
            return base.fit(assembled, settings), chosen

        try:
            with ThreadPool(self.parallelism) as pool:
                new = pool.map(inheritable_thread_target(df.sparkSession)(train), range(len(known), self.n_estimators))
        finally:
            rows.unpersist()
        self.fitted = BaggingPUModel(known + new, features, draw)
        return self.fitted


@dataclass(frozen=True)
class Draw:
    """How often estimator ``i`` draws a row."""

    key: str
    label: str
    share: float
    bootstrap: bool
    seed: int

    def weight(self, i: int | Column) -> Column:
        salt = F.concat(F.lit(f"{self.seed}/"), i.cast("string")) if isinstance(i, Column) else f"{self.seed}/{i}"
        if self.bootstrap:
            drawn = poisson_weight(salt, self.key, float(self.share))
        else:
            drawn = (hash_share(salt, self.key) < self.share).cast("int")
        return F.when(F.col(self.label) >= 1, 1).otherwise(drawn)


@dataclass
class BaggingPUModel:
    """Fitted ensemble: (model, features) per estimator.

    An ensemble of trees is scored as flat arrays, one small plan for any number of members. Other
    models are applied one after the other; one without probabilities gives its vote instead.
    """

    members: list
    features: list[str]
    draw: Draw
    _flat: FlatTrees | None = field(default=None, repr=False, compare=False)

    def _trees(self, df: DataFrame) -> FlatTrees | None:
        if self._flat is None and self.members and all(is_tree(m) for m, _ in self.members):
            place = {f: i for i, f in enumerate(self.features)}
            self._flat = FlatTrees.of(df.sparkSession, [m for m, _ in self.members], [[place[f] for f in chosen] for _, chosen in self.members])
        return self._flat

    def _each(self, df: DataFrame) -> DataFrame:
        """All estimators' outputs in one pass over the rows."""
        out = fill_missing(df, self.features)
        for i, (model, chosen) in enumerate(self.members):
            out = VectorAssembler(inputCols=chosen, outputCol=f"_v{i}").transform(out)
            out = model.transform(out).drop(f"_v{i}")
        return out

    def _own(self, i: int, index: int) -> Column:
        """Probability that estimator ``i`` gives a class, or its vote if it has no probabilities."""
        if self.members[i][0].hasParam("probabilityCol"):
            return F.get(vector_to_array(f"_p{i}"), F.lit(index))
        return (F.col(f"_c{i}") == index).cast("double")

    def _mean(self, columns: Sequence[Column]) -> Column:
        total = F.lit(0.0)
        for c in columns:
            total = total + c
        return total / len(self.members)

    def _outputs(self, df: DataFrame, keep: Sequence[str], wanted: Sequence[str]) -> DataFrame:
        """``keep`` and means over the members: ``p0``, ``p1``, ``raw``, ``votes``, or the array ``each`` of their p1."""
        trees = self._trees(df)
        if trees is not None:
            def make(p: np.ndarray, raw: np.ndarray) -> dict:
                made = {"p0": p[:, :, 0].mean(1), "p1": p[:, :, 1].mean(1), "raw": raw[:, :, 1].mean(1), "votes": (p[:, :, 1] > p[:, :, 0]).mean(1)}
                if "each" in wanted:
                    made["each"] = pa.FixedSizeListArray.from_arrays(p[:, :, 1].ravel(), p.shape[1]).cast(pa.list_(pa.float64()))
                return made

            kinds = {n: T.ArrayType(T.DoubleType()) if n == "each" else T.DoubleType() for n in wanted}
            return walked(fill_missing(df, self.features), trees, self.features, keep, kinds, make)
        every = range(len(self.members))
        columns = {"p0": lambda: self._mean([self._own(i, 0) for i in every]), "p1": lambda: self._mean([self._own(i, 1) for i in every]),
                   "raw": lambda: self._mean([F.get(vector_to_array(f"_r{i}"), F.lit(1)) for i in every]),
                   "votes": lambda: self._mean([F.col(f"_c{i}") for i in every]), "each": lambda: F.array(*[self._own(i, 1) for i in every])}
        return self._each(df).select(*keep, *[columns[n]().alias(n) for n in wanted])

    def predict_proba(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean probability of both classes: ``p0`` and ``p1``."""
        return self._outputs(df, keep, ["p0", "p1"])

    def member_probabilities(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Each estimator's probability of the positive class: ``p1_0``, ``p1_1``, ..."""
        out = self._outputs(df, keep, ["each"])
        return out.select(*keep, *[F.get("each", F.lit(i)).alias(f"p1_{i}") for i in range(len(self.members))])

    def vote_share(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Share of estimators that call the row positive."""
        return self._outputs(df, keep, ["votes"]).withColumnRenamed("votes", "p1")

    def predict(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Class of the larger mean probability; equal probabilities give 0."""
        out = self.predict_proba(df, keep)
        return out.select(*keep, F.when(F.col("p1") > F.col("p0"), 1).otherwise(0).alias("prediction"))

    def predict_log_proba(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Logarithms of the mean probabilities; a probability of 0 gives minus infinity."""
        out = self.predict_proba(df, keep)
        log = lambda c: F.when(F.col(c) > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
        return out.select(*keep, log("p0").alias("log_p0"), log("p1").alias("log_p1"))

    def decision(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean raw score of the positive class."""
        return self._outputs(df, keep, ["raw"]).withColumnRenamed("raw", "decision")

    def all_outputs(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Class, mean probabilities, their logarithms and the mean raw score, in one pass over the rows."""
        out = self._outputs(df, keep, ["p0", "p1", "raw"])
        log = lambda c: F.when(F.col(c) > 0, F.ln(c)).otherwise(F.lit(float("-inf")))
        return out.select(*keep, "p0", "p1", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0).alias("prediction"),
                          log("p0").alias("log_p0"), log("p1").alias("log_p1"), F.col("raw").alias("decision"))

    def oob_scores(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Mean probability over estimators that did not draw the row.

        NULL for positives, which all estimators see, and for rows drawn by every estimator.
        """
        members = F.sequence(F.lit(0), F.lit(len(self.members) - 1))
        drawn = F.transform(members, lambda i: self.draw.weight(i))
        scored = self._outputs(df.withColumn("_drawn", drawn), [*dict.fromkeys(keep), "_drawn"], ["each"])
        out = F.filter(F.zip_with("each", "_drawn", lambda p, w: F.when(w == 0, p)), lambda p: p.isNotNull())
        total = F.aggregate(out, F.lit(0.0), lambda acc, p: acc + p)
        return scored.select(*keep, F.try_divide(total, F.size(out)).alias("oob_p1"), F.size(out).alias("oob_estimators"))

    def oob_accuracy(self, df: DataFrame) -> DataFrame:
        """Share of rows whose out-of-bag class is right: over all rows, and unlabelled only.

        Rows without an out-of-bag score count as class 0, so positives are always wrong in
        the first figure.
        """
        label = self.draw.label
        scored = self.oob_scores(df, [label])
        called = F.coalesce(F.col("oob_p1") > 0.5, F.lit(False))
        right = (called == (F.col(label) >= 1)).cast("double")
        return scored.agg(F.avg(right).alias("accuracy_all"),
                          F.avg(F.when(F.col(label) < 1, right)).alias("accuracy_unlabelled"))
