"""Training helpers around Spark ML."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.lookalike.target_codes import TargetCodes, ordered_by_target
from larkfield.operators.metrics import auc_rank

# Trees split off missing values below every real one.
MISSING = -1.0e9


def fill_missing(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """NULL and NaN numbers become a value below all others; NULL text becomes empty."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name not in features:
            out.append(c)
        elif isinstance(f.dataType, T.StringType):
            out.append(F.coalesce(c, F.lit("")).alias(f.name))
        else:
            out.append(F.coalesce(F.nanvl(c.cast("double"), F.lit(MISSING)), F.lit(MISSING)).alias(f.name))
    return df.select(*out)


def random_forest(trees: int = 100, depth: int = 20, label: str = "label", seed: int = 1,
                  columns: str | float = "auto") -> RandomForestClassifier:
    """Forest with the library's usual size; ``columns`` is a rule or a share of the features.

    Spark draws features per node, not per tree, so a share of 0.9 leaves trees much alike.
    """
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, labelCol=label, seed=seed,
                                  featureSubsetStrategy=str(columns), maxMemoryInMB=512)


def logistic(label: str = "label", iterations: int = 50) -> LogisticRegression:
    return LogisticRegression(labelCol=label, maxIter=iterations)


def train(df: DataFrame, features: Sequence[str], estimator, held_out: str | None = None) -> PipelineModel:
    """Fit text codes and estimator together, so scoring repeats the same steps.

    Text columns become numbers ordered by the label (``target_codes``), however many values they have. Rows
    where the flag ``held_out`` is true have no part in that order.
    """
    filled = fill_missing(df, features)
    coded, stages, inputs = ordered_by_target(filled, features, estimator.getLabelCol(), held_out)
    assembler = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="error")
    return PipelineModel([*stages, assembler, estimator.fit(assembler.transform(coded))])


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str],
          class_index: int = 1, output: str = "p1") -> DataFrame:
    """Probability of one class beside the kept columns; no row is matched by position."""
    scored = model.transform(fill_missing(df, features))
    return scored.select(*keep, F.get(vector_to_array("probability"), F.lit(class_index)).alias(output))


def gbm_train(train_df: DataFrame, features: Sequence[str], label: str, params: Mapping | None = None,
              valid_df: DataFrame | None = None, weight: str | None = None) -> PipelineModel:
    """Boosted trees. With ``valid_df`` training stops early when its loss stops falling.

    ``params`` are those of Spark's ``GBTClassifier``: ``maxIter``, ``stepSize``,
    ``maxDepth``, ``minInstancesPerNode``, ``subsamplingRate``, ``featureSubsetStrategy``...
    """
    estimator = GBTClassifier(labelCol=label, seed=1)
    settings = {"maxIter": 20, **dict(params or {})}
    if weight:
        settings["weightCol"] = weight
    frame = train_df
    if valid_df is not None:
        settings["validationIndicatorCol"] = "_is_valid"
        frame = train_df.withColumn("_is_valid", F.lit(False)).unionByName(
            valid_df.withColumn("_is_valid", F.lit(True)))
    estimator.setParams(**settings)
    return train(frame, features, estimator, held_out="_is_valid" if valid_df is not None else None)


def model_name(kind: str, features: Sequence[str], params: Mapping) -> str:
    """Model kind and a short hash of features and parameters; equal settings share a name."""
    record = json.dumps({"features": sorted(features), "params": dict(params)}, sort_keys=True, default=str)
    return f"{kind}-{hashlib.sha256(record.encode()).hexdigest()[:12]}"


def calibrate(scored: DataFrame, score_column: str, label: str):
    """Monotone map from score to observed rate, fitted on held-out rows."""
    rows = scored.select(F.col(score_column).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression().fit(rows)


def apply_calibration(model, scored: DataFrame, score_column: str, output: str = "cal_p1") -> DataFrame:
    out = model.transform(scored.withColumn("features", F.col(score_column)))
    return out.withColumnRenamed("prediction", output).drop("features")


def feature_importance(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """Rows ``(variable, importance, scaled_importance)``, the largest scaled to 1."""
    tree = model.stages[-1]
    values = [float(v) for v in tree.featureImportances.toArray()]
    top = max(values) or 1.0
    rows = [(f, v, v / top) for f, v in zip(features, values)]
    return SparkSession.active().createDataFrame(rows, "variable string, importance double, scaled_importance double")


def select_by_importance(model: PipelineModel, features: Sequence[str], threshold: float = 0.0001) -> list[str]:
    """Features whose scaled importance is above the threshold."""
    chosen = feature_importance(model, features).where(F.col("scaled_importance") > threshold)
    names = {r["variable"] for r in chosen.collect()}
    return [f for f in features if f in names]


def grid_search(train_df: DataFrame, valid_df: DataFrame, features: Sequence[str], label: str,
                grid: Mapping[str, Sequence], parallelism: int = 2) -> DataFrame:
    """One boosted model per combination: its parameters and AUC on both frames, best first.

    A few fits run side by side; each is itself a distributed job.
    """
    names = list(grid)
    combos = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    keyed_train, keyed_valid = train_df.persist(), valid_df.persist()

    def fit(params: dict) -> tuple:
        model = gbm_train(keyed_train, features, label, params)
        measured = [auc_rank(score(model, df, features, [label]), "p1", label).first()["auc_half"]
                    for df in (keyed_train, keyed_valid)]
        return (model_name("gbm", features, params), *[float(params[n]) for n in names], *measured)

    try:
        with ThreadPool(parallelism) as pool:
            rows = pool.map(inheritable_thread_target(train_df.sparkSession)(fit), combos)
    finally:
        keyed_train.unpersist()
        keyed_valid.unpersist()
    columns = ", ".join(f"`{n}` double" for n in names)
    table = train_df.sparkSession.createDataFrame(rows, f"model_id string, {columns}, train_auc double, valid_auc double")
    return table.orderBy(F.desc("valid_auc"), "model_id")


def save_model(model: PipelineModel, path: str) -> None:
    """Store a model with the code tables of its text columns."""
    model.write().overwrite().save(path)
    for stage in model.stages:
        if isinstance(stage, TargetCodes):
            stage.table(SparkSession.active()).write.mode("overwrite").parquet(f"{path}/codes/{stage.uid}")


def load_model(path: str) -> PipelineModel:
    model = PipelineModel.load(path)
    for stage in model.stages:
        if isinstance(stage, TargetCodes):
            stage.set(stage.folder, f"{path}/codes/{stage.uid}")
    return model
