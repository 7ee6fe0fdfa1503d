"""Text columns as numbers in the order of the label, for any number of values.

The code of a value is the mean label of its rows, drawn towards the mean of all rows by
``SMOOTHING`` rows of that kind, so rare values stay near the middle. Trees then split a text column as
they split a number, with values of like label side by side. A training row gets the code that the other
folds' rows give, so its own label never reaches it; rows to be scored get the code of all training rows.

Codes are a table in the shared folder and are joined by value: no list of values is kept anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.session import fresh_path, within_bytes

FOLDS, SMOOTHING = 5, 20.0
_FOLD_OF_ALL = -1


class TargetCodes(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``<column>_code`` for every text column; values not met in training get the mean of all rows."""

    columns = Param(Params._dummy(), "columns", "text columns", TypeConverters.toListString)
    folder = Param(Params._dummy(), "folder", "table of codes", TypeConverters.toString)
    middle = Param(Params._dummy(), "middle", "mean label of all training rows", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, columns: list[str] | None = None, folder: str | None = None, middle: float | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def table(self, spark: SparkSession) -> DataFrame:
        """column, value, fold (-1: all folds) and code."""
        return spark.read.parquet(self.getOrDefault(self.folder))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.coded(dataset, F.lit(_FOLD_OF_ALL))

    def coded(self, df: DataFrame, fold: Column) -> DataFrame:
        """The codes of each row without the rows of its fold."""
        names, out = df.columns, df.withColumn("_fold", fold)
        table = self.table(df.sparkSession)
        for c in self.getOrDefault(self.columns):
            own = within_bytes(table.where(F.col("column") == c).select(
                F.col("value").alias("_value"), F.col("fold").alias("_of"), F.col("code").alias(f"{c}_code")))
            out = out.join(own, (F.col(c) == F.col("_value")) & (F.col("_fold") == F.col("_of")), "left").drop("_value", "_of")
            out = out.withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(self.getOrDefault(self.middle))))
        return out.select(*names, *[f"{c}_code" for c in self.getOrDefault(self.columns)])


def ordered_by_target(df: DataFrame, features: Sequence[str], label: str, held_out: str | None = None) -> tuple[DataFrame, list[TargetCodes], list[str]]:
    """Training rows with out-of-fold codes, the stage that codes other rows, and the names of the number columns.

    A row's fold is a hash of its features and label, so it is the same wherever the row is computed.
    """
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return df, [], list(features)
    spark = df.sparkSession
    learned = df if held_out is None else df.where(~F.col(held_out))
    fold = F.pmod(F.xxhash64(*features, label), F.lit(FOLDS)).cast("int")
    middle = learned.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    path = fresh_path(spark, "codes")
    for c in text:
        parts = learned.groupBy(F.col(c).alias("value"), fold.alias("fold")).agg(F.sum(F.col(label).cast("double")).alias("s"), F.count("*").alias("n"))
        # a value has a row per fold and one for all of them
        whole = parts.groupBy("value").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.collect_list(F.struct("fold", "s", "n")).alias("own"))
        each = F.concat(F.array(F.struct(F.lit(_FOLD_OF_ALL).alias("fold"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))), "own")
        left = whole.select("value", "s", "n", F.explode(each).alias("o"))
        code = (F.col("s") - F.col("o.s") + SMOOTHING * middle) / (F.col("n") - F.col("o.n") + SMOOTHING)
        left.select(F.lit(c).alias("column"), "value", F.col("o.fold").alias("fold"), code.alias("code")).write.mode("append").parquet(path)
    stage = TargetCodes(columns=text, folder=path, middle=float(middle))
    of = fold if held_out is None else F.when(F.col(held_out), F.lit(_FOLD_OF_ALL)).otherwise(fold)
    return stage.coded(df, of), [stage], [f"{c}_code" if c in text else c for c in features]
