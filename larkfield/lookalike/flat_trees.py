"""Many trees as plain arrays, walked for a whole batch of rows at once.

The nodes of all trees of an ensemble stand in one table: split feature, threshold or set of
categories, children and class counts. A batch of rows stands on the roots of all trees and moves
down together, one level a step, so scoring is one small plan however many trees there are. Nodes come from
the stored form of Spark's own models.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkfield.session import fresh_path

# The class travels inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Row and tree pairs that are walked at a time.
_WALKED = 1 << 20


def is_tree(model) -> bool:
    return isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel))


@dataclass
class FlatTrees:
    """Nodes of all trees; ``member`` tells which model of the ensemble a tree belongs to."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray
    sets: np.ndarray
    set_start: np.ndarray
    set_size: np.ndarray
    roots: np.ndarray
    member: np.ndarray

    @property
    def members(self) -> int:
        return int(self.member.max(initial=-1)) + 1

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row (first axis) in every tree."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.broadcast_to(np.arange(len(x))[:, None], node.shape)
        moving = self.left[node] >= 0
        while moving.any():
            at, who = node[moving], row[moving]
            value = x[who, self.feature[at]]
            size = self.set_size[at]
            category = np.clip(value, 0, np.maximum(size - 1, 0)).astype(np.int64)
            go_left = np.where(size > 0, self.sets[np.minimum(self.set_start[at] + category, len(self.sets) - 1)], value <= self.threshold[at])
            node[moving] = np.where(go_left, self.left[at], self.right[at])
            moving = self.left[node] >= 0
        return node

    def member_outputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row and member: probabilities and raw class scores as the model itself gives them."""
        classes = self.counts.shape[1]
        share = self.counts / np.maximum(self.counts.sum(1, keepdims=True), 1e-300)
        alone = np.bincount(self.member, minlength=self.members)[self.member] == 1
        proba = np.zeros((len(x), self.members, classes))
        raw = np.zeros_like(proba)
        step = max(1, _WALKED // max(1, len(self.roots)))
        for at in range(0, len(x), step):
            leaf = self.leaves(x[at : at + step])
            for tree in range(len(self.roots)):
                own = share[leaf[:, tree]]
                proba[at : at + step, self.member[tree]] += own
                # a lone tree's raw score is its leaf's counts, a forest's the sum of its trees' shares
                raw[at : at + step, self.member[tree]] += self.counts[leaf[:, tree]] if alone[tree] else own
        trees = np.bincount(self.member, minlength=self.members)
        return proba / trees[None, :, None], raw

    @classmethod
    def of(cls, spark: SparkSession, models: Sequence, columns: Sequence[Sequence[int]], parallelism: int = 4) -> FlatTrees:
        """The trees of ``models``; ``columns`` gives the feature numbers that each model's vector holds."""
        folder = fresh_path(spark, "trees")

        def store(i: int) -> None:
            models[i].write().save(f"{folder}/{i}")

        with ThreadPool(parallelism) as pool:
            pool.map(inheritable_thread_target(spark)(store), range(len(models)))
        wide = [isinstance(m, RandomForestClassificationModel) for m in models]
        rows = []
        for kind in (False, True):
            paths = [f"{folder}/{i}/data" for i in range(len(models)) if wide[i] == kind]
            if paths:
                data = spark.read.parquet(*paths)
                node = F.col("nodeData") if kind else F.struct("*")
                tree = F.col("treeID") if kind else F.lit(0)
                which = F.regexp_extract(F.input_file_name(), r"/(\d+)/data/[^/]*$", 1).cast("int")
                flat = data.select(which.alias("model"), tree.alias("tree"), node.alias("n")).select("model", "tree", "n.*")
                rows += flat.collect()  # nodes: bounded by the trees' depth, not by the rows they were grown on
        return cls._assembled(rows, columns)

    @classmethod
    def _assembled(cls, rows: list, columns: Sequence[Sequence[int]]) -> FlatTrees:
        rows = sorted(rows, key=lambda r: (r["model"], r["tree"], r["id"]))
        keys = [(r["model"], r["tree"]) for r in rows]
        roots = [i for i, k in enumerate(keys) if i == 0 or keys[i - 1] != k]
        base = np.repeat(roots, np.diff([*roots, len(rows)]))
        child = lambda name: np.array([r[name] + b if r[name] >= 0 else -1 for r, b in zip(rows, base)], np.int64)
        classes = max((len(r["impurityStats"]) for r in rows), default=2)
        counts = np.zeros((len(rows), classes))
        feature, threshold = np.zeros(len(rows), np.int64), np.zeros(len(rows))
        start, size, sets = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), [np.zeros(1, bool)]
        held = 1
        for i, r in enumerate(rows):
            counts[i, : len(r["impurityStats"])] = r["impurityStats"]
            split = r["split"]
            if r["leftChild"] < 0:
                continue
            feature[i] = columns[r["model"]][split["featureIndex"]]
            if split["numCategories"] > 0:
                goes = np.zeros(split["numCategories"], bool)
                goes[np.array(split["leftCategoriesOrThreshold"], int)] = True
                sets.append(goes)
                start[i], size[i], held = held, len(goes), held + len(goes)
            else:
                threshold[i] = split["leftCategoriesOrThreshold"][0]
        return cls(feature, threshold, child("leftChild"), child("rightChild"), counts, np.concatenate(sets), start, size,
                   np.array(roots, np.int64), np.array([keys[i][0] for i in roots], np.int64))


def walked(df: DataFrame, trees: FlatTrees, features: Sequence[str], keep: Sequence[str], outputs: dict[str, T.DataType],
           make: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray | pa.Array]]) -> DataFrame:
    """The kept columns and what ``make(probabilities, raw scores)`` says of each batch.

    ``outputs`` maps the names that ``make`` returns to their types.
    """
    held = df.sparkSession.sparkContext.broadcast(trees)
    named = [f"_x{i}" for i in range(len(features))]
    kept = df.select(*keep)
    rows = df.select(*keep, *[F.col(f).cast("double").alias(n) for f, n in zip(features, named)])
    names, n_kept = [*kept.columns, *outputs], len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in named], 1) if batch.num_rows else np.zeros((0, len(named)))
            made = make(*held.value.member_outputs(x))
            columns = [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], *columns], names=names)

    schema = kept.schema
    for name, kind in outputs.items():
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)
