"""Connected components of a large edge list, and lookups by keys that may be hot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.session import checkpointed

SALTS = 32


def looked_up(rows: DataFrame, keys: list[str], spread: Column, parts: list[Column], whole: list[Column]) -> DataFrame:
    """``rows`` with one aggregate per key beside each row; no key is ever whole in one task.

    ``parts`` aggregate the rows of a key and salt, ``whole`` aggregate those parts per key. The
    result goes back to the salted parts, so a hot key is joined in ``SALTS`` pieces.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    pieces = salted.groupBy(*keys, "_salt").agg(*parts)
    per_key = pieces.groupBy(*keys).agg(*whole, F.collect_list("_salt").alias("_salts"))
    sent = per_key.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(sent, [*keys, "_salt"]).drop("_salt")


#: Edges that a task holds before it replaces them by the forest of what it has seen.
_EDGES_AT_ONCE = 4_000_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the task's edges tied to the smallest node that they reach; ``own`` if it came as ``a``."""
    a, b, own, held = [], [], [], 0

    def tied() -> tuple[np.ndarray, np.ndarray]:
        x, y = np.concatenate(a), np.concatenate(b)
        nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        parent = np.arange(len(nodes))
        join(parent, place[: len(x)], place[len(x) :])
        top = nodes[roots(parent)]
        lower = nodes != top
        return nodes[lower], top[lower]

    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        own.append(np.unique(a[-1]))
        held += batch.num_rows
        if held > _EDGES_AT_ONCE:
            node, top = tied()
            a, b, own, held = [node], [top], [np.unique(np.concatenate(own))], 0
    if a:
        node, top = tied()
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(top), pa.array(np.isin(node, np.concatenate(own)))], names=["a", "b", "own"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 40) -> DataFrame:
    """id and component (smallest id reachable) of every id in ``edges``; ids without edges are absent.

    Tasks replace their edges by a forest before and after each shuffle by the larger node. Once no task
    ties a node that belongs to another, every node has one parent, and parents are followed upwards,
    twice as far each time. A task holds its share of the edges' nodes, never a whole component's edges.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = "a long, b long, own boolean"
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a <> b").mapInArrow(_local_forest, forest)
    for _ in range(most_rounds):
        now = checkpointed(now.select("a", "b").repartition(parts, "a").mapInArrow(_local_forest, forest))
        if not now.agg(F.count(F.when(~F.col("own"), 1))).first()[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    now = now.select("a", "b")
    for _ in range(most_rounds):
        above = now.select(F.col("a").alias("b"), F.col("b").alias("up"))
        now = checkpointed(now.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b"), F.col("up").isNotNull().alias("moved")))
        moved = now.agg(F.count(F.when(F.col("moved"), 1))).first()[0]
        now = now.select("a", "b")
        if not moved:
            break
    tops = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(tops.select("id", F.col("id").alias("component")))


def roots(parent: np.ndarray) -> np.ndarray:
    """The root of every node of a forest of parents."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the trees of every pair, smaller root first, until no pair is apart."""
    while len(a):
        top = roots(parent)
        ra, rb = top[a], top[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
