"""Whitening of embedding vectors on the leading eigenvectors of their covariance.

Vectors become whole numbers first, so sums and squared deviations are exact. Each task adds up its
rows; the partial sums of the tasks are added in a second level of tasks in a fixed order, and the driver gets
a bounded number of matrices whose side is the length of a vector. Rows are centred by the exact
mean before they are multiplied. Eigenpairs come from spectrum slicing (``spectrum``).

Defined cases: a vector that is null or empty, or holds null, non-finite or entries beyond 2^56 is dropped. Vectors of
different lengths cannot share a covariance: each length is a fit list of its own, with its own ``n``. A
direction without variance has no component, so a single vector, or copies of one, give no rows. A squared
deviation beyond 64 bits is null. Null and repeated ids keep all their rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_slices
from larkfield.llm.spectrum import leading_eigenpairs

SCALE, SHIFT = 64, 1_000_000
#: Tasks of the second level, and so sums per vector length that the driver gets, at most.
_MOST_SUMS = 64
_ROWS = 2048
#: Sums of whole numbers run in limbs of so many bits, so that no sum overflows before 2^42 rows.
_LIMB = 21


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x, the components floor(64 c) + 1000000, of all rows that have finite components."""
    vec = vectors[vec_col].cast("array<double>")
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 56)))
    kept = vectors.filter(vec.isNotNull() & (F.size(vec) > 0) & finite)
    return kept.select(kept[id_col].alias("vec_id"), F.transform(vec, lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and matrix of the rows of a batch, one pair per vector length."""
    for batch in text_slices(batches, _ROWS):
        lists = batch.column("x")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            of = batch if (lengths == d).all() else batch.filter(pa.array(lengths == d))
            yield of.column("vec_id"), of.column("x").flatten().to_numpy().reshape(-1, d)


def _summed(rows: DataFrame, sums, dtype: str) -> dict[int, np.ndarray]:
    """Per vector length the sum of ``sums(x)`` over all rows, added in a fixed order.

    ``sums`` gives a flat array for a matrix of rows, of a size that the vector length sets.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in _by_length(batches):
            d = x.shape[1]
            total[d] = total[d] + sums(x) if d in total else sums(x)
        part = TaskContext.get().partitionId()
        yield from emitted(total, part)

    def emitted(total: dict[int, np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        for d, s in sorted(total.items()):
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([part], pa.int32()), pa.array([s.astype(dtype).tobytes()])],
                                             names=["length", "part", "sums"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, blob in zip(batch.column("length").to_pylist(), batch.column("sums")):
                s = np.frombuffer(blob.as_buffer(), dtype)
                total[d] = total[d] + s if d in total else s.copy()
        yield from emitted(total, TaskContext.get().partitionId())

    schema = "length int, part int, sums binary"
    parts = rows.mapInArrow(partial, schema)
    n = min(_MOST_SUMS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    second = parts.repartition(n, F.col("part") % n).sortWithinPartitions("length", "part").mapInArrow(merged, schema)
    total: dict[int, np.ndarray] = {}
    for r in sorted(second.collect(), key=lambda r: (r["length"], r["part"])):
        s = np.frombuffer(r["sums"], dtype)
        total[r["length"]] = total[r["length"]] + s if r["length"] in total else s
    return total


def _moments(x: np.ndarray) -> np.ndarray:
    limbs = [x & ((1 << _LIMB) - 1), (x >> _LIMB) & ((1 << _LIMB) - 1), x >> (2 * _LIMB)]
    return np.concatenate([[len(x)], *[part.sum(0) for part in limbs]]).astype(np.int64)


@dataclass
class Whitening:
    """Exact sums of one fit list, its leading eigenpairs and the projection onto them."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float = float("nan")

    def __post_init__(self):
        self.centre = np.array([round(s / self.n) if abs(s) < 1 << 53 else s // self.n for s in self.sums], np.int64)
        self.rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.centre)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the whole part exactly, then the rest of the mean."""
        return (x - self.centre).astype(float) - self.rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the entries of (n x - S)², exactly; None beyond 64 bits."""
        reach = max((self.n * int(abs(v)) for v in (x.max(), x.min())), default=0) + max(map(abs, self.sums))
        if reach < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            if x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63:
                return (off * off).sum(1).tolist()
        off = self.n * x.astype(object) - np.array(self.sums, object)
        return [v if v < 1 << 63 else None for v in (off * off).sum(1)]


def fit(rows: DataFrame, components: int = 32) -> dict[int, Whitening]:
    """A whitening per vector length of ``rows`` (vec_id, x)."""
    exact: dict[int, tuple[int, list[int]]] = {}
    for d, m in _summed(rows, _moments, "<i8").items():
        low, middle, high = (m[1 + i * d : 1 + (i + 1) * d].tolist() for i in range(3))
        exact[d] = int(m[0]), [a + (b << _LIMB) + (c << 2 * _LIMB) for a, b, c in zip(low, middle, high)]
    bare = {d: Whitening(n, s, np.zeros((0, 0)), np.zeros(0), np.zeros((d, 0))) for d, (n, s) in exact.items()}

    def products(x: np.ndarray) -> np.ndarray:
        y = bare[x.shape[1]].centred(x)
        return (y.T @ y).ravel()

    models = {}
    for d, total in _summed(rows, products, "<f8").items():
        covariance = total.reshape(d, d) / bare[d].n
        models[d] = Whitening(*exact[d], covariance, *leading_eigenpairs(covariance, components))

    def images(x: np.ndarray) -> np.ndarray:
        w = models[x.shape[1]].whitened(x)
        return np.concatenate([w.sum(0), (w.T @ w).ravel()])

    for d, total in _summed(rows, images, "<f8").items():
        model, k = models[d], len(models[d].values)
        mean = total[:k] / model.n  # rounding alone: whitened values are centred
        off = total[k:].reshape(k, k) / model.n - np.outer(mean, mean) - np.eye(k)
        model.identity_error = float(np.abs(off).max(initial=0))
    return models


def whiten(vectors: DataFrame, components: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector and component.

    Columns: vec_id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained,
    identity_error.
    """
    rows = whole_numbers(vectors, id_col, vec_col)
    models = fit(rows, components)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _by_length(batches):
            model = models[x.shape[1]]
            k, count = len(model.values), len(x)
            if not k:
                continue
            whose = pa.array(np.repeat(np.arange(count), k))
            trace = float(np.trace(model.covariance))
            yield pa.RecordBatch.from_arrays([
                ids.take(whose), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, model.n)),
                pa.array(model.deviations(x), pa.int64()).take(whose), pa.array(model.whitened(x).ravel()),
                pa.array(np.tile(model.values / trace, count)), pa.array(np.full(count * k, model.identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(projected, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
