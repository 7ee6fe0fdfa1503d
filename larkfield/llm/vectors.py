"""Near-duplicate vectors by product quantisation with coarse inverted lists.

A bounded sample fits coarse centroids and, on the residuals, one codebook per group of dimensions.
Every vector is then coded: its list, one code per subspace, and the exact length of its coding
error. It searches all lists whose squared distance is within a margin of its own list's; the margin
is ``slack`` times the standard deviation by which a step of the linking distance in a random
direction changes the difference of two squared distances. In a list, asymmetric distances are sums of table entries; a member stays a candidate while its
table distance does not exceed the linking distance plus its own coding error, so coding never loses
a pair of a searched list. Candidates are reranked by exact cosine in double precision.

Equal vectors of a label are one class with a weight and are searched once. A list is cut into blocks
of bounded size, and pairs of blocks are compared, so a crowded list never is one task; a block pair
emits sums and a spanning star per vector, not its pairs.

Defined cases: null, empty, zero or non-finite vectors, vectors that hold nulls, and rows with a null label
link with nothing and are kept. Only vectors of one length are compared; for the index shorter ones are filled up with
zeros, which change no distance. Classes have a key of their own, so ids may repeat or be null: rows that
repeat an id are vectors of their own, and component_id is the smallest id that a row of the component has, null if
none has one (such rows are all kept). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.components import connected_components, join, looked_up, roots
from larkfield.session import checkpointed, small_side

#: Rows of a block, and rows of one label that a list is made for.
BLOCK_ROWS, LIST_ROWS = 2048, 512


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        nearest = _distances(x, centres).argmin(1)
        sums, sizes = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
        np.add.at(sums, nearest, x)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None], 0)


@dataclass
class Quantiser:
    """Coarse centroids and a codebook per subspace; size fixed by the parameters of ``fit``."""

    coarse: np.ndarray
    spaces: list[np.ndarray]
    books: list[np.ndarray]
    margin: float

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, reach: float, slack: float, subspaces: int = 8, codes: int = 256) -> Quantiser:
        coarse = _kmeans(sample, min(lists, len(sample)))
        residual = sample - coarse[_distances(sample, coarse).argmin(1)]
        spaces = [s for s in np.array_split(np.arange(sample.shape[1]), subspaces) if len(s)]
        apart = np.sqrt(_distances(coarse, coarse).sum() / max(1, len(coarse) * (len(coarse) - 1)))
        margin = slack * 2 * reach * apart / np.sqrt(sample.shape[1])
        return cls(coarse, spaces, [_kmeans(residual[:, s], min(codes, len(sample))) for s in spaces], margin)

    def searched(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own list of unit rows ``x``, and which lists each searches."""
        d = _distances(x, self.coarse)
        return d.argmin(1), d <= d.min(1, keepdims=True) + self.margin

    def code(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and length of the coding error of unit rows ``x``."""
        residual = x - self.coarse[_distances(x, self.coarse).argmin(1)]
        codes = np.stack([_distances(residual[:, s], b).argmin(1) for s, b in zip(self.spaces, self.books)], 1)
        coded = np.zeros_like(x)
        for j, (s, b) in enumerate(zip(self.spaces, self.books)):
            coded[:, s] = b[codes[:, j]]
        return codes, np.linalg.norm(residual - coded, axis=1)

    def table_distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of rows ``x`` to the coded members of list ``home``, by table lookup."""
        residual = x - self.coarse[home]
        total = np.zeros((len(x), len(codes)))
        for j, (s, b) in enumerate(zip(self.spaces, self.books)):
            total += _distances(residual[:, s], b)[:, codes[:, j]]
        return total


def _unit(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    x = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_STAR = "vec_id long, n long, root long"


def _block_links(model: Quantiser, dim: int, threshold: float):
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        home, i, j = (k.as_py() for k in key[1:])
        batch = group.combine_chunks().to_batches()[0]
        ids, weight = batch.column("vec_id").to_numpy(), batch.column("weight").to_numpy()
        x, own, block = _unit(batch, "embedding", dim), batch.column("home").to_numpy(), batch.column("block").to_numpy()
        member = (own == home) & (block == i)
        m, q = np.flatnonzero(member), np.flatnonzero(block == j)
        if not len(m) or not len(q):
            return pa.table({n: pa.array([], pa.int64()) for n in ("vec_id", "n", "root")})
        codes, error = model.code(x[m])
        searched = model.searched(x[m])[1]
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for start in range(0, len(q), 256):
            part = q[start : start + 256]
            near = np.sqrt(model.table_distances(x[part], home, codes)) <= reach + error[None]
            foreign = own[part] != home
            # a pair of two lists that search each other belongs to the lower list; pairs of one list count once
            near &= np.where(foreign[:, None], (own[part][:, None] > home) | ~searched[:, own[part]].T, True)
            near &= foreign[:, None] | (i != j) | (ids[part][:, None] > ids[m][None])
            a, b = np.nonzero(near)
            cosine = np.einsum("nd,nd->n", x[part[a]], x[m[b]])
            a, b = part[a[cosine >= threshold]], m[b[cosine >= threshold]]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            join(parent, a, b)
        root = roots(parent)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, ids)
        hit = links > 0
        return pa.table({"vec_id": ids[hit], "n": links[hit], "root": smallest[root][hit]})

    return compare


def _fitted(classes: DataFrame, n: int, labels: int, dim: int, threshold: float, slack: float, sample_rows: int, lists: int | None) -> Quantiser:
    scale = 1 << 30
    drawn = classes.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(scale)) < min(scale, scale * sample_rows // max(n, 1) + 1))
    rows = drawn.select("embedding").limit(2 * sample_rows).collect() or classes.select("embedding").limit(sample_rows).collect()
    sample = np.array([r.embedding for r in rows], np.float64).reshape(-1, dim)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    lists = lists or max(1, min(sample_rows // 16, n // (max(1, labels) * LIST_ROWS)))
    return Quantiser.fit(sample, lists, np.sqrt(max(0.0, 2 - 2 * threshold)), slack)


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, slack: float = 5.0, sample_rows: int = 8192,
                    lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; only rows of one label are compared.

    ``sample_rows`` bounds what the quantiser is fitted on; ``lists`` defaults to one for every
    ``LIST_ROWS`` distinct vectors of a label, at most a sixteenth of the sample.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"),
                          vectors[vector_col].cast(kind).alias("embedding"))
    own = [F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")]
    rest = rows.filter(~_usable()).select("vec_id", *own)
    dim = rows.filter(_usable()).agg(F.max(F.size("embedding"))).first()[0]
    if dim is None:
        return rest
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("embedding")).cast(kind))
    usable = checkpointed(rows.filter(_usable()).select(
        "vec_id", F.monotonically_increasing_id().alias("row"), filled.alias("embedding"),
        F.concat_ws("/", F.size("embedding").cast("string"), F.col("label").cast("string")).alias("label")))
    classed = checkpointed(looked_up(
        usable, ["label", "embedding"], F.col("row"), [F.min("row").alias("_r"), F.count("*").alias("_n"), F.min("vec_id").alias("_i")],
        [F.min("_r").alias("rep"), F.sum("_n").alias("weight"), F.min("_i").alias("low")]))
    firsts = classed.filter("row = rep")
    classes = firsts.select(F.col("row").alias("vec_id"), "label", "embedding", "weight")
    n, labels = classes.agg(F.count("*"), F.approx_count_distinct("label")).first()
    model = _fitted(classes, n, labels, dim, threshold, slack, sample_rows, lists)
    stars = checkpointed(_stars(checkpointed(_indexed(classes, model, dim)), model, dim, threshold))
    links = stars.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = connected_components(stars.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    linked = links.join(comps, links["vec_id"] == comps["id"]).select(F.col("vec_id").alias("rep"), "n", "component").join(
        firsts.select("rep", "low"), "rep")
    found = looked_up(linked, ["component"], F.col("rep"), [F.min("low").alias("_m")], [F.min("_m").alias("lowest")]).select("rep", "n", "lowest")
    salted = classed.select("vec_id", "rep", "weight", "low", F.pmod(F.xxhash64("row"), F.lit(32)).alias("_salt"))
    parts = salted.select("rep", "_salt").distinct().join(found, "rep")
    out = salted.join(parts, ["rep", "_salt"], "left").select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"),
        F.when(F.col("n").isNull(), F.col("low")).otherwise(F.col("lowest")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(rest)


def _usable() -> Column:
    """True for rows that can link: a label and a finite vector that is not zero; else false, never null."""
    e = F.col("embedding")
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    checks = [F.col("label").isNotNull(), F.size(e) > 0, finite, F.exists(e, lambda v: v != 0)]
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in checks])


def _indexed(classes: DataFrame, model: Quantiser, dim: int) -> DataFrame:
    """Every class with its list and the lists that it searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                home, near = model.searched(_unit(part, "embedding", dim))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(home, pa.int32()), pa.array([np.flatnonzero(n) for n in near], pa.list_(pa.int32()))],
                    [*part.schema.names, "home", "searched"])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, columns + ", home int, searched array<int>")


def _stars(indexed: DataFrame, model: Quantiser, dim: int, threshold: float) -> DataFrame:
    """Per vector and block pair: linked weight and the smallest id of its local component."""
    sent = indexed.withColumn("at", F.explode("searched")).drop("searched")
    sizes = indexed.groupBy("label", F.col("home").alias("at")).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = sent.groupBy("label", "at").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("asks"))
    sized = sent.join(small_side(sizes.join(asked, ["label", "at"])), ["label", "at"])
    mine = F.col("home") == F.col("at")
    pick = F.xxhash64("vec_id", F.lit("block"))
    # block pairs (i, j): members of block i against members of block j >= i, or against foreign block j
    member, foreign = F.pmod(pick, F.col("blocks")).cast("int"), (F.pmod(pick, F.col("asks")) + F.col("blocks")).cast("int")
    placed = sized.withColumn("block", F.when(mine, member).otherwise(foreign))
    as_member = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    with_foreign = F.transform(F.sequence(F.col("blocks"), F.col("blocks") + F.col("asks") - 1),
                               lambda x: F.struct(F.col("block").alias("i"), x.alias("j")))
    as_foreign = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("i"), F.col("block").alias("j")))
    pairs = placed.withColumn("pair", F.explode(F.when(mine, F.concat(as_member, with_foreign)).otherwise(as_foreign)))
    columns = ["vec_id", "label", "embedding", "weight", "home", "block", "at", "pair.i", "pair.j"]
    return pairs.select(*columns).groupBy("label", "at", "i", "j").applyInArrow(_block_links(model, dim, threshold), _STAR)
