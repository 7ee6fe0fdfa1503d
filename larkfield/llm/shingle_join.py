"""Documents whose five-word shingles have a Jaccard similarity of 0.8 or more, by MinHash LSH in fixed bands.

Every document has a signature of ``TREES`` prefixes, each a hash of as many MinHash values; documents
with an equal prefix in any tree are candidates. The length of the prefixes is one number for all
documents, the longest with which the recall that the threshold and the number of trees give,
``1 - (1 - t**depth) ** TREES``, reaches the target. Prefixes are not shortened adaptively.

* Documents with equal shingle sets are one class and enter the trees once.
* The prefixes are sorted by range over (tree, prefix, id), so a prefix that a third of all documents share
  lies in many tasks; each task ties the members of a run to its first, the driver only ties runs
  that go on in the next task. The ties' components hold all candidates of a document together.
* Components are verified exactly on whole shingle sets, in pairs of blocks of bounded size: a block
  pair gives back sums and a spanning star per document, never its pairs. A pair is verified if
  its prefixes are equal in any tree.

Small sets use independent hash functions, large ones the minima of equal parts of the hash range;
sizes near the border use both, so two similar sets always share one kind.

Defined cases: texts without a word (null, empty, punctuation) link with nothing, also not with each
other; texts of fewer than five words have one shingle. A copy of a text counts as a link, also if
it has the same id or none. Rows are told apart by a hash of id and text and classes by a row number, so
ids may repeat or be null. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_slices
from larkfield.llm.components import SALTS, connected_components, join, looked_up, roots
from larkfield.llm.words import mixed, shingle_hashes, word_hashes
from larkfield.session import checkpointed

TREES, LEVELS = 24, 8
#: Sets up to SMALL shingles have independent MinHash paths, sets from LARGE on partitioned ones.
LARGE, SMALL = 256, 320
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 24

_rng = np.random.default_rng(11)
_factor = _rng.integers(1, 1 << 63, TREES * LEVELS, dtype=np.uint64) | np.uint64(1)
_shift = _rng.integers(0, 1 << 63, TREES * LEVELS, dtype=np.uint64)
_tree_step = _rng.integers(1, 1 << 63, LEVELS, dtype=np.uint64) | np.uint64(1)


def forest_depth(threshold: float, recall: float, trees: int = TREES, levels: int = LEVELS) -> int:
    """The longest prefix whose matches in any tree reach ``recall`` at ``threshold``."""
    return next((d for d in range(levels, 0, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def _minima(own: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values of a small set, one hash function each."""
    return (mixed(own[:, None] * _factor[None, :n] + _shift[None, :n])).min(0)


def _range_minima(own: np.ndarray, n: int) -> np.ndarray:
    """Smallest hash in each of ``n`` equal ranges of a sorted set; empty ranges take the next one's."""
    edges = (np.arange(n + 1, dtype=object) * (1 << 64) // n)
    low = np.array(edges[:-1], dtype=np.uint64)
    at = np.searchsorted(own, low)
    value = own[np.minimum(at, len(own) - 1)]
    filled = (at < len(own)) & (np.searchsorted(low, value, "right") - 1 == np.arange(n))
    if not filled.all():
        source = np.flatnonzero(filled)
        take = source[np.searchsorted(source, np.arange(n)) % len(source)]
        value = mixed(value[take] + ((take - np.arange(n)) % n).astype(np.uint64))
    return value


def _prefixes(own: np.ndarray, depth: int) -> list[np.ndarray]:
    """Prefix hash per tree: the first half of the list for small sets, the second for large ones."""
    kinds = []
    for active, minima in ((len(own) <= SMALL, _minima), (len(own) >= LARGE, _range_minima)):
        if active:
            path = minima(own, TREES * depth).reshape(TREES, depth)
            kinds.append(mixed((path * _tree_step[None, :depth]).sum(1, dtype=np.uint64)).view(np.int64))
        else:
            kinds.append(None)
    return kinds


def _sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    shingles, begin = shingle_hashes(*word_hashes(texts))
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        yield np.unique(shingles[a:b])


def _signatures(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            high, low, n_bytes, tree, prefix = [], [], [], [], []
            for own, text in zip(_sets(texts := part.column("text").to_pylist()), texts):
                n_bytes.append(len(text or ""))
                if not len(own):
                    high.append(None), low.append(None), tree.append([]), prefix.append([])
                    continue
                place = np.arange(1, len(own) + 1, dtype=np.uint64)
                high.append(int(mixed(own * place).sum(dtype=np.uint64).view(np.int64)))
                low.append(int((mixed(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(own))).view(np.int64)))
                kinds = _prefixes(own, depth)
                tree.append(np.concatenate([np.arange(TREES, dtype=np.int32) + k * TREES for k, p in enumerate(kinds) if p is not None]))
                prefix.append(np.concatenate([p for p in kinds if p is not None]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("doc_id", "key1", "key2")), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(n_bytes, pa.int64()),
                 pa.array(tree, pa.list_(pa.int32())), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "key1", "key2", "high", "low", "n_bytes", "trees", "prefixes"])

    return run


def _ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tie the members of each run of equal (tree, prefix) to the run's first; rows come sorted.

    kind 0 is a tie; kinds 1 and 2 are the first and the last run of the task, with their first member.
    """
    schema = pa.schema([("kind", pa.int32()), ("task", pa.int32()), ("tree", pa.int32()), ("prefix", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    task, last = TaskContext.get().partitionId(), None

    def ends(kind: int, tree: int, prefix: int, head: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": kind, "task": task, "tree": tree, "prefix": prefix, "a": head, "b": head}], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, prefix, ids = (batch.column(c).to_numpy() for c in ("tree", "prefix", "id"))
        new = np.ones(len(ids), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1])
        head = ids[np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        if last is None:
            yield ends(1, int(tree[0]), int(prefix[0]), int(ids[0]))
        elif last[:2] == (int(tree[0]), int(prefix[0])):  # the run goes on from the batch before
            head[: int(np.append(np.flatnonzero(new)[1:], len(ids))[0])] = last[2]
        tied = ids != head
        n = int(tied.sum())
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
                np.zeros(n, np.int32), np.full(n, task, np.int32), tree[tied], prefix[tied], ids[tied], head[tied])], schema=schema)
        last = (int(tree[-1]), int(prefix[-1]), int(head[-1]))
    if last is not None:
        yield ends(2, *last)


def _candidates(reps: DataFrame) -> DataFrame:
    """Ties (a, b) between classes that share a prefix in any tree."""
    spark = reps.sparkSession
    paths = reps.select(F.col("rep").alias("id"), F.explode(F.arrays_zip("trees", "prefixes")).alias("p")).select(
        F.col("p.trees").alias("tree"), F.col("p.prefixes").alias("prefix"), "id")
    ordered = paths.repartitionByRange("tree", "prefix", "id").sortWithinPartitions("tree", "prefix", "id")
    found = checkpointed(ordered.mapInArrow(_ties, "kind int, task int, tree int, prefix long, a long, b long"))
    ends = sorted(found.filter("kind > 0").collect(), key=lambda r: (r.task, r.kind))  # two rows a task
    over = [(int(n.a), int(p.a)) for p, n in zip(ends, ends[1:]) if p.kind == 2 and n.kind == 1 and (p.tree, p.prefix) == (n.tree, n.prefix)]
    ties = found.filter("kind = 0").select("a", "b")
    return ties.unionByName(spark.createDataFrame(over, "a long, b long")) if over else ties


def _overlaps(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets' pairs (a, b)."""
    rows = np.unique(np.concatenate([a, b]))
    place = np.zeros(len(sets), np.int64)
    place[rows] = np.arange(len(rows))
    values = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    distinct, column, times = np.unique(values, return_inverse=True, return_counts=True)
    if len(a) * 40 < len(rows) ** 2 or len(rows) < 24:  # few pairs: meet one by one
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist())])
    shared = times[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(rows), len(rows)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        dense = np.zeros((len(rows), width), np.float32)
        dense[owner[low:high], column[low:high] - start] = 1
        total += dense @ dense.T
    return total[place[a], place[b]].astype(np.int64)


def _verify(threshold: float, depth: int):
    def component(ids: np.ndarray, weight: np.ndarray, block: np.ndarray, sets: list[np.ndarray], paths: np.ndarray, i: int, j: int):
        m, q = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, parent = np.zeros(len(ids), np.int64), np.arange(len(ids))
        size = np.array([len(s) for s in sets])
        matched = np.zeros((len(m), len(q)), bool)
        for column in range(paths.shape[1]):
            x, y = paths[m, column], paths[q, column]
            matched |= (x[:, None] == y[None]) & (x[:, None] != 0)
        if i == j:
            matched = np.triu(matched, 1)
        few, many = np.minimum(size[m][:, None], size[q][None]), np.maximum(size[m][:, None], size[q][None])
        a, b = np.nonzero(matched & (few >= threshold * many - 1e-9))
        a, b = m[a], q[b]
        if len(a):
            common = _overlaps(sets, a, b)
            alike = common >= threshold * (size[a] + size[b] - common) - 1e-9
            a, b = a[alike], b[alike]
            np.add.at(links, a, weight[b])
            np.add.at(links, b, weight[a])
            join(parent, a, b)
        root = roots(parent)
        smallest = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(smallest, root, ids)
        hit = links > 0
        return ids[hit], links[hit], smallest[root][hit]

    def run(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        group = group.sort_by("component")
        comp = group.column("component").to_numpy()
        ids, weight, block = (group.column(c).to_numpy() for c in ("rep", "weight", "block"))
        sets: list[np.ndarray] = []
        for start in range(0, len(ids), 256):
            sets += _sets(group.column("text").slice(start, 256).to_pylist())
        edges = np.flatnonzero(np.append(True, comp[1:] != comp[:-1]))
        out = []
        for low, high in zip(edges, [*edges[1:], len(comp)]):
            own = sets[low:high]
            paths = np.zeros((high - low, 2 * TREES), np.int64)
            for r, s in enumerate(own):
                for k, p in enumerate(_prefixes(s, depth)):
                    if p is not None:
                        paths[r, k * TREES : (k + 1) * TREES] = p
            out.append(component(ids[low:high], weight[low:high], block[low:high], own, paths, i, j))
        return pa.table({n: np.concatenate([o[k] for o in out]) for k, n in enumerate(("rep", "n", "root"))})

    return run


def _stars(members: DataFrame, docs: DataFrame, threshold: float, depth: int) -> DataFrame:
    """Verified links of the candidate components: per class linked weight and local root."""
    cut = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.least(F.col("rows"), F.ceil(F.col("bytes") / BLOCK_BYTES)))
    sized = checkpointed(looked_up(members, ["component"], F.col("rep"), [F.count("*").alias("_c"), F.sum("n_bytes").alias("_s")],
                                   [F.sum("_c").alias("rows"), F.sum("_s").alias("bytes")]).withColumn("blocks", cut.cast("int")))
    total = sized.agg(F.sum("n_bytes")).first()[0] or 0
    bins = max(1, int(total) // (BLOCK_BYTES // 4))
    if not members.filter("no_id").isEmpty():  # copies without an id share their key
        docs = docs.filter("doc_id IS NOT NULL").unionByName(docs.filter("doc_id IS NULL").dropDuplicates(["key1", "key2"]))
    texts = docs.join(sized, ["key1", "key2"]).dropDuplicates(["key1", "key2"])
    one = F.col("blocks") <= 1
    placed = texts.withColumn("block", F.when(one, 0).otherwise(F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks"))).cast("int"))
    bin_of = F.when(one, F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(-1 - F.col("component"))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.col("blocks"), F.lit(1)) - 1), lambda x: F.struct(
        F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    spread = placed.select("rep", "weight", "component", "text", "block", bin_of.alias("bin"), F.explode(pairs).alias("pair"))
    columns = ["rep", "weight", "component", "text", "block", "bin", "pair.i", "pair.j"]
    return spread.select(*columns).groupBy("bin", "i", "j").applyInArrow(_verify(threshold, depth), "rep long, n long, root long")


def _row_keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """128 bits of id and text, equal for rows that share both."""
    own, text = docs[id_col].cast("long"), docs[text_col]
    return [F.xxhash64(own.isNull(), own, text.isNull(), text), F.xxhash64(text, text.isNull(), F.lit(7), own, own.isNull())]


def _classes(docs: DataFrame, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, class_id, n_links and set_id of every row, its key and the number of its class (null without a word)."""
    depth = forest_depth(threshold, recall)
    key1, key2 = _row_keys(docs, id_col, text_col)
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), key1.alias("key1"), key2.alias("key2"))
    # numbers of rows without an id are the largest: a class is called by a row that has one
    number = F.monotonically_increasing_id() + F.when(F.col("doc_id").isNull(), F.lit(1 << 62)).otherwise(F.lit(0))
    signed = checkpointed(plain.mapInArrow(
        _signatures(depth), "doc_id long, key1 long, key2 long, high long, low long, n_bytes long, trees array<int>, prefixes array<long>")
        .withColumn("row", number))
    usable = F.col("high").isNotNull()
    classed = checkpointed(looked_up(
        signed.filter(usable), ["high", "low"], F.col("row"), [F.min("row").alias("_r"), F.count("*").alias("_n"), F.min("doc_id").alias("_i")],
        [F.min("_r").alias("rep"), F.sum("_n").alias("weight"), F.min("_i").alias("set_id")]).drop("high", "low"))
    reps = classed.filter("row = rep")
    candidates = connected_components(_candidates(reps))
    members = reps.select("rep", "weight", "n_bytes", "key1", "key2", F.col("doc_id").isNull().alias("no_id")).join(
        candidates, reps["rep"] == candidates["id"]).drop("id")
    stars = checkpointed(_stars(members, plain, threshold, depth))
    links = stars.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = connected_components(stars.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = links.join(comps, links["rep"] == comps["id"]).select("rep", "n", "component").join(reps.select("rep", "set_id"), "rep")
    found = looked_up(named, ["component"], F.col("rep"), [F.min("set_id").alias("_m")], [F.min("_m").alias("class_id")]).drop("set_id")
    salted = classed.select("doc_id", "key1", "key2", "row", "rep", "weight", "set_id").withColumn("_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    sent = salted.select("rep", "_salt").distinct().join(found, "rep")
    linked = salted.join(sent, ["rep", "_salt"], "left").select(
        "doc_id", F.coalesce("class_id", "set_id").alias("class_id"),
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), "set_id",
        "key1", "key2", "row", F.coalesce("component", "rep").alias("number"))
    alone = signed.filter(~usable).select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"),
        "key1", "key2", "row", F.lit(None).cast("long").alias("number"))
    return linked.unionByName(alone)


def similar_documents(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """doc_id, class_id (smallest id reachable by links), n_links and set_id (smallest id with equal shingles) of every row.

    class_id and set_id are null if no row of the class has an id.
    """
    return _classes(docs, threshold, recall, id_col, text_col).select("doc_id", "class_id", "n_links", "set_id")


def keep_one_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each class: of the rows that have an id the smallest, of those without one any.

    So a class with and without ids keeps two rows. Rows without a word are in no class and stay. If
    the smallest id has several texts in the class, the smallest key of a row decides; of rows that
    repeat id and text one stays.
    """
    rows = _classes(docs, threshold, recall, id_col, text_col).filter("n_links > 0").select(
        "doc_id", "key1", "key2", "row", "number", F.col("doc_id").isNull().alias("no_id"))
    first = looked_up(rows, ["number", "no_id"], F.col("row"), [F.min(F.struct("doc_id", "key1", "key2")).alias("_f")], [F.min("_f").alias("first")])
    stays = (F.col("key1") == F.col("first.key1")) & (F.col("key2") == F.col("first.key2"))
    fates = checkpointed(first.groupBy(F.col("key1").alias("_key1"), F.col("key2").alias("_key2")).agg(
        F.max(stays).alias("_stays"), F.count("*").alias("_times")))

    def of(frame: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
        key1, key2 = _row_keys(frame, id_col, text_col)
        return frame.join(chosen, (key1 == chosen["_key1"]) & (key2 == chosen["_key2"]), how)

    kept = of(docs, fates.filter("NOT _stays").select("_key1", "_key2"), "left_anti")
    again = fates.filter("_stays AND _times > 1").select("_key1", "_key2")
    if again.isEmpty():
        return kept
    # rows that repeat id and text: one of each key, whatever the table's columns are called
    repeated = of(kept, again, "left_semi")
    whole = F.struct(*[repeated[c] for c in repeated.columns])
    key1, key2 = _row_keys(repeated, id_col, text_col)
    one = repeated.select(key1.alias("key1"), key2.alias("key2"), whole.alias("row")).dropDuplicates(["key1", "key2"]).select("row.*")
    return of(kept, again, "left_anti").unionByName(one)
