"""Bigram language model by deleted interpolation, its weights learned by expectation-maximisation.

The probability of a token after a context mixes three maximum-likelihood estimates: the bigram's, the
unigram's and the uniform one. How they are mixed depends on how often the context was seen, in buckets
of powers of two. A fold of the training documents is deleted from the counts, the weights of each
bucket are fitted to the tokens of that fold, and the final model then counts all training
documents.

How the counts meet the texts: documents are dealt into blocks by a hash of their id. A block sends the
sorted hashes of its distinct n-grams, with their training counts, cut into ranges of the hash; the
task of a range adds up all blocks and answers every block with the totals in the order of the
block's own list, so answers need no keys. Frequent n-grams come once per block, and no
task holds more than a range or a block. All documents are counted and scored.

Texts go to their blocks once to be counted and once to be scored, the deleted fold once more. Before each deal a task
gathers its documents by block and compresses them, so that this takes less disk than the texts themselves.

Expectation-maximisation sees every token of the deleted fold as a pair of ratios to the uniform
estimate, rounded to an eighth of an octave, with the number of tokens that have it; the table of such
pairs has a bounded size at any input.

Defined cases: null and empty texts are one end token; texts that repeat count as often as they occur;
without training documents every known count is 0 and probabilities are uniform; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.packing import packed, unpacked
from larkfield.llm.words import byte_values, mixed, word_hashes
from larkfield.session import checkpointed

#: Bytes of text in a block.
BLOCK_BYTES = 12 << 20
#: Bytes of documents that a task gathers before it deals them.
HELD_BYTES = 64 << 20
BUCKETS, STEPS = 32, 8
TRAIN, DELETED = 1, 2

_TOKEN_BYTES = byte_values([0x20, *range(0x09, 0x0E)], {b: b + 32 for b in range(65, 91)})
_END, _START = np.uint64(0x5AFE5AFE5AFE5AFE), np.uint64(0x51A7751A7751A775)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes with an end token after each text, hashes of the bigrams they end, and first tokens."""
    words, first = word_hashes(texts, _TOKEN_BYTES)
    begin = first + np.arange(len(first))
    token = np.empty(begin[-1], np.uint64)
    last = np.zeros(begin[-1], bool)
    last[begin[1:] - 1] = True
    token[last], token[~last] = _END, words
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[begin[:-1][np.diff(begin) > 0]] = _START
    return token, mixed(before * _LEFT + token * _RIGHT), begin


def _compressed(docs: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=3)
    with pa.ipc.new_stream(sink, docs.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as writer:
        writer.write_table(docs)
    return sink.getvalue().to_pybytes()


def _by_block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row per block: its documents of these batches as a compressed Arrow stream."""
    rows = pa.Table.from_batches(batches).sort_by("block").combine_chunks()
    block = rows.column("block").to_numpy()
    begin = np.flatnonzero(np.diff(block, prepend=-1))
    docs = rows.select(["doc_id", "text", "role"])
    pieces = [_compressed(docs.slice(a, b - a)) for a, b in zip(begin, np.append(begin[1:], len(block)))]
    return pa.record_batch({"block": pa.array(block[begin], pa.int64()), "docs": pa.array(pieces, pa.binary())})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    try:
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= HELD_BYTES:
                yield _by_block(held)
                held, size = [], 0
        if held:
            yield _by_block(held)
    finally:
        held = batch = None
        pa.default_memory_pool().release_unused()


def _docs(group: pa.Table) -> pa.Table:
    """doc_id, text and role of a block, from its compressed pieces."""
    return pa.concat_tables([pa.ipc.open_stream(piece).read_all() for piece in group.column("docs").to_pylist()])


def _sent(parts: int) -> Callable[[pa.Table], pa.Table]:
    """A block's distinct n-grams: per n and hash range the sorted hashes and training counts.

    Only blocks of the deleted fold ask; all that they count is deleted.
    """

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        docs = _docs(group)
        token, pair, begin = tokens(docs.column("text").to_pylist())
        role = docs.column("role").to_numpy()
        train = np.repeat(role >= TRAIN, np.diff(begin))
        rows, asks = [], bool((role >= DELETED).any())
        for n, grams in ((1, token), (2, pair)):
            keys, index = np.unique(grams, return_inverse=True)
            trained = np.bincount(index[train], minlength=len(keys))
            range_of = _range_of(keys, parts)
            edges = np.searchsorted(range_of, np.arange(parts + 1))
            for part in np.unique(range_of).tolist():
                a, b = edges[part], edges[part + 1]
                steps = np.diff(keys[a:b], prepend=np.uint64(0))
                rows.append((n, part, block, packed(steps), packed(trained[a:b], dense=True)))
        n, part, blocks, *blobs = zip(*rows)
        return pa.table({"n": pa.array(n, pa.int32()), "part": pa.array(part, pa.int32()), "block": pa.array(blocks, pa.int64()),
                         "asks": pa.array([asks] * len(rows)), **{c: pa.array(x, pa.binary()) for c, x in zip(("keys", "train"), blobs)}})

    return run


def _range_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


def _totals(group: pa.Table) -> pa.Table:
    """Add up one range of all blocks; one answer per block, the range's sums beside the first."""
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    train = np.concatenate([unpacked(x) for x in group.column("train").to_pylist()])
    asks = group.column("asks").to_pylist()  # only blocks of the deleted fold ask what was deleted
    deleted = np.repeat(asks, [len(k) for k in keys])
    distinct, index = np.unique(np.concatenate(keys), return_inverse=True)
    trained = np.bincount(index, weights=train, minlength=len(distinct)).astype(np.int64)
    removed = np.bincount(index[deleted], weights=train[deleted], minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    answers = [(packed(trained[i], dense=True), packed(removed[i], dense=True) if ask else b"") for i, ask in zip(np.split(index, ends[:-1]), asks)]
    left = trained - removed
    sums = [int(trained.sum()), int((trained > 0).sum()), int(left.sum()), int((left > 0).sum())]
    extra = {name: pa.array([v] + [0] * (len(keys) - 1), pa.int64()) for name, v in zip(("tokens", "types", "left_tokens", "left_types"), sums)}
    return pa.table({"n": group.column("n"), "part": group.column("part"), "block": group.column("block"),
                     "train": pa.array([a for a, _ in answers], pa.binary()), "deleted": pa.array([b for _, b in answers], pa.binary()), **extra})


_ANSWER = "n int, part int, block long, train binary, deleted binary, tokens long, types long, left_tokens long, left_types long"


def _counts(docs: pa.Table, answers: pa.Table, left: bool = False) -> dict[str, np.ndarray]:
    """Per token of a block: count of the token, of the bigram it ends and of its context."""
    token, pair, begin = tokens(docs.column("text").to_pylist())
    order = answers.sort_by([("n", "ascending"), ("part", "ascending")])
    ns = order.column("n").to_numpy()
    out = {"begin": begin}
    total: dict[int, np.ndarray] = {}
    for n, grams in ((1, token), (2, pair)):
        keys, index = np.unique(grams, return_inverse=True)
        kept = [b for b, m in zip(order.column("train").to_pylist(), ns) if m == n]
        total[n] = np.concatenate([unpacked(b) for b in kept]).astype(np.int64)
        if left:
            gone = [b for b, m in zip(order.column("deleted").to_pylist(), ns) if m == n]
            total[n] = total[n] - np.concatenate([unpacked(b) for b in gone]).astype(np.int64)
        out["token" if n == 1 else "pair"] = total[n][index]
        if n == 1:
            ends = total[1][np.searchsorted(keys, _END)]
    context = np.empty_like(out["token"])
    context[1:] = out["token"][:-1]
    context[begin[:-1]] = ends  # a text begins as often as it ends
    out["context"] = context
    return out


@dataclass
class Weights:
    """Mixture weights of bigram, unigram and uniform estimates, by bucket of the context's count."""

    by_bucket: np.ndarray

    @staticmethod
    def bucket(context: np.ndarray) -> np.ndarray:
        return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)

    @classmethod
    def learned(cls, table: list[tuple[int, int, int, int]], rounds: int = 60) -> Weights:
        """EM per bucket over (bucket, bigram ratio, unigram ratio, tokens); ratios in eighths of an octave."""
        weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
        rows = np.array(table, np.int64).reshape(-1, 4)
        for b in np.unique(rows[:, 0]).tolist():
            own = rows[rows[:, 0] == b]
            ratio = np.stack([_ratio(own[:, 1]), _ratio(own[:, 2]), np.ones(len(own))], 1)
            w = np.array([0.4, 0.5, 0.1]) if b else np.array([0.0, 0.9, 0.1])
            for _ in range(rounds):
                share = ratio * w
                share /= share.sum(1, keepdims=True)
                w = (share * own[:, 3:]).sum(0) / own[:, 3].sum()
                w = np.maximum(w, [1e-9 if b else 0.0, 1e-9, 1e-9])
                w /= w.sum()
            weights[b] = w
        met = set(rows[:, 0].tolist())
        for b in range(2, BUCKETS):  # a bucket that the fold never met mixes as the one before
            if b not in met:
                weights[b] = weights[b - 1]
        return cls(weights)


def _ratio(code: np.ndarray) -> np.ndarray:
    return np.where(code == _NONE, 0.0, 2.0 ** (code / STEPS))


_NONE = -(1 << 20)


def _estimates(counts: dict[str, np.ndarray], n_tokens: int, types: int) -> tuple[np.ndarray, np.ndarray, float]:
    bigram = np.where(counts["context"] > 0, counts["pair"] / np.maximum(counts["context"], 1), 0.0)
    return bigram, counts["token"] / max(n_tokens, 1), 1.0 / (types + 1)


def _ratio_table(left_tokens: int, left_types: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        counts = _counts(_docs(group), answers, left=True)
        bigram, unigram, uniform = _estimates(counts, left_tokens, left_types)

        def code(p: np.ndarray) -> np.ndarray:
            return np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) / uniform)), _NONE).astype(np.int64)

        rows = np.stack([Weights.bucket(counts["context"]), code(bigram), code(unigram)], 1)
        distinct, times = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(distinct[:, 0], pa.int32()), "bigram": pa.array(distinct[:, 1], pa.int32()),
                         "unigram": pa.array(distinct[:, 2], pa.int32()), "n": pa.array(times, pa.int64())})

    return run


def _scores(weights: Weights, n_tokens: int, types: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _docs(group)
        counts = _counts(docs, answers)
        begin = counts["begin"]
        bigram, unigram, uniform = _estimates(counts, n_tokens, types)
        w = weights.by_bucket[Weights.bucket(counts["context"])]
        mix = np.log10(w[:, 0] * bigram + w[:, 1] * unigram + w[:, 2] * uniform)
        base = np.log10((counts["token"] + 0.5) / (n_tokens + 0.5 * (types + 1)))
        sums = [np.add.reduceat(x, begin[:-1]) for x in (mix, base, (counts["token"] > 0).astype(np.int64))]
        return pa.table({"doc_id": docs.column("doc_id"), "n_tokens": pa.array(np.diff(begin), pa.int64()),
                         "n_known": pa.array(sums[2], pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[0])})

    return run


def score_documents(docs: DataFrame, train: Column, deleted: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    ``train`` says which documents are learned from, ``deleted`` which of those make the deleted fold.
    """
    role = F.when(F.coalesce(train, F.lit(False)), F.when(F.coalesce(deleted, F.lit(False)), DELETED).otherwise(TRAIN)).otherwise(0)
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), role.cast("int").alias("role"))
    size = plain.agg(F.sum(F.octet_length("text") + 1).alias("bytes")).first().bytes or 1
    blocks = max(8, -(-int(size) // BLOCK_BYTES))
    # the deleted fold has blocks of its own, so that it can be read alone
    at = F.xxhash64("doc_id", "text")  # rows that share an id or have none spread by their text
    block = F.when(F.col("role") == DELETED, F.pmod(at, F.lit(-(-blocks // 4))) + blocks).otherwise(F.pmod(at, F.lit(blocks)))
    placed = plain.withColumn("block", block)

    def dealt(docs: DataFrame):
        return docs.mapInArrow(_pieces, "block long, docs binary").groupBy("block")

    sent = dealt(placed).applyInArrow(_sent(blocks), "n int, part int, block long, asks boolean, keys binary, train binary")
    answers = checkpointed(sent.groupBy("n", "part").applyInArrow(_totals, _ANSWER))
    known = answers.filter("n = 1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "left_tokens", "left_types")]).first()
    of_fold = answers.filter(F.col("block") >= blocks).select("n", "part", "block", "train", "deleted")
    ratios = dealt(placed.filter(F.col("role") == DELETED)).cogroup(of_fold.groupBy("block")).applyInArrow(
        _ratio_table(known.left_tokens, known.left_types), "bucket int, bigram int, unigram int, n long")
    table = ratios.groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n")).collect()  # bounded by the rounding
    weights = Weights.learned([(r.bucket, r.bigram, r.unigram, r.n) for r in table])
    scored = dealt(placed).cogroup(answers.select("n", "part", "block", "train").groupBy("block")).applyInArrow(
        _scores(weights, known.tokens, known.types), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(known.tokens).cast("long"))
