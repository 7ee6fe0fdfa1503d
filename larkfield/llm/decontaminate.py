"""Passages of a benchmark found in documents by SimHash of item-sized windows.

Every benchmark item and every window of as many shingles has a fingerprint of ``BITS`` bits: each
five-word shingle votes on each bit with its hash, as often as it occurs. A fingerprint is cut into
``BLOCKS`` blocks of 16 bits. Two that differ in at most ``radius`` bits differ in some block by no
more than that block's share (``block_radii``: the shares plus one each add up to ``radius + 1``), so an
item is entered under every value within the share of each of its blocks, a window looks its own
blocks up, and the join misses no fingerprint within the radius. Candidates are verified by the
weighted Jaccard similarity of their shingles, a shingle weighing as often as it occurs.

A random pair of fingerprints meets in some block in 9.3 of 100 cases. At similarity 0.8 a bit
differs with probability 0.151, so a window lies within 43 of 192 bits in 99.7 of 100 cases, nearer ones
more often.

Which windows have a fingerprint: a similarity of ``t`` needs ``t / (1 + t)`` of the shingles of both
sides to be shared, so only windows are taken in which that many shingles occur in some item of the
window's size. Those shingles are bits of a filter of bounded size; a filter that fills up lets more
windows through and loses none. Whole texts are scanned for them. Windows of the same shingles are
looked up and verified once, whichever documents they stand in. The items stay a table.

Defined cases: null and empty texts or items match nothing; items or texts of fewer than five
words have one shingle of all their words; a window is cut at the text's ends; repeated documents
each give their own rows; items of equal words are one passage under their smallest id, ``n_items`` says
how many they are; null ids are passed on; equal similarities take the first window.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_slices
from larkfield.llm.words import mixed, shingle_hashes, word_hashes
from larkfield.session import fresh_path, small_side, within_bytes

BITS, BLOCK_BITS = 192, 16
BLOCKS, LONGS = BITS // BLOCK_BITS, BITS // 64
RADIUS = 43
#: Bits of the largest filter, 16 MB, and of a chunk of it.
FILTER_BITS, CHUNK_BITS = 27, 16
#: Words spanned by the windows whose fingerprints are computed together, beside one window's own.
_SPAN = 1 << 15
_PRINTS = [f"print{i}" for i in range(LONGS)]
_SALTS = [0, 0x6A09E667F3BCC908, 0xBB67AE8584CAA73B]


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / max(1, a.total() + b.total() - both)


def block_radii(radius: int = RADIUS) -> list[int]:
    """Bits by which each block may differ; with one more each they add up to ``radius + 1``."""
    least, more = divmod(radius + 1, BLOCKS)
    return [least + (i < more) - 1 for i in range(BLOCKS)]


def probe_masks(radius: int) -> np.ndarray:
    """All differences of a block of at most ``radius`` bits."""
    found = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BLOCK_BITS), k)]
    return np.array(found, np.int64)


def fingerprints(shingles: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One row of ``LONGS`` numbers for the shingles from ``low`` up to ``high``, for each pair of them."""
    out = np.empty((len(low), BITS // 8), np.uint8)
    for i, salt in enumerate(_SALTS):
        octets = (mixed(shingles ^ np.uint64(salt)) if salt else shingles).astype("<u8").view(np.uint8).reshape(-1, 8)
        for j in range(8):  # eight bits at a time bound the memory of a long item
            votes = np.unpackbits(octets[:, j : j + 1], axis=1, bitorder="little").astype(np.int32) * 2 - 1
            sums = np.concatenate([np.zeros((1, 8), np.int32), np.cumsum(votes, 0, dtype=np.int32)])
            out[:, 8 * i + j] = np.packbits(sums[high] - sums[low] > 0, axis=1, bitorder="little")[:, 0]
    return out.view("<i8")


def _places(shingles: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Filter bits of shingles of items with ``size`` shingles; size 0 stands for any item."""
    return (mixed(shingles ^ np.uint64((size + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class ItemFilter:
    """Which shingles occur in items of which size, as bits; and the sizes."""

    bits: int
    octets: np.ndarray
    sizes: np.ndarray
    threshold: float

    def has(self, shingles: np.ndarray, size: int) -> np.ndarray:
        at = _places(shingles, size, self.bits)
        return (self.octets[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0

    def windows(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Size, starts and ends of the windows that share enough with items of their size."""
        hits = np.flatnonzero(self.has(shingles, 0))
        for n in self.sizes[self.sizes * self.threshold <= len(hits)].tolist():
            at = hits[self.has(shingles[hits], n)]
            need = max(1, int(np.ceil(self.threshold * n - 1e-9)))  # a window cut to its shared part has so many
            if len(at) < need:
                continue
            first, last = at[: len(at) - need + 1], at[need - 1 :]
            near = last - first < n
            begin, end = last[near] - n + 1, first[near] + 1
            begin[1:] = np.maximum(begin[1:], end[:-1])  # both rise, so the union is a row of intervals
            length = np.maximum(end - begin, 0)
            start = np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())
            span = np.unique(np.stack([np.maximum(start, 0), np.minimum(start + n, len(shingles))], 1), axis=0)
            low, high = span[:, 0], span[:, 1]
            shared = np.searchsorted(at, high) - np.searchsorted(at, low)
            enough = shared * (1 + self.threshold) >= self.threshold * (n + high - low) - 1e-9
            if enough.any():
                yield n, low[enough], high[enough]


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that it is computed once."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _passages(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, n_items, n (shingles), shingles and fingerprint of every distinct item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            shingles, begin = shingle_hashes(*word_hashes(part.column("text").to_pylist()))
            own = [shingles[a:b].astype("<u8") for a, b in zip(begin, begin[1:])]
            prints = [fingerprints(s, np.array([0]), np.array([len(s)]))[0] for s in own]
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id"), pa.array(np.diff(begin), pa.int64()), pa.array([s.tobytes() for s in own], pa.binary()),
                 *(pa.array([p[i] for p in prints], pa.int64()) for i in range(LONGS))], ["item_id", "n", "shingles", *_PRINTS])

    plain = items.select(items[id_col].alias("item_id"), items[text_col].alias("text"))
    schema = f"item_id {plain.schema['item_id'].dataType.simpleString()}, n long, shingles binary, " + ", ".join(f"{p} long" for p in _PRINTS)
    same = plain.mapInArrow(run, schema).filter("n > 0").withColumn("item", F.xxhash64("shingles"))
    return _stored(same.groupBy("item", "n").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), *[F.min(c).alias(c) for c in ("shingles", *_PRINTS)]), "passages")


def _filter_of(passages: DataFrame, threshold: float) -> ItemFilter:
    """The filter, built in chunks by tasks; the driver holds no more than its bounded size."""
    entries = 2 * (passages.agg(F.sum("n").alias("n")).first().n or 0)
    bits = min(FILTER_BITS, max(CHUNK_BITS, (64 * entries).bit_length()))
    sizes = np.array(sorted(r.n for r in passages.select("n").distinct().collect()), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, np.ndarray] = {}
        for part in batches:
            for n, blob in zip(part.column("n").to_pylist(), part.column("shingles").to_pylist()):
                own = np.frombuffer(blob, "<u8")
                at = np.unique(np.concatenate([_places(own, 0, bits), _places(own, n, bits)]))
                for c in np.unique(at >> CHUNK_BITS).tolist():
                    flags = chunks.setdefault(c, np.zeros(1 << CHUNK_BITS, bool))
                    flags[at[at >> CHUNK_BITS == c] & (1 << CHUNK_BITS) - 1] = True
        yield _chunk_rows({c: np.packbits(f, bitorder="little") for c, f in chunks.items()}, pa.RecordBatch)

    def joined(group: pa.Table) -> pa.Table:
        both = [np.frombuffer(b, np.uint8) for b in group.column("octets").to_pylist()]
        return _chunk_rows({group.column("chunk")[0].as_py(): np.bitwise_or.reduce(both)}, pa.Table)

    schema = "chunk int, octets binary"
    octets = np.zeros(1 << bits - 3, np.uint8)
    for r in passages.select("n", "shingles").mapInArrow(run, schema).groupBy("chunk").applyInArrow(joined, schema).collect():
        octets[r.chunk << CHUNK_BITS - 3 : r.chunk + 1 << CHUNK_BITS - 3] = np.frombuffer(r.octets, np.uint8)
    return ItemFilter(bits, octets, sizes, threshold)


def _chunk_rows(chunks: dict[int, np.ndarray], kind: type) -> pa.RecordBatch | pa.Table:
    return kind.from_arrays([pa.array(chunks, pa.int32()), pa.array([o.tobytes() for o in chunks.values()], pa.binary())], ["chunk", "octets"])


_WINDOW = ["doc_id", "row", "key", "n", "low", "high", "content", *_PRINTS]


def _windows(docs: DataFrame, wanted: ItemFilter) -> DataFrame:
    """doc_id, row, key (of the text), n, low, high, content (its shingles as one hash) and fingerprint of every window."""

    def of_text(shingles: np.ndarray) -> Iterator[np.ndarray]:
        for n, low, high in wanted.windows(shingles):
            at = 0
            while at < len(low):
                end = int(np.searchsorted(low, low[at] + _SPAN))
                a, b = low[at:end], high[at:end]
                base, own = a[0], shingles[a[0] : b[-1]]
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(own), dtype=np.uint64)])
                content = (sums[b - base] - sums[a - base]).view(np.int64)
                yield np.column_stack([np.full(len(a), n), a, b, content, fingerprints(own, a - base, b - base)])
                at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            shingles, begin = shingle_hashes(*word_hashes(part.column("text").to_pylist()))
            maybe = np.concatenate([[0], np.cumsum(wanted.has(shingles, 0))]) if len(shingles) else np.zeros(1, int)
            for k in np.flatnonzero(np.diff(maybe[begin]) > 0).tolist():
                for rows in of_text(shingles[begin[k] : begin[k + 1]]):
                    ids = [pa.repeat(part.column(c)[k], len(rows)) for c in _WINDOW[:3]]
                    yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c) for c in np.ascontiguousarray(rows.T))], _WINDOW)

    return _stored(docs.select("doc_id", "row", "key", "text").mapInArrow(run, ", ".join(f"{c} long" for c in _WINDOW)), "windows")


def _block_code(i: int, value: Column) -> Column:
    """One number for a window's size, a block's number and its value."""
    return F.shiftleft("n", 20) + F.lit(i << BLOCK_BITS) + value


def within_radius(windows: DataFrame, passages: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct (content, n, item) whose fingerprints differ in at most ``radius`` bits, by the block index."""
    masks = [probe_masks(r) for r in block_radii(radius)]
    names = ["code", "item", *(f"item_{p}" for p in _PRINTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for i, mask in enumerate(masks):
                    value = (row[_PRINTS[i // 4]] >> BLOCK_BITS * (i % 4)) & (1 << BLOCK_BITS) - 1
                    codes = (row["n"] << 20) + (i << BLOCK_BITS) + (mask ^ value)
                    rest = [np.full(len(codes), row[c], np.int64) for c in ("item", *_PRINTS)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (codes, *rest)], names)

    entered = passages.select("item", "n", *_PRINTS).mapInArrow(run, ", ".join(f"{c} long" for c in names))
    own = [_block_code(i, F.shiftrightunsigned(_PRINTS[i // 4], BLOCK_BITS * (i % 4)).bitwiseAND((1 << BLOCK_BITS) - 1)) for i in range(BLOCKS)]
    asked = windows.select("content", "n", *_PRINTS, F.explode(F.array(*own)).alias("code"))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"item_{p}"))) for p in _PRINTS), F.lit(0))
    # an item is entered some 6,000 times, which Spark's estimate of the table's size does not see: never broadcast it
    return asked.join(entered.hint("merge"), "code").filter(apart <= radius).select("content", "n", "item").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """content, n, item and similarity of the candidates that reach it; one text's candidates meet it in one group."""

    def run(candidates: pa.Table, text: pa.Table) -> pa.Table:
        found: list[tuple] = []
        shingles = shingle_hashes(*word_hashes(text.column("text").to_pylist()[:1]))[0]
        blobs: dict[int, bytes] = {}
        asked: dict[int, list[tuple]] = {}
        for c in candidates.to_pylist():
            blobs[c["item"]] = c["shingles"]
            asked.setdefault(c["item"], []).append((c["low"], c["high"], c["content"], c["n"]))
        for item, spans in asked.items():
            distinct, times = np.unique(np.frombuffer(blobs[item], "<u8"), return_counts=True)
            base = min(s[0] for s in spans)
            own = shingles[base : max(s[1] for s in spans)]
            at = np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)
            at = np.where(distinct[at] == own, at, len(distinct))
            for low, high, content, n in spans:
                held = np.bincount(at[low - base : high - base], minlength=len(distinct) + 1)[:-1]
                both = int(np.minimum(held, times).sum())
                similarity = both / max(1, n + high - low - both)
                if similarity >= threshold:
                    found.append((content, n, item, similarity))
        columns = list(zip(*found)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["content", "n", "item", "similarity"])

    return pairs.groupBy("key").cogroup(texts.groupBy("key")).applyInArrow(run, "content long, n long, item long, similarity double")


def _search(texts: DataFrame, items: DataFrame, threshold: float, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of ``texts`` (doc_id, row, key, text), the verified (content, n, item, similarity), and the passages."""
    passages = _passages(items, id_col, text_col)
    windows = _windows(texts, _filter_of(passages, threshold))
    # windows of the same shingles are one; the one in the text of the smallest key stands for all
    single = _stored(windows.groupBy("content", "n").agg(
        F.min(F.struct("key", "low", "high")).alias("at"), *[F.min(p).alias(p) for p in _PRINTS]), "contents")
    near = within_radius(single, passages, radius)
    pairs = near.join(single.select("content", "n", "at.*"), ["content", "n"]).join(within_bytes(passages.select("item", "shingles")), "item")
    pairs = _stored(pairs, "candidates")
    asked = small_side(pairs.select("key").distinct())
    own = texts.select("key", "text").join(asked, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    return windows, _stored(_verified(pairs, own, threshold), "matches"), passages


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id",
                       text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_items, similarity and first_word for every passage that a document holds."""
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), _text_key(docs[text_col]).alias("key"))
    # rows are numbered so that repeated ones stay apart; the numbers are stored with the windows
    numbered = plain.withColumn("row", F.monotonically_increasing_id())
    windows, matches, passages = _search(numbered, items, threshold, radius, item_id_col, item_text_col)
    best = windows.join(within_bytes(matches), ["content", "n"]).groupBy("doc_id", "row", "item").agg(
        F.min(F.struct((-F.col("similarity")).alias("far"), "low")).alias("best"))
    found = best.join(within_bytes(passages.select("item", "item_id", "n_items")), "item")
    return found.select("doc_id", "item_id", "n_items", (-F.col("best.far")).alias("similarity"), F.col("best.low").alias("first_word"))


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS, text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of the documents that hold no passage of the benchmark."""
    texts = docs.select(docs[text_col].alias("text"), _text_key(docs[text_col]).alias("key"), *(F.lit(0).cast("long").alias(c) for c in ("doc_id", "row")))
    windows, matches, _ = _search(texts, items, threshold, radius, item_id_col, item_text_col)
    held = windows.join(small_side(matches.select("content", "n").distinct()), ["content", "n"], "left_semi").select(F.col("key").alias("_key")).distinct()
    key = next(name for name in ("_key" + "_" * i for i in range(len(docs.columns) + 1)) if name.lower() not in {c.lower() for c in docs.columns})
    held = small_side(held.withColumnRenamed("_key", key))
    return docs.join(held, _text_key(docs[text_col]) == held[key], "left_anti")
