"""Documents packed whole into token sequences of bounded length.

Tasks encode the documents where they are read, cut only those longer than a sequence, and store a row per
piece with its length and its number among the task's pieces of that length. The counts of the
lengths, one per possible length, go to the driver, which plans the packing (``bin_plan``). Tasks' counts
are added up per length, so each piece knows its number among all pieces of its length and finds its sequence
and offset in the plan by a binary search. Texts are never shuffled; the plan does not grow with the input.

Defined cases: null and empty texts are a lone end id. Repeated and null ids keep all their rows, each cut and
packed on its own. Very long texts are encoded whole and cut into pieces of the full length, the first
piece taking what is left over. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkfield.llm.bin_plan import packing_plan
from larkfield.llm.common import id_and_text, text_slices
from larkfield.llm.token_files import library_coder
from larkfield.session import checkpointed, fresh_path

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _stored_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of all documents, written once: ``part`` is the task, ``nth`` counts its pieces of a length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = library_coder(path), TaskContext.get().partitionId()
        end = np.array([end_id], coder.type).tobytes()
        met = [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if with_ids else [])]
        for batch in text_slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.frombuffer(coder.encode(text) + end, coder.type).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                at = 0
                for piece, to in enumerate(range(first, len(ids) + 1, capacity)):
                    raw = ids[at:to].tobytes()
                    n = to - at
                    rows.append((doc_id, piece, at, n, zlib.crc32(raw), part, met[n], *([raw] if with_ids else [])))
                    met[n] += 1
                    at = to
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    where = fresh_path(docs.sparkSession, "pieces")
    id_and_text(docs).mapInArrow(cut, _PIECE + (", ids binary" if with_ids else "")).write.parquet(where)
    return docs.sparkSession.read.parquet(where)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, groups: int = 64, with_ids: bool = False) -> DataFrame:
    """Where every piece of every document goes.

    Columns: doc_id, piece (from 0), start (its document's ids before it), length, ids_crc32,
    sequence_id, offset, and ``ids`` (little-endian 32-bit) if asked for.
    """
    pieces = _stored_pieces(docs, path, capacity, end_id, with_ids)
    per_task = checkpointed(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per possible length at most
        counts[r["length"]] = r["n"]
    runs = packing_plan(counts, capacity, groups).arrays()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_of = np.searchsorted(runs["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                low, high = start_of[n], start_of[n + 1]
                of = length == n
                run[of] = low + np.searchsorted(runs["first_rank"][low:high], rank[of], side="right") - 1
            number = rank - runs["first_rank"][run]
            sequence = runs["first_bin"][run] + number // runs["per"][run]
            offset = runs["offset"][run] + number % runs["per"][run] * length
            kept = [c for c in out.names if c not in ("sequence_id", "offset")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    out = numbered.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(placed, out)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """sequence_id, n_tokens, ids (array) and document bounds of every sequence, from pieces that carry ``ids``.

    A sequence holds a bounded number of ids, so its pieces are collected safely.
    """
    pieces = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids")))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[p["ids"] for p in parts] for parts in batch.column("parts").to_pylist()]
            ids = [np.frombuffer(b"".join(r), "<u4").astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), pa.array([len(i) for i in ids], pa.int32()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([[p["offset"] for p in parts] for parts in batch.column("parts").to_pylist()], pa.list_(pa.int64()))],
                names=["sequence_id", "n_tokens", "ids", "offsets"])

    return (placed.groupBy("sequence_id").agg(pieces.alias("parts"))
            .mapInArrow(joined, "sequence_id long, n_tokens int, ids array<int>, offsets array<long>"))
