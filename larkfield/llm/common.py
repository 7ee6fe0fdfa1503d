"""Helpers that several operators of this folder share."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows turned into Python objects at a time inside a task.
SLICE_ROWS = 256


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under fixed names; other columns cannot clash."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller pieces, so that only a few texts are Python objects at once.

    At the end Arrow gives back the memory it keeps: a worker lives on and meets many tasks.
    """
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
    finally:
        batch = None
        pa.default_memory_pool().release_unused()


class RecentTable(dict):
    """Values of the keys met lately, made when a key is missing; a bound on memory only.

    Once ``entries`` keys are in, they become the generation before, whose keys come back when they are met again
    and else go at the next turn. So frequent keys stay while rare ones pass, and at most twice ``entries`` are held.
    ``make`` is a method; its object is not kept alive.
    """

    def __init__(self, make: Callable, entries: int):
        super().__init__()
        self._make, self._entries, self._before = weakref.WeakMethod(make), entries, {}

    def __missing__(self, key):
        value = self._before.pop(key, None)
        if value is None:
            value = self._make()(key)
        if len(self) >= self._entries:
            self._before = dict(self)
            self.clear()
        self[key] = value
        return value
