"""Token ids as Arrow stream files of equal-length sequences, and reading them back.

Documents are ordered by id, every document is followed by an end id, and the ids of a range of
documents form one stream that is cut into sequences of ``length`` ids. A shard is two files:
``seq-*.arrow`` with batches of two fixed-size lists (``ids``, ``mask``; the mask is false on the
padding of the last sequence) and ``doc-*.arrow`` with doc_id, first id in the shard and number of
ids. All batches but the last hold the same number of rows, so row ``i`` is in batch
``i // SEQUENCES`` and, memory-mapped, is read without a copy. Ids are 16 bits wide if the
vocabulary allows it.

A task writes under a name of its own attempt, so a task that runs twice leaves an unused file and
never a broken one; only the files named by the finished job are read.

Null and empty texts become a lone end id. Repeated ids keep all their rows, ordered by text; null
ids come first. An empty table gives no file and no rows. Long texts are encoded whole.
"""

from __future__ import annotations

import functools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.bpe import byte_characters
from larkfield.llm.common import RecentTable, id_and_text, text_slices
from larkfield.session import fresh_path

#: Sequences in a batch.
SEQUENCES = 64
#: Entries of a generation of a worker's word table; a bound on memory only.
_TABLE_ENTRIES = 500_000
#: A blank-led word or the first of a line that ends in marks: letters are one piece of the pre-tokenizer, marks another.
_WORD_AND_MARKS = regex.compile(r"(\n?)(\p{L}+)([!-&(-/:-@\[-`{-~]*)").fullmatch


class LibraryCoder:
    """Ids by the tokenizers library; words met before come from a bounded table.

    The pre-tokenizer never joins text across the border between a non-space and the blank after
    it. In a text with single blanks and line breaks only, each blank-led word can therefore be
    encoded alone. Any other text goes to the library whole. Of a word with marks at its end, the word and
    the marks are pieces of their own, so words are met before more often.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._merge = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0).tokenize
        self._bytes = dict(enumerate(byte_characters()))
        self.size = self._whole.get_vocab_size(with_added_tokens=True)
        self.type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self._format = "H" if self.type.itemsize == 2 else "I"
        self._line_break = self._library("\n")
        self._known = RecentTable(self._blank_led, _TABLE_ENTRIES)
        self._unled = RecentTable(self._piece, _TABLE_ENTRIES // 10)

    def _library(self, text: str) -> bytes:
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, self.type).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer, with the blank before it if it has one."""
        found = self._merge(piece.encode().decode("latin-1").translate(self._bytes))
        return struct.pack(f"<{len(found)}{self._format}", *[t.id for t in found])

    def _blank_led(self, word: str) -> bytes:
        """Ids of a blank and ``word``; of ``word`` alone if a line break stands where the blank would."""
        if word.isalpha():
            return self._piece(" " + word)
        parts = _WORD_AND_MARKS(word)
        if not parts:
            return self._library(word if word[0] == "\n" else " " + word)
        line_break, letters, marks = parts.groups()
        ids = self._line_break + self._unled[letters] if line_break else self._known[letters]
        return ids + self._unled[marks] if marks else ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, packed."""
        if not text:
            return b""
        if ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
                or not text.replace("\n", " ").isprintable()):
            return self._library(text)
        first, *words = text.replace("\n", " \n").split(" ")
        return self._library(first) + b"".join(map(self._known.__getitem__, words))


@functools.cache
def library_coder(path: str) -> LibraryCoder:
    return LibraryCoder(path)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _ShardWriter:
    """Cuts a stream of ids into sequences and writes both files of a shard."""

    def __init__(self, folder: str, dtype: np.dtype, length: int):
        store, base = _store(folder)
        name = uuid.uuid4().hex
        self.seq_path, self.doc_path = f"{folder}/seq-{name}.arrow", f"{folder}/doc-{name}.arrow"
        self.length, self.dtype = length, dtype
        element = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(element, length)), ("mask", pa.list_(pa.bool_(), length))],
                                metadata={"length": str(length), "batch_rows": str(SEQUENCES)})
        self.doc_schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])
        store.create_dir(base, recursive=True)
        self._files = [store.open_output_stream(f"{base}/{kind}-{name}.arrow") for kind in ("seq", "doc")]
        self._seq = pa.ipc.new_stream(self._files[0], self.schema)
        self._doc = pa.ipc.new_stream(self._files[1], self.doc_schema)
        self._held: list[bytes] = []
        self._held_ids = 0
        self.written = 0

    def add(self, doc_ids: pa.Array, packed: list[bytes]) -> None:
        counts = np.array([len(p) // self.dtype.itemsize for p in packed], np.int64)
        firsts = self.written + np.cumsum(counts) - counts
        self._doc.write_batch(pa.record_batch([doc_ids, pa.array(firsts), pa.array(counts)], schema=self.doc_schema))
        self.written += int(counts.sum())
        self._held += packed
        self._held_ids += int(counts.sum())
        if self._held_ids >= SEQUENCES * self.length:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self._held), self.dtype)
        block = SEQUENCES * self.length
        full = len(ids) // block * block
        for start in range(0, full, block):
            self._write(ids[start : start + block], block)
        rest = ids[full:]
        if last and len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
        self._held, self._held_ids = ([], 0) if last else ([rest.tobytes()], len(rest))

    def _write(self, ids: np.ndarray, size: int) -> None:
        mask = np.arange(size) < len(ids)
        values = np.zeros(size, self.dtype)
        values[: len(ids)] = ids
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, mask)]
        self._seq.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        self._flush(last=True)
        for part in (self._seq, self._doc, *self._files):
            part.close()


def write_token_files(docs: DataFrame, path: str, folder: str, length: int = 2048, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents below ``folder``; one row per shard, in id order.

    Columns: seq_path, doc_path, n_docs, n_ids, start (ids in the shards before). The frame holds a
    row per written file pair, as many as the range partitions, so it is small at any input size.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(path)
        end = np.array([end_id], coder.type).tobytes()
        writer, n_docs, first = None, 0, None
        for part in text_slices(batches):
            if writer is None:
                writer, first = _ShardWriter(folder, coder.type, length), part.column("doc_id")[0].as_py()
            writer.add(part.column("doc_id"), [coder.encode(t) + end for t in part.column("text").to_pylist()])
            n_docs += part.num_rows
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pylist(
                [{"first_id": first, "seq_path": writer.seq_path, "doc_path": writer.doc_path, "n_docs": n_docs, "n_ids": writer.written}],
                schema=pa.schema([("first_id", pa.int64()), ("seq_path", pa.string()), ("doc_path", pa.string()),
                                  ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(write, "first_id long, seq_path string, doc_path string, n_docs long, n_ids long").collect()
    rows, start = [], 0
    for s in sorted(shards, key=lambda s: (s.first_id is not None, s.first_id)):
        rows.append((s.seq_path, s.doc_path, s.n_docs, s.n_ids, start))
        start += s.n_ids
    return spark.createDataFrame(rows, "seq_path string, doc_path string, n_docs long, n_ids long, start long")


def open_batches(path: str) -> list[pa.RecordBatch]:
    """All batches of a local file as views of the mapped file; no values are copied."""
    return list(pa.ipc.open_stream(pa.memory_map(path.removeprefix("file://"))))


def sequence(batches: list[pa.RecordBatch], i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a view) and mask of sequence ``i`` of a shard."""
    batch = batches[i // SEQUENCES]
    ids, mask = batch.column("ids"), batch.column("mask")
    row, n = i % SEQUENCES, ids.type.list_size
    view = ids.values.to_numpy(zero_copy_only=True)[row * n : (row + 1) * n]
    return view, mask.values.slice(row * n, n).to_numpy(zero_copy_only=False)


def _ids_of(path: str) -> Iterator[np.ndarray]:
    store, inner = _store(path)
    with store.open_input_stream(inner) as f:
        for batch in pa.ipc.open_stream(f):
            ids = batch.column("ids").values.to_numpy(zero_copy_only=True)
            valid = batch.column("mask").values.true_count
            yield ids[:valid]


def read_token_digests(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, taken from the files of ``shards``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in (row for b in batches for row in b.to_pylist()):
            blocks, held = _ids_of(shard["seq_path"]), np.zeros(0, np.uint16)
            store, inner = _store(shard["doc_path"])
            with store.open_input_stream(inner) as f:
                for docs in pa.ipc.open_stream(f):
                    counts, crcs = docs.column("n_tokens").to_numpy(), []
                    need, parts, have = int(counts.sum()), [held], len(held)
                    while have < need:
                        parts.append(next(blocks))
                        have += len(parts[-1])
                    ids, at = np.concatenate([p for p in parts if len(p)]), 0
                    for n in counts.tolist():
                        crcs.append(zlib.crc32(ids[at : at + n].astype("<u4").tobytes()))
                        at += n
                    held = ids[at:]
                    starts = pa.array(docs.column("first").to_numpy() + shard["start"])
                    yield pa.RecordBatch.from_pydict({"doc_id": docs.column("doc_id"), "start": starts,
                                                      "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crcs, pa.int64())})

    n = max(1, shards.count())
    spread = shards.repartition(n, F.col("start")) if n > 1 else shards
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fresh_folder(docs: DataFrame) -> str:
    """A new folder below the shared one, for one set of files."""
    return fresh_path(docs.sparkSession, "token-files")
