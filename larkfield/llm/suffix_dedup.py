"""Bytes covered by strings of 400 bytes that also start elsewhere, removed from all documents.

Every window of ``length`` bytes has an anchor: its first position with the smallest hash of the next
``CORE`` bytes. Equal windows have equal anchors at equal offsets, and neighbouring windows mostly share
theirs, so a document is a short list of *runs*: an anchor, the windows that have it, and the bytes that
those windows cover. All work is on runs.

1. Documents are dealt into blocks. A block sends the distinct hashes of its runs' bytes, and of their
   anchors' cores, by ranges of the hash; the task of a range answers which occur again.
   A run whose bytes occur again is repeated as a whole; a core with a single kind of run is settled.
2. Only one run of each kind whose core has several kinds needs a closer look. Those
   of a range of cores come together in one task. Cut into pieces of ``PIECE`` bytes counted from
   the anchor, they are one sequence of numbers, whose suffix array (grouping by Lyndon prefixes,
   ``suffix_groups``) brings runs with equal pieces next to each other. Windows whose
   whole pieces stand alone there are unique; the others of an interval are compared exactly.
3. A core with more than ``MOST_KINDS`` kinds of runs would crowd one task. Its windows are settled one
   by one: blocks send the distinct hashes of such windows and are answered as in step 1.
4. The spans come back to the documents' blocks, where the rest of the bytes is put together.

Hashes have 64 bits. Null and empty texts have no bytes; texts shorter than ``length`` lose none; rows
that repeat are copies of each other; a null id is passed on; an empty table gives no rows. Matches
never cross documents. Runs of one byte give a run per window at worst, whose kinds collapse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkfield.llm.packing import packed, unpacked
from larkfield.llm.suffix_groups import suffix_array
from larkfield.llm.words import byte_values, mixed, powers
from larkfield.session import fresh_path

CORE, PIECE = 32, 128
MOST_KINDS = 4096
BLOCK_BYTES = 4 << 20
_STARTS = 1 << 19
_WINDOWS_AT_ONCE = 1 << 18
_POSITION = np.uint64((1 << 24) - 1)
_BYTES = byte_values([])


def _prefix(raw: np.ndarray) -> np.ndarray:
    up, _ = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=total[1:])
    return total


def _hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return (total[end] - total[start]) * down[start]


def _anchors(core: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` cores the position of its first smallest core hash."""
    key = (core & ~_POSITION) | np.arange(len(core), dtype=np.uint64)
    step = 1
    while step * 2 <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if step < width:
        key = np.minimum(key[: len(key) - (width - step)], key[width - step :])
    return (key & _POSITION).astype(np.int64)


def _core_key(core: np.ndarray) -> np.ndarray:
    """Hash of a core by which it is dealt: an anchor's own hash is the smallest of many, so it is small."""
    return mixed(core ^ np.uint64(0x9E3779B97F4A7C15))


def _block_bytes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def runs(raw: np.ndarray, begin: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """All runs of a block: first and last window, anchor, and hashes of the core and of the covered bytes."""
    found = {k: [] for k in ("low", "high", "anchor", "core", "bytes")}
    width = length - CORE + 1
    for at in range(0, max(0, len(raw) - length + 1), _STARTS):
        stop = min(len(raw), at + _STARTS + length - 1)
        total = _prefix(raw[at:stop])
        position = np.arange(stop - at - CORE + 1)
        core = mixed(_hash(total, position, position + CORE))
        anchor = _anchors(core, width)
        start = np.arange(at, at + len(anchor))
        inside = start + length <= begin[np.searchsorted(begin, start, "right")]
        edge = np.ones(len(anchor) + 1, bool)
        edge[1:-1] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
        # a run also ends where a document does; the windows across the border are not inside
        cut = np.flatnonzero(edge)
        low, high = cut[:-1], cut[1:] - 1
        kept = inside[low]
        low, high = low[kept], high[kept]
        where = anchor[low]
        covered = mixed(_hash(total, low, high + length) + mixed((where - low).astype(np.uint64) + np.uint64(977)))
        for k, v in zip(found, (low + at, high + at, where + at, _core_key(core[where]), covered)):
            found[k].append(v)
    return {k: np.concatenate(v) if v else np.zeros(0, np.uint64 if k in ("core", "bytes") else np.int64) for k, v in found.items()}


def _sorted_group(group: pa.Table) -> pa.Table:
    return group.sort_by([("doc_id", "ascending"), ("hash", "ascending")])


def _by_range(kind: int, block: int, parts: int, keys: np.ndarray, first: np.ndarray, second: np.ndarray | None) -> list[tuple]:
    """Rows for the tasks of hash ranges: sorted keys with up to two numbers each."""
    part = ((keys >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
    edges = np.searchsorted(part, np.arange(parts + 1))
    rows = []
    for p in np.unique(part).tolist():
        cut = slice(edges[p], edges[p + 1])
        rows.append((kind, p, block, packed(np.diff(keys[cut], prepend=np.uint64(0))), packed(first[cut]),
                     packed(second[cut]) if second is not None else None))
    return rows


_ROW = "kind int, part int, block long, keys binary, first binary, second binary"
_KINDS, _CORES, _RUNS, _WINDOWS = 1, 2, 3, 4
_ROW_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("first", pa.binary()), ("second", pa.binary())])


def _rows(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * 6
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ROW_SCHEMA)], schema=_ROW_SCHEMA)


def _scanned(length: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """A block's distinct run kinds with counts, its cores with two kinds each, and its own list of runs."""

    def run(group: pa.Table) -> pa.Table:
        group = _sorted_group(group)
        block = group.column("block")[0].as_py()
        raw, begin = _block_bytes(group.column("text").to_pylist())
        found = runs(raw, begin, length)
        kinds, kind, times = np.unique(found["bytes"], return_inverse=True, return_counts=True)
        cores, core = np.unique(found["core"], return_inverse=True)
        if not len(kinds):
            return _rows([])
        smallest = np.full(len(cores), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(smallest, core, found["bytes"])
        largest = np.zeros(len(cores), np.uint64)
        np.maximum.at(largest, core, found["bytes"])
        owner = np.zeros(len(kinds), np.int64)
        owner[kind] = core
        n_kinds = np.bincount(owner, minlength=len(cores)).astype(np.uint64)
        # one and the same kind in all blocks shows as equal smallest and largest; their sum of kinds bounds the crowd
        rows = _by_range(_KINDS, block, parts, kinds, times.astype(np.uint64), None)
        rows += _by_range(_CORES, block, parts, cores, smallest, np.where(smallest == largest, 0, n_kinds).astype(np.uint64))
        own = [found["low"], found["high"] - found["low"], found["anchor"] - found["low"]]
        steps = np.diff(own[0], prepend=0)
        rows.append((_RUNS, 0, block, packed(steps), packed(own[1] << 10 | own[2]), packed(kind.astype(np.uint64) << np.uint64(32) | core.astype(np.uint64))))
        return _rows(rows)

    return run


def _answered(group: pa.Table, most_kinds: int) -> pa.Table:
    """Answers to every block of a range, one small number per key, in the block's order.

    Kinds: 1 if the kind occurs again, plus 2 if this block speaks for it. Cores: 0 settled, 1 several
    kinds, 2 too many kinds for one task. Windows: 1 if the window occurs again.
    """
    what = group.column("kind")[0].as_py()
    group = group.sort_by("block")
    keys = [np.cumsum(unpacked(k), dtype=np.uint64) for k in group.column("keys").to_pylist()]
    first = np.concatenate([unpacked(x) for x in group.column("first").to_pylist()])
    every = np.concatenate(keys)
    distinct, place, index = np.unique(every, return_index=True, return_inverse=True)
    if what == _CORES:
        second = np.concatenate([unpacked(x) for x in group.column("second").to_pylist()])
        low = np.full(len(distinct), np.iinfo(np.uint64).max, np.uint64)
        high = np.zeros(len(distinct), np.uint64)
        np.minimum.at(low, index, first)
        np.maximum.at(high, index, first)
        crowd = np.bincount(index, weights=np.maximum(second, 1))
        several = (low != high) | (np.bincount(index, weights=second > 0) > 0)
        answer = np.where(several, np.where(crowd > most_kinds, 2, 1), 0)[index]
    else:
        again = np.bincount(index, weights=first) > 1
        answer = again[index].astype(np.int64)
        if what == _KINDS:
            answer[place] += 2
    ends = np.cumsum([len(k) for k in keys])[:-1]
    return _rows([(what, p, b, packed(a.astype(np.uint64)), None, None) for p, b, a in zip(
        group.column("part").to_pylist(), group.column("block").to_pylist(), np.split(answer, ends))])


def _block_runs(answers: pa.Table) -> dict[str, np.ndarray] | None:
    """A block's own runs with what was answered about their kind and core."""
    if not answers.num_rows:
        return None
    kind = answers.column("kind").to_numpy()
    listed = np.flatnonzero(kind == _RUNS)
    if not len(listed):
        return None
    row = int(listed[0])
    steps, spread, index = (unpacked(answers.column(c)[row].as_py()) for c in ("keys", "first", "second"))
    low = np.cumsum(steps.astype(np.int64))
    said = {}
    for what in (_KINDS, _CORES):
        own = answers.filter(pa.array(kind == what)).sort_by("part")
        said[what] = np.concatenate([unpacked(x) for x in own.column("keys").to_pylist()])
    kinds, cores = (index >> np.uint64(32)).astype(np.int64), (index & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return {"low": low, "high": low + (spread >> np.uint64(10)).astype(np.int64), "anchor": low + (spread & np.uint64(1023)).astype(np.int64),
            "kind": kinds, "again": said[_KINDS][kinds] & np.uint64(1) > 0, "speaks": said[_KINDS][kinds] & np.uint64(2) > 0, "core": said[_CORES][cores]}


def _window_hashes(raw: np.ndarray, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of runs, which come in the order of the bytes."""
    n = high - low + 1
    start = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(raw), _STARTS):
        a, b = np.searchsorted(start, [at, at + _STARTS])
        if b > a:
            total = _prefix(raw[at : at + _STARTS + length - 1])
            s = start[a:b] - at
            out[a:b] = mixed(_hash(total, s, s + length))
    return start, out


def _crowded(length: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Distinct windows, with counts, of the block's runs whose core has too many kinds for one task."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = _block_runs(answers)
        if own is None or not (mask := (own["core"] == 2)).any():
            return _rows([])
        raw, _ = _block_bytes(_sorted_group(docs).column("text").to_pylist())
        _, hashes = _window_hashes(raw, own["low"][mask], own["high"][mask], length)
        keys, times = np.unique(hashes, return_counts=True)
        return _rows(_by_range(_WINDOWS, docs.column("block")[0].as_py(), parts, keys, times.astype(np.uint64), None))

    return run


def _closer_looks(length: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The bytes of one run per kind that needs a closer look, addressed to its core's range."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        own = _block_runs(answers)
        rows = []
        if own is not None:
            once = np.zeros(len(own["kind"]), bool)
            once[np.unique(own["kind"], return_index=True)[1]] = True
            pick = np.flatnonzero((own["core"] == 1) & own["speaks"] & once)
            if len(pick):
                block = docs.column("block")[0].as_py()
                raw, _ = _block_bytes(_sorted_group(docs).column("text").to_pylist())
                data = raw.tobytes()
                for r in pick.tolist():
                    low, high, anchor = int(own["low"][r]), int(own["high"][r]), int(own["anchor"][r])
                    core = int(_core_key(mixed(_hash(_prefix(raw[anchor : anchor + CORE]), np.array([0]), np.array([CORE]))))[0])
                    rows.append(((core >> 40) * parts >> 24, block, low, anchor - low, bool(own["again"][r]), data[low : high + length]))
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.table({n: pa.array(c, t) for n, t, c in zip(("bin", "block", "low", "offset", "again", "bytes"), (
            pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()), columns)})

    return run


_LOOK = "bin long, block long, low long, offset int, again boolean, bytes binary"


def _core_hashes(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(raw), _STARTS):
        a, b = np.searchsorted(start, [at, at + _STARTS])
        if b > a:
            s = start[a:b] - at
            out[a:b] = _hash(_prefix(raw[at : at + _STARTS + CORE]), s, s + CORE)
    return out


def _compared(length: int) -> Callable[[pa.Table], pa.Table]:
    """Spans of windows that runs of one range of cores share, found by their suffix array."""
    whole = (length - PIECE + 1) // PIECE  # pieces that every window holds whole

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        held = group.column("bytes").chunk(0)
        ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
        raw = np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        low, again = group.column("low").to_numpy(), group.column("again").to_numpy(zero_copy_only=False)
        offset = group.column("offset").to_numpy().astype(np.int64)
        size = np.diff(ends)
        begin = ends[:-1] - ends[0]
        lead = offset % PIECE
        pieces = (size - lead) // PIECE
        run_of = np.repeat(np.arange(len(size)), pieces)
        number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = begin[run_of] + lead[run_of] + number * PIECE
        value = np.empty(len(start), np.uint64)
        for at in range(0, len(raw), _STARTS):
            a, b = np.searchsorted(start, [at, at + _STARTS])
            if b > a:
                s = start[a:b] - at
                value[a:b] = mixed(_hash(_prefix(raw[at : at + _STARTS + PIECE]), s, s + PIECE))
        # the sequence: each run's pieces, then a separator; pieces are numbered from 2
        place = np.arange(len(start)) + run_of
        sequence = np.ones(len(start) + len(size) + 1, np.int64)
        sequence[place] = np.unique(value, return_inverse=True)[1] + 2
        sequence[-1] = 0
        order = suffix_array(sequence)
        same = np.ones(len(order) - 1, bool)
        padded = np.concatenate([sequence, np.ones(whole, np.int64)])
        for k in range(whole):
            x = padded[order + k]
            same &= (x[1:] == x[:-1]) & (x[1:] > 1)
        interval = np.cumsum(np.append(0, ~same))
        crowd = np.bincount(interval)
        interval_of = np.empty(len(order), np.int64)
        interval_of[order] = interval
        shared = np.zeros(len(order), bool)
        shared[order] = crowd[interval] > 1
        def shared_windows(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Run, first byte and end of the spans that the runs share; runs in the order of their bytes."""
            # windows whose first whole piece begins an interval with company
            windows = (size - length + 1)[runs]
            w_run = np.repeat(runs, windows)
            w_at = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
            head = first[w_run] + np.maximum(0, -(-(w_at - lead[w_run]) // PIECE))
            company = shared[head]
            w_run, w_at, head = w_run[company], w_at[company], head[company]
            position = begin[w_run] + w_at
            hashes = np.empty(len(position), np.uint64)
            for at in range(0, len(raw), _STARTS):
                a, b = np.searchsorted(position, [at, at + _STARTS])
                if b > a:
                    s = position[a:b] - at
                    hashes[a:b] = _hash(_prefix(raw[at : at + _STARTS + length]), s, s + length)
            key = mixed(hashes + mixed((offset[w_run] - w_at).astype(np.uint64))) ^ interval_of[head].astype(np.uint64)
            _, index, times = np.unique(key, return_inverse=True, return_counts=True)
            twice = (times[index] > 1) & ~again[w_run]
            w_run, w_at = w_run[twice], w_at[twice]
            edge = np.ones(len(w_run) + 1, bool)
            edge[1:-1] = (w_run[1:] != w_run[:-1]) | (w_at[1:] != w_at[:-1] + 1)
            cut = np.flatnonzero(edge)
            a, b = cut[:-1], cut[1:] - 1
            return w_run[a], low[w_run[a]] + w_at[a], low[w_run[a]] + w_at[b] + length

        # runs of different cores share no window, so a few cores are compared at a time
        core = _core_hashes(raw, begin + offset)
        by_core = np.argsort(core, kind="stable")
        many = np.cumsum((size - length + 1)[by_core])
        batch = many // _WINDOWS_AT_ONCE
        same_core = np.append(False, core[by_core][1:] == core[by_core][:-1])
        batch = np.maximum.accumulate(np.where(same_core, 0, batch))  # a core is never divided
        first = np.cumsum(pieces) - pieces + np.arange(len(size))
        found = [shared_windows(np.sort(r)) for r in np.split(by_core, np.flatnonzero(np.diff(batch)) + 1)]
        low_end = [np.concatenate([f[k] for f in found]) for k in range(3)]
        return pa.table({"block": group.column("block").take(pa.array(low_end[0])), "start": pa.array(low_end[1], pa.int64()), "end": pa.array(low_end[2], pa.int64())})

    return run


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal spans of a union of spans; spans that touch become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return start[at], reach[np.append(at[1:], len(start)) - 1] if len(at) else reach


def _finished(length: int, with_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, rest: pa.Table) -> pa.Table:
        docs = _sorted_group(docs)
        block_rows = rest.filter(pc.is_null(rest.column("start")))
        raw, begin = _block_bytes(docs.column("text").to_pylist())
        starts, ends = [], []
        if rest.num_rows:
            starts.append(rest.column("start").drop_null().to_numpy())
            ends.append(rest.column("end").drop_null().to_numpy())
            own = _block_runs(block_rows)
            if own is not None:
                full = own["again"]
                starts.append(own["low"][full])
                ends.append(own["high"][full] + length)
                crowded = (own["core"] == 2) & ~full
                if crowded.any():
                    mask = own["core"] == 2
                    at, hashes = _window_hashes(raw, own["low"][mask], own["high"][mask], length)
                    kinds = block_rows.filter(pa.array(block_rows.column("kind").to_numpy() == _WINDOWS)).sort_by("part")
                    said = np.concatenate([unpacked(x) for x in kinds.column("keys").to_pylist()])
                    hit = at[said[np.unique(hashes, return_inverse=True)[1]] > 0]
                    starts.append(hit)
                    ends.append(hit + length)
        none = np.zeros(0, np.int64)
        # a span never leaves its document, but spans of two documents may touch: keep them apart by document
        start, end = (np.concatenate([none, *x]) for x in (starts, ends))
        owner = np.searchsorted(begin, start, "right") - 1
        shift = owner  # one free byte between documents, so that spans of neighbours do not merge
        start, end = _merged(start + shift, end + shift)
        owner = np.searchsorted(begin[:-1] + np.arange(len(begin) - 1), start, "right") - 1
        start, end = start - owner, end - owner
        data, out = raw.tobytes(), []
        edges = np.searchsorted(owner, np.arange(len(begin)))
        for d in range(docs.num_rows):
            a, b = int(begin[d]), int(begin[d + 1])
            kept, at, removed = [], a, 0
            for s, e in zip(start[edges[d] : edges[d + 1]].tolist(), end[edges[d] : edges[d + 1]].tolist()):
                kept.append(data[at:s])
                removed += e - s
                at = e
            kept.append(data[at:b])
            rest_bytes = b"".join(kept)
            out.append((b - a, removed, int(edges[d + 1] - edges[d]), hashlib.sha256(rest_bytes).hexdigest(), rest_bytes if with_text else None))
        columns = list(zip(*out)) if out else [()] * 5
        made = {"doc_id": docs.column("doc_id")}
        for name, kind, values in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), (pa.int64(), pa.int64(), pa.int64(), pa.string()), columns):
            made[name] = pa.array(values, kind)
        if with_text:
            made["kept"] = pa.array(columns[4], pa.binary())
        return pa.table(made)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = True, most_kinds: int = MOST_KINDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""
    if not CORE + PIECE <= length <= 1000:
        raise ValueError(f"length must be {CORE + PIECE} to 1000")
    spark = docs.sparkSession
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    size = plain.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(8, -(-int(size) // BLOCK_BYTES))
    parts = max(8, blocks // 8)  # a range of hashes holds far fewer bytes than a block
    keyed = plain.withColumn("hash", F.xxhash64("text"))
    dealt = keyed.withColumn("block", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(blocks)))
    by_block = dealt.groupBy("block")

    def answered(group: pa.Table) -> pa.Table:
        return _answered(group, most_kinds)

    def lean(fn: Callable) -> Callable:
        """``fn``, giving memory back between groups: a worker meets many of them."""
        def freed(*tables: pa.Table) -> pa.Table:
            try:
                return fn(*tables)
            finally:
                pa.default_memory_pool().release_unused()

        one, two = lambda group: freed(group), lambda left, right: freed(left, right)
        return one if fn.__code__.co_argcount == 1 else two

    def stored(frame: DataFrame) -> DataFrame:
        path = fresh_path(spark, "repeats")
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)

    scan = stored(by_block.applyInArrow(lean(_scanned(length, parts)), _ROW))
    asked = scan.filter(F.col("kind").isin(_KINDS, _CORES))
    answers = stored(asked.groupBy("kind", "part").applyInArrow(lean(answered), _ROW).unionByName(scan.filter(F.col("kind") == _RUNS)))
    # from here on one job: its three passes over the texts share one shuffle of them
    crowded = by_block.cogroup(answers.groupBy("block")).applyInArrow(lean(_crowded(length, parts)), _ROW)
    settled = answers.unionByName(crowded.groupBy("kind", "part").applyInArrow(lean(answered), _ROW))
    looks = by_block.cogroup(answers.groupBy("block")).applyInArrow(lean(_closer_looks(length, 2 * blocks)), _LOOK)
    spans = looks.groupBy("bin").applyInArrow(lean(_compared(length)), "block long, start long, end long")
    none = F.lit(None)
    rest = settled.select(*settled.columns, none.cast("long").alias("start"), none.cast("long").alias("end")).unionByName(
        spans.select(none.cast("int").alias("kind"), none.cast("int").alias("part"), "block", none.cast("binary").alias("keys"),
                     none.cast("binary").alias("first"), none.cast("binary").alias("second"), "start", "end"))
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return by_block.cogroup(rest.groupBy("block")).applyInArrow(lean(_finished(length, with_text)), columns)

