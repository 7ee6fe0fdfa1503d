"""Packing: the plan against optimal and simple plans, and every piece against the library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from cases import documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from larkfield.llm import bin_plan, sequence_packing
from larkfield.llm.queries import tokenizer


def expanded(plan, capacity):
    """Bins as sorted lists of (offset, length); every run is written out."""
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, first_rank, items, first_bin, per, offset in plan.runs:
        for number in range(items):
            bins[first_bin + number // per].append((offset + number % per * length, length))
            ranks[length].append(first_rank + number)
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(items, items[1:])) and sum(items[-1]) <= capacity
    assert sorted(bins) == list(range(plan.n_bins))
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    return {length: len(r) for length, r in ranks.items()}


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 60), st.lists(st.integers(1, 60), max_size=200), st.integers(1, 12), st.sampled_from([(0.05,), (1 / 8,), (0.3, 0.5)]))
def test_every_item_has_its_place(capacity, lengths, groups, shares):
    counts = np.bincount([min(n, capacity) for n in lengths], minlength=capacity + 1)
    plan = bin_plan.packing_plan(counts, capacity, groups, shares)
    assert expanded(plan, capacity) == {n: c for n, c in enumerate(counts) if c}
    assert plan.n_bins >= -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [i for i, r in enumerate(rooms) if r >= n]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_configurations_beat_best_fit_where_it_fails():
    # 51 + 27 + 22 and 26 + 26 + 24 + 24 fill bins; longest first mixes them up
    lengths = [51, 27, 22] * 300 + [26, 26, 24, 24] * 300
    counts = np.bincount(lengths, minlength=101)
    plan = bin_plan.packing_plan(counts, 100)
    expanded(plan, 100)
    assert plan.n_bins == 600 < best_fit(lengths, 100)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_plans_stay_near_the_bound_and_small(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, 1 + rng.lognormal(6.2, 1.0, 20_000).astype(int))
    counts = np.bincount(lengths, minlength=2049)
    plan = bin_plan.packing_plan(counts, 2048)
    expanded(plan, 2048)
    bound = -(-int(lengths.sum()) // 2048)
    assert plan.n_bins <= bound * 1.002 + 1
    ten = bin_plan.packing_plan(counts * 10, 2048)
    assert len(ten.runs) < 2 * len(plan.runs) and ten.n_bins <= -(-int(lengths.sum()) * 10 // 2048) * 1.002 + 1


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_are_the_librarys_ids(spark, capacity):
    path = tokenizer("byte_bpe_50k.json")
    docs = documents(spark, extra=True)
    docs = docs.unionByName(docs.limit(3)).repartition(5)  # repeated rows
    library = Tokenizer.from_file(path)
    wanted = defaultdict(list)
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        wanted[r.doc_id] += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    placed = sequence_packing.pack_documents(docs, path, capacity, with_ids=True)
    rows = placed.collect()
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length, r.ids))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in wanted.items()}
    for items in bins.values():
        items.sort()
        assert items[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(items, items[1:])) and items[-1][0] + items[-1][1] <= capacity
    for s in sequence_packing.packed_sequences(placed).collect():
        assert np.array(s.ids, "<u4").tobytes() == b"".join(i for _, _, i in bins[s.sequence_id]) and s.n_tokens <= capacity


def test_nulls_and_empty_tables(spark):
    path = tokenizer("byte_bpe_50k.json")
    rows = [(None, None), (None, None), (3, ""), (4, "word " * random.Random(1).randint(3000, 4000))]
    frame = documents(spark, rows)
    got = sequence_packing.pack_documents(frame, path).collect()
    assert sum(r.doc_id is None and r.length == 1 for r in got) == 2 and max(r.length for r in got) == 2048
    assert sequence_packing.pack_documents(frame.limit(0), path).collect() == []
