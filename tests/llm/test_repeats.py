import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, sentence

from larkfield.llm import suffix_dedup
from larkfield.llm.suffix_groups import suffix_array


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array_equals_sorting():
    rnd = random.Random(1)
    for trial in range(1500):
        numbers = [rnd.randint(1, rnd.choice([1, 2, 3, 6])) for _ in range(rnd.randint(0, 40))]
        numbers = (numbers * 3)[:60] + [0] if trial % 5 == 0 else numbers + [0]
        assert suffix_array(np.array(numbers)).tolist() == sorted(range(len(numbers)), key=lambda i: numbers[i:])


def check(spark, texts, length=200, **more):
    docs = documents(spark, list(enumerate(texts)), extra=True)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, **more).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want


@pytest.mark.parametrize("most_kinds", [2, 16_384])
def test_planted_repeats(spark, most_kinds):
    rnd = random.Random(2)
    passage = sentence(rnd, 70)
    texts = [None, "", "short", "ab" * 300, "z" * 900, passage, passage]
    for k in range(12):
        texts.append(sentence(rnd, rnd.randint(0, 40)) + " " + passage[rnd.randint(0, 30) : len(passage) - rnd.randint(0, 60)] + " é" + sentence(rnd, rnd.randint(0, 40)))
    near = sentence(rnd, 200)
    for k in range(8):
        at = rnd.randint(0, len(near) - 1)
        texts.append(near[:at] + "#" + near[at + 1 :])
    texts.append(near + " " + near)
    check(spark, texts, most_kinds=most_kinds)


def test_contract_length(spark):
    rnd = random.Random(4)
    a = sentence(rnd, 120)
    check(spark, [a[:399] + "!", a[:399] + "?", a[:400] + "x", a[50:460], a], length=400)


def test_kept_bytes_and_empty_table(spark):
    docs = documents(spark, [(1, "k" * 10), (2, "m" * 500), (3, "m" * 500), (None, "tail")])
    rows = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs, 200).collect()}
    assert rows == {1: b"k" * 10, 2: b"", 3: b"", None: b"tail"}
    assert suffix_dedup.remove_repeats(documents(spark, []), 200).count() == 0
