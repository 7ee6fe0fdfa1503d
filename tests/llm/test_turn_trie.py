"""The trie against a plain one built in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from larkfield.llm import turn_trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, family=100, modulus=6):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0, role or ""), (role or "", text or "")))
    own = {c: [said for _, said in sorted(v, key=lambda x: x[0])] for c, v in own.items()}
    cut = lambda c: c - (abs(c) % family) * (1 if c >= 0 else -1)
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % modulus
        built[c] = tuple(own.get(cut(c), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        leaves, saved, todo = 0, 0, [node]
        while todo:
            at = todo.pop()
            saved += (len(members[at]) - 1) * len(at[-1][1]) if at else 0
            leaves += not children[at]
            todo += children[at]
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(frame):
    found = turn_trie.prefix_trie(*turn_trie.with_shared_heads(turn_trie.numbered_turns(frame)))
    return sorted((tuple(r)[:8] for r in found.collect()), key=repr)


def chats(seed, n, turns, words):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rnd.choice([c, c, c + 1000, -c])
        rows += [(conv, t, rnd.choice(["user", "assistant"]), rnd.choice(words) * rnd.randint(1, 2)) for t in range(rnd.randint(1, turns))]
    return [(c, t, r, x) for (c, t), (r, x) in {(c, t): (r, x) for c, t, r, x in rows}.items()]


@pytest.mark.parametrize("seed, n, turns, words", [(1, 150, 3, "ab"), (2, 120, 9, "abc"), (3, 60, 14, "a"), (4, 40, 30, ["é😀", "", "漢"])])
def test_trie_is_that_of_all_prefixes(spark, seed, n, turns, words):
    rows = chats(seed, n, turns, words)
    random.Random(seed).shuffle(rows)
    assert trie(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_long_conversations_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "CHUNK", 2)
    rnd = random.Random(8)
    rows = []
    for c in (0, 1, 2, 3, 100, 104):
        for t in range(rnd.randint(20, 70)):
            rows.append((c, t, "user", "x" if t < 25 else str(rnd.randint(0, 1))))
    assert trie(spark.createDataFrame(rows, TURNS)) == brute(rows)


def test_nulls_empty_texts_and_strange_columns(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 2, "", ""), (1, 0, "user", "a"), (2, None, None, "a" * 50_000),
            (None, 0, "user", "nobody's"), (7, 3, "user", "late"), (7, None, "user", "early"), (201, 0, "user", "orphan")]
    frame = spark.createDataFrame(rows, TURNS)
    for name in ("place", "block", "a", "depth", "h", "points", "n_turns"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    assert trie(frame) == brute(rows)
    assert trie(frame.limit(0)) == []


def test_heads_taken_from_an_absent_conversation_leave_the_tail(spark):
    rows = [(c, t, "user", f"{c}-{t}") for c in range(301, 310) for t in range(2)]
    got = trie(spark.createDataFrame(rows, TURNS))
    assert got == brute(rows)
    assert sum(r[1] == 0 for r in got) == 1
