import random
from collections import Counter

import numpy as np
import pytest
from cases import documents, sentence

from larkfield.llm import decontaminate, shingle_join, vectors
from larkfield.llm.components import connected_components
from larkfield.llm.words import shingle_hashes, word_hashes


def shingle_sets(texts):
    shingles, begin = shingle_hashes(*word_hashes(texts))
    return [set(shingles[a:b].tolist()) for a, b in zip(begin, begin[1:])]


def brute_links(n, linked):
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(links[i], root(i)) for i in range(n)]


def test_words_are_runs_of_letters_and_digits():
    texts = ["One, two-THREE  ünï4 x_y", None, "", "...", "a " * 5]
    words, first = word_hashes(texts)
    assert np.diff(first).tolist() == [6, 0, 0, 0, 5]
    again, _ = word_hashes(["one two three ünï4 x y"])
    assert words[:6].tolist() == again.tolist() and len(set(words[6:].tolist())) == 1


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(80):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {x: r for x, r in parent.items() if x in got} and set(parent) - set(got) <= {a for a, b in edges if a == b}


def near_texts():
    rnd = random.Random(6)
    texts = [None, "", "...", "one two", "One, two!", "one two three"]
    for size in (12, 60, 240, 300, 420):
        base = sentence(rnd, size).split()
        for k in range(7):
            words = list(base)
            for _ in range(k):
                words[rnd.randrange(size)] = f"edit{rnd.random()}"
            texts.append(" ".join(words))
        texts.append(" ".join(base))
    return texts


def test_links_are_those_of_all_pairs(spark):
    texts = near_texts()
    sets = shingle_sets(texts)
    want = brute_links(len(texts), lambda i, j: bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: (r.n_links, r.class_id) for r in shingle_join.similar_documents(documents(spark, list(enumerate(texts)), extra=True)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_crowded_class_in_blocks(spark, monkeypatch):
    rnd = random.Random(7)
    base = sentence(rnd, 150).split()
    texts = [" ".join(base[:i] + [f"only{i}"] + base[i + 1 :]) for i in range(60)]
    monkeypatch.setattr(shingle_join, "BLOCK_ROWS", 9)
    got = shingle_join.similar_documents(documents(spark, list(enumerate(texts)))).collect()
    assert {(r.n_links, r.class_id) for r in got} == {(59, 0)}


def test_one_of_each_class_stays(spark):
    docs = documents(spark, [(5, "a b c d e f g"), (2, "a b c d e f g"), (9, None), (8, None), (7, "lone text"), (7, "lone text"), (None, "a b c d e f g")], extra=True)
    kept = shingle_join.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 7, 8, 9, None], key=repr)
    none = documents(spark, [])
    assert shingle_join.keep_one_each(none).count() == 0 and shingle_join.similar_documents(none).count() == 0


def test_rows_that_share_an_id_or_have_none_are_rows_of_their_own(spark):
    rnd = random.Random(9)
    a, b, c, d, e = (sentence(rnd, 60) for _ in range(5))
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (1, c), (2, near), (3, a), (4, d), (4, "..."), (4, None), (None, e), (None, e), (None, e), (None, near), (None, None), (None, None)]
    docs = documents(spark, rows, extra=True)
    got = sorted((tuple(r) for r in shingle_join.similar_documents(docs).collect()), key=repr)
    assert got == sorted([(1, 1, 1, 1), (1, 1, 2, 1), (1, 1, 0, 1), (2, 1, 2, 2), (3, 1, 1, 1), (4, 4, 0, 4), (4, 4, 0, 4), (4, 4, 0, 4),
                          *[(None, None, 2, None)] * 3, (None, 1, 2, 2), *[(None, None, 0, None)] * 2], key=repr)
    kept = sorted(((r.doc_id, r.text) for r in shingle_join.keep_one_each(docs).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (1, c), (4, d), (4, "..."), (4, None), (None, e), (None, near), (None, None), (None, None)], key=repr)


def test_depth_follows_the_recall():
    assert [shingle_join.forest_depth(0.8, r) for r in (0.9, 0.999, 0.9999)] == sorted(
        (shingle_join.forest_depth(0.8, r) for r in (0.9, 0.999, 0.9999)), reverse=True)
    d = shingle_join.forest_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** shingle_join.TREES >= 0.9999


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def window_similarities(text, item):
    """Best weighted Jaccard of item-sized windows, every window tried."""
    shingles, _ = shingle_hashes(*word_hashes([text]))
    own, first = word_hashes([item])
    other, _ = shingle_hashes(own, first)
    n = max(1, len(own) - 4)
    windows = [shingles[s : s + n] for s in range(max(1, len(shingles) - n + 1))] + [shingles[:k] for k in range(1, n)] + [shingles[-k:] for k in range(1, n)]
    return max((decontaminate.weighted_jaccard(Counter(w.tolist()), Counter(other.tolist())) for w in windows if len(w) and len(other)), default=0.0)


def test_contamination_is_that_of_all_windows(spark):
    rnd = random.Random(12)
    bench = [sentence(rnd, n) for n in (14, 25, 40, 59)] + ["three word item", "", None]
    texts = [None, "", sentence(rnd, 50), "a three word item here", bench[1], "Three WORD, item"]
    for b in bench[:4]:
        words = b.split()
        texts.append(sentence(rnd, 30) + " " + b.upper() + ". " + sentence(rnd, 5))
        texts.append(" ".join(words[:-1]))
        words[len(words) // 2] = "changed"
        texts += [sentence(rnd, 8) + "\n" + " ".join(words), " ".join(words[: len(words) // 2])]
    docs = documents(spark, list(enumerate(texts)), extra=True)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(docs, items(spark, list(enumerate(bench)))).collect()}
    want = {(d, i): s for d, t in enumerate(texts) for i, b in enumerate(bench) if t and b and (s := window_similarities(t, b)) >= 0.8}
    assert got == pytest.approx(want)
    kept = decontaminate.keep_clean(docs, items(spark, list(enumerate(bench))))
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in want} and kept.columns == docs.columns


def test_blocks_select_and_guarantee_the_radius():
    radii = decontaminate.block_radii()
    assert sum(r + 1 for r in radii) == decontaminate.RADIUS + 1
    meets = sum(len(decontaminate.probe_masks(r)) for r in radii) / (1 << decontaminate.BLOCK_BITS)
    assert meets < 0.1  # a bound of the share of random pairs that agree in some block
    rnd = np.random.default_rng(3)
    for _ in range(300):  # any change of at most the radius leaves some block within its share
        changed = np.zeros(decontaminate.BITS, bool)
        changed[rnd.choice(decontaminate.BITS, decontaminate.RADIUS, replace=False)] = True
        assert any(c.sum() <= r for c, r in zip(changed.reshape(decontaminate.BLOCKS, -1), radii))


def test_contamination_near_the_threshold(spark):
    rnd = random.Random(77)
    bench, texts = [sentence(rnd, rnd.randint(30, 120)) for _ in range(250)], []
    for b in bench:
        words = b.split()
        cut = rnd.randint(0, len(words) // 9)
        words = words[cut:] if rnd.random() < 0.5 else words[: len(words) - cut]
        if rnd.random() < 0.5:
            words[rnd.randrange(len(words))] = "changed"
        texts.append(" ".join([sentence(rnd, 40), *words, sentence(rnd, 40)]))
    docs = documents(spark, list(enumerate(texts)))
    want = {(i, i): s for i, (t, b) in enumerate(zip(texts, bench)) if (s := window_similarities(t, b)) >= 0.8}
    assert len(want) > 150 and sum(s < 0.85 for s in want.values()) > 30
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_contamination(docs, items(spark, list(enumerate(bench)))).collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)


def test_contamination_of_long_items_and_repeated_rows(spark):
    rnd = random.Random(78)
    long, short = sentence(rnd, 3000), sentence(rnd, 20)
    bench = [(7, long), (5, short), (4, short.upper()), (None, short), (9, "seldom " * 30)]
    rows = [(1, long + " tail"), (1, long + " tail"), (1, short), (None, short), (3, "x " + short), (3, sentence(rnd, 30)), (4, "Seldom " * 40)]
    docs = documents(spark, rows).selectExpr("*", "1 AS `_key`", "2 AS `key`", "3 AS row", "4 AS content", "5 AS item")
    bench = items(spark, bench).selectExpr("*", "1 AS n", "2 AS item", "3 AS shingles")
    got = sorted((r.doc_id or 0, r.item_id, r.n_items, r.similarity == 1, r.first_word) for r in decontaminate.find_contamination(docs, bench).collect())
    assert got == [(0, 4, 3, True, 0), (1, 4, 3, True, 0), (1, 7, 1, True, 0), (1, 7, 1, True, 0), (3, 4, 3, True, 1), (4, 9, 1, True, 0)]
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns and [(r.doc_id, r.text) for r in kept.collect()] == [(3, rows[5][1])]


def test_contamination_of_nothing(spark):
    docs = documents(spark)
    assert decontaminate.find_contamination(docs, items(spark, [])).count() == 0
    assert decontaminate.find_contamination(documents(spark, []), items(spark, [(1, "a b c d e f")])).count() == 0
    assert decontaminate.keep_clean(docs, items(spark, [])).count() == docs.count()


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        centre = rng.normal(size=(6, 16))
        for i in range(150):
            rows.append((len(rows), (centre[i % 6] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).tolist(), label))
    same = rows[0][1]
    rows += [(len(rows) + k, same, 0) for k in range(5)] + [(900, same, 1), (901, same, None)]
    rows += [(910, None, 0), (911, [], 0), (912, [0.0] * 16, 0), (913, [float("nan")] * 16, 0), (914, [float("inf")] + [0.0] * 15, 0),
             (915, [None] + [1.0] * 15, 0), (916, [1.0, 2.0], 0)]
    return rows


@pytest.mark.parametrize("block", [2048, 16])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    monkeypatch.setattr(vectors, "LIST_ROWS", 32)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS weight", "2 AS block", "3 AS home")
    usable = [r for r in rows if r[2] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    unit = np.array([r[1] for r in usable], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = brute_links(len(usable), lambda i, j: usable[i][2] == usable[j][2] and unit[i] @ unit[j] >= 0.93)
    want = {r[0]: (0, r[0], True) for r in rows}
    want |= {r[0]: (n, usable[c][0], usable[c][0] == r[0]) for r, (n, c) in zip(usable, links)}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()}
    assert got == want


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(none).count() == 0
    useless = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vectors.near_duplicates(useless).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_vectors_of_other_lengths_and_repeated_ids_keep_their_links(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (2, [0.0, 1.0, 0.0], 0), (3, [1.0, 0.001], 0), (4, [1.0, 0.0], 0), (5, [1.0, 0.0], 1),  # two short ones
            (7, [0.0, 0.0, 1.0], 2), (7, [1.0, 1.0, 0.0], 2), (8, [0.0, 0.01, 1.0], 2), (9, [1.0, 1.0, 0.01], 2),
            (None, [3.0, -1.0, 0.0], 3), (None, [3.0, -1.0, 0.0], 3), (6, [3.0, -1.001, 0.0], 3), (None, [0.0, 5.0, 5.0], 3)]
    got = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()), key=repr)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True), (6, 2, 6, True), (7, 1, 7, True), (7, 1, 7, True),
            (8, 1, 7, False), (9, 1, 7, False), (None, 2, 6, False), (None, 2, 6, False), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("lists", [None, 60])
def test_recall_with_many_lists(spark, lists):
    """64 dimensions, planted pairs just above the threshold, at least half random: no link of all pairs is missed."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [*base]
    for v in base[:600]:
        away = rng.normal(size=64)
        away -= (away @ v) * v
        away /= np.linalg.norm(away)
        cosine = rng.uniform(0.931, 0.95)
        rows.append(cosine * v + (1 - cosine**2) ** 0.5 * away)
    unit = np.array(rows, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.93
    np.fill_diagonal(close, False)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(frame, lists=lists).collect()}
    found, all_links = sum(got.values()), int(close.sum())
    assert all(got[i] <= n for i, n in enumerate(close.sum(1))) and found >= 0.99 * all_links and all_links >= 1200
