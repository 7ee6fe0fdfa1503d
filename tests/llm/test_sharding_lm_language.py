import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from cases import documents, sentence
from pyspark.sql import functions as F

from larkfield.llm import interpolation, language, sharding


def shards_of(docs, n):
    return sharding.balanced_shards(sharding.text_groups(docs), shards=n).collect()


@pytest.mark.parametrize("n", [3, 8])
def test_shards_are_even_and_gapless(spark, n):
    docs = documents(spark, extra=True)
    rows = shards_of(docs, n)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    sizes = [len(by_shard[k]) for k in range(n)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())


def test_equal_texts_share_a_shard_unless_it_is_full(spark):
    rows = [(i, f"text {i % 40}") for i in range(80)] + [(100 + i, "hot") for i in range(60)] + [(200 + i, f"lone {i}") for i in range(100)]
    found = shards_of(documents(spark, rows), 4)
    shards = defaultdict(set)
    text = dict(rows)
    for r in found:
        shards[text[r.doc_id]].add(r.shard)
    assert len(shards["hot"]) <= 2  # a shard holds 60
    assert sum(len(s) > 1 for t, s in shards.items() if t != "hot") <= 4
    assert sorted(Counter(r.shard for r in found).values()) == [60] * 4


def test_shards_without_slack_exchange_members(spark):
    rows = [(i, f"text {i % 40}") for i in range(80)] + [(100 + i, "hot") for i in range(60)]
    found = shards_of(documents(spark, rows), 4)
    text = dict(rows)
    together = Counter((text[r.doc_id], r.shard) for r in found)
    kept = sum(n * (n - 1) // 2 for n in together.values())
    spread = 4 * (15 * 14 // 2)  # the hot text spread evenly, every pair cut
    assert kept > 1.2 * spread
    assert sorted(Counter(r.shard for r in found).values()) == [35] * 4


def test_no_rows(spark):
    assert shards_of(documents(spark, []), 4) == []


def test_language_model_scores(spark):
    rnd = random.Random(8)
    rows = [(i, sentence(rnd, 30).upper() if i % 7 == 0 else " ".join(rnd.choice("abcde") for _ in range(rnd.randint(0, 40)))) for i in range(90)]
    rows += [(90, None), (91, ""), (92, "\t \x0b"), (93, "neverseen\xa0glued"), (None, "a b")]
    docs = documents(spark, rows, extra=True)
    got = {r.doc_id: r for r in interpolation.score_documents(docs, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 2).collect()}
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)), None] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if i is not None and i % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert got[i].base_score == pytest.approx(base, abs=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)


def test_learned_weights_beat_equal_ones(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(x for _ in range(20) for x in rnd.choice((("new", "york"), ("san", "jose"), ("the", rnd.choice("pqrst"))))))
            for i in range(100)]
    scored = interpolation.score_documents(documents(spark, rows), F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 2)
    held_out = scored.filter(F.col("doc_id") % 5 == 1).agg(F.sum("score"), F.sum("base_score")).first()
    assert held_out[0] > 0.7 * held_out[1] and held_out[0] > held_out[1]


def test_em_finds_the_mixture_of_held_out_counts():
    # ratios 4 and 1/4 to the uniform estimate: two thirds of the tokens are explained by the bigram
    table = [(3, 2 * interpolation.STEPS, interpolation._NONE, 600), (3, interpolation._NONE, 2 * interpolation.STEPS, 300)]
    w = interpolation.Weights.learned(table).by_bucket[3]
    assert w.sum() == pytest.approx(1) and w[0] == pytest.approx(2 / 3, abs=0.02)


@pytest.mark.parametrize("held_bytes", [1, 4000, 1 << 26])
def test_documents_are_dealt_compressed_and_whole(monkeypatch, held_bytes):
    rnd = random.Random(12)
    rows = [(i % 37 if i % 11 else None, sentence(rnd, 60) if i % 13 else (None if i % 2 else ""), i % 3, i % 5) for i in range(400)]
    docs = pa.table(dict(zip(("doc_id", "text", "role", "block"), zip(*rows))))
    monkeypatch.setattr(interpolation, "HELD_BYTES", held_bytes)
    empty = pa.RecordBatch.from_pylist([], docs.schema)
    dealt = pa.Table.from_batches(interpolation._pieces(iter([empty, *docs.to_batches(max_chunksize=90), empty])))
    found = [(r["doc_id"], r["text"], r["role"], block) for block in range(5)
             for r in interpolation._docs(dealt.filter(pc.equal(dealt["block"], block))).to_pylist()]
    assert Counter(found) == Counter(rows)
    if held_bytes > docs.nbytes:
        assert dealt.num_rows == 5 and dealt["docs"].nbytes < docs.nbytes / 2


def test_counts_of_a_block_are_sent_once():
    docs = pa.record_batch({"doc_id": [1, 2], "text": ["a b a", None], "role": [interpolation.DELETED] * 2, "block": [9, 9]})
    sent = interpolation._sent(1)(pa.Table.from_batches([interpolation._by_block([docs])]))
    assert sent.column_names == ["n", "part", "block", "asks", "keys", "train"] and sent["asks"].to_pylist() == [True, True]
    answers = [interpolation._totals(sent.filter(pc.equal(sent["n"], n))) for n in (1, 2)]
    assert [sorted(interpolation.unpacked(a["train"][0].as_py()).tolist()) for a in answers] == [[1, 2, 2], [1, 1, 1, 1, 1]]
    assert all(a["train"][0] == a["deleted"][0] and a["left_tokens"][0].as_py() == 0 for a in answers)


def test_model_without_training_or_rows(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    rows = interpolation.score_documents(docs, F.lit(False), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score <= 0 for r in rows) and len(rows) == 2
    assert interpolation.score_documents(documents(spark, []), F.lit(True), F.lit(False)).count() == 0


def two_languages(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(120):
        syllables = ("the", "ing", "er", "wh") if i % 2 == 0 else ("sch", "ung", "ei", "ü")
        rows.append((i, " ".join("".join(rnd.choice(syllables) for _ in range(2)) for _ in range(40))))
    return documents(spark, [*rows, (200, None), (201, ""), (202, "123 !?"), (206, "q" * 5000), (210, "éå" * 3)], extra=True)


def test_language_of_held_out_texts(spark):
    docs = two_languages(spark)
    model = language.fit(docs, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r for r in model.predict(docs).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i].lang_pred == ("en", "de")[i % 2] for i in range(120) if i != 3)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (200, 201, 202))
    assert got[206].rejected and got[206].lang_pred in ("en", "de")
    kept = model.keep(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.rejected}
    assert all(not got[i].rejected for i in range(120))


def test_language_without_labels_or_rows(spark):
    docs = documents(spark, [(1, "some text"), (2, None)])
    model = language.fit(docs, F.lit(False))
    assert {(r.lang_pred, r.score, r.rejected) for r in model.predict(docs).collect()} == {("und", 0.0, True)}
    assert language.fit(documents(spark, []), F.lit(True)).predict(documents(spark, [])).count() == 0


def test_trigrams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Grüße an alle, die the river hören. " * 50
    whole = np.concatenate(list(language.trigrams(text)))
    monkeypatch.setattr(language, "_PIECE", 37)
    assert np.concatenate(list(language.trigrams(text))).tolist() == whole.tolist()


def test_language_statistics_cover_all_labelled_rows(spark):
    docs = two_languages(spark)
    model = language.fit(docs, F.lit(True), sample_rows=4)  # few texts for the centroids, all for the rest
    texts = [r.text for r in docs.collect() if r.lang is not None and r.text]
    held = np.array([language.counts(t) > 0 for t in texts])
    held = held[held.any(1)]
    assert np.allclose(model.idf, np.log((1 + len(held)) / (1 + held.sum(0))) + 1)
    assert len(model.languages) <= 4 and (np.diff(model.floors) >= 0).all()


def test_language_middle_window():
    text = "abcdefghij klmnop " * 9
    whole = np.concatenate(list(language.trigrams(text)))
    assert language._middle(text, 10_000).tolist() == whole.tolist()
    low = (len(whole) - 16) // 2
    assert language._middle(text, 16).tolist() == whole[low : low + 16].tolist()
