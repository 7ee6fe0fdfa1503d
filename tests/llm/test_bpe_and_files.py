import hashlib
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import AWKWARD, documents
from tokenizers import Tokenizer

from larkfield.llm import bpe, common, token_files
from larkfield.llm.queries import tokenizer


@pytest.fixture(scope="module")
def word_file():
    return tokenizer("word_bpe_49k.json")


def odd_texts(n):
    rnd = random.Random(1)
    letters = "abcdeéß <|>'sdSΣ́ \n\x1d1½.,漢😀ñÑtionther"
    return [t or "" for t in AWKWARD] + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(n)] + [
        "ΑΣ ΟΔΟΣ. İstanbul", "a <|endoftext|>b<|startoftext|> <|ENDOFTEXT|>", "a" * 3000, "don't I'LL we've _x_", "x  y \n z\t"]


def test_ids_and_text_equal_the_library(word_file):
    coder, library = bpe.WordCoder(word_file), Tokenizer.from_file(word_file)
    for text in odd_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text).tolist() == ids, text
        assert coder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False).encode()


def test_compatibility_is_that_of_merging(word_file):
    coder, library = bpe.WordCoder(word_file), Tokenizer.from_file(word_file)
    rnd = random.Random(3)
    for _ in range(300):
        word = "".join(rnd.choice("abcdefghiorstn") for _ in range(rnd.randint(2, 14)))
        ids = library.encode(word, add_special_tokens=False).ids
        assert all(coder.fits(a, b) for a, b in zip(ids, ids[1:]))


def test_letters_without_a_composed_small_form(word_file):
    coder, library = bpe.WordCoder(word_file), Tokenizer.from_file(word_file)
    for text in ["J\u030c abc", "H\u0331 T\u0308 W\u030a Y\u030a", "j\u030c J\u030c \u01f0", "\u0391\u03a3 J\u030c."]:
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_frequent_words_stay_known_among_rare_ones(word_file, monkeypatch):
    monkeypatch.setattr(bpe, "_TABLE_ENTRIES", 60)
    coder, library = bpe.WordCoder(word_file), Tokenizer.from_file(word_file)
    asked = Counter()
    plain = coder.encode_word
    monkeypatch.setattr(coder, "encode_word", lambda word: asked.update([word]) or plain(word))
    rnd = random.Random(6)
    often = ["river", "stones", "grey", "birds"]
    for _ in range(80):
        rare = ["".join(rnd.choice("abcdefghiorstn") for _ in range(12)) for _ in range(15)]
        text = " ".join([*often, *rare, *(w + "," for w in often)])
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert [asked[w] for w in often] == [1, 1, 1, 1]


def test_a_recent_table_is_bounded_and_does_not_hold_its_owner():
    class Owner:
        def make(self, key):
            return key * 2

    owner = Owner()
    recent = common.RecentTable(owner.make, 10)
    for k in range(500):
        assert recent[k] == 2 * k and recent[0] == 0
        assert len(recent) + len(recent._before) <= 20
    gone = weakref.ref(owner)
    del owner
    assert gone() is None


def test_a_worker_keeps_no_coder_after_its_task(word_file, monkeypatch):
    made = []

    class Seen(bpe.WordCoder):
        def __init__(self, path):
            super().__init__(path)
            made.append(weakref.ref(self))

    monkeypatch.setattr(bpe, "WordCoder", Seen)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["some words, some more", None, "a <|endoftext|> b"]})
    rows = list(bpe._digests(word_file, True)(iter([batch])))
    assert sum(r.num_rows for r in rows) == 3
    assert made and all(ref() is None for ref in made)


def test_text_slices_give_memory_back(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"text": [str(i) for i in range(600)]})
    released = []

    class Pool:
        def release_unused(self):
            released.append(True)

    monkeypatch.setattr(common.pa, "default_memory_pool", Pool)
    parts = list(common.text_slices(iter([batch, batch.slice(0, 0), batch.slice(5, 1)])))
    assert [p.num_rows for p in parts] == [256, 256, 88, 1] and released == [True]


@pytest.mark.parametrize("extra", [False, True])
def test_documents_round_trip(spark, word_file, extra):
    docs = documents(spark, extra=extra)
    library = Tokenizer.from_file(word_file)
    encoded = bpe.encode_documents(docs, word_file)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = encoded.collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    decoded = {r.doc_id: r.text for r in bpe.decode_documents(encoded, word_file).collect()}
    assert all(decoded[r.doc_id] == library.decode(r.ids, skip_special_tokens=False) for r in rows)


def test_byte_coder_equals_the_library():
    coder = token_files.LibraryCoder(tokenizer("byte_bpe_50k.json"))
    for text in odd_texts(1500):
        assert np.frombuffer(coder.encode(text), coder.type).tolist() == coder._whole.encode(text, add_special_tokens=False).ids, text


def test_words_with_marks_ask_only_for_the_word():
    coder = token_files.LibraryCoder(tokenizer("byte_bpe_50k.json"))
    whole = coder._whole
    texts = ["He saw stones, stones. stones!\nstones; (stones) don't stones's stones1 été, été…", "x\nstones,\nstones... <|endoftext|>, a'",
             "a b'll b've!' \u02bcb, b\u0301, b`~", "one ,two 3, four-five"]
    for text in texts:
        assert np.frombuffer(coder.encode(text), coder.type).tolist() == whole.encode(text, add_special_tokens=False).ids, text
    asked = []
    plain = coder._library
    coder._library = lambda text: asked.append(text) or plain(text)
    coder.encode("He walked, stopped. Then\nwalked; and walked! walked?")
    assert asked == ["He"]


def expected_files(docs, library):
    start, out = 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length", [7, 2048])
def test_files_give_back_every_document(spark, length):
    path = tokenizer("byte_bpe_50k.json")
    docs = documents(spark, extra=True).repartition(3)
    shards = token_files.write_token_files(docs, path, token_files.fresh_folder(docs), length=length)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_digests(shards).collect())
    assert got == expected_files(docs, Tokenizer.from_file(path))


def test_sequences_are_views_of_the_file(spark):
    path = tokenizer("byte_bpe_50k.json")
    docs = documents(spark)
    shards = token_files.write_token_files(docs, path, token_files.fresh_folder(docs), length=16)
    for shard in shards.collect():
        batches = token_files.open_batches(shard.seq_path)
        n = sum(b.num_rows for b in batches)
        taken = [token_files.sequence(batches, i) for i in range(n)]
        assert all(len(ids) == 16 and not ids.flags.owndata for ids, _ in taken)
        assert sum(int(mask.sum()) for _, mask in taken) == shard.n_ids
        assert all(b.num_rows == token_files.SEQUENCES for b in batches[:-1])


def test_empty_table(spark, word_file):
    none = documents(spark, [])
    assert bpe.encode_documents(none, word_file).count() == 0
    shards = token_files.write_token_files(none, tokenizer("byte_bpe_50k.json"), token_files.fresh_folder(none))
    assert token_files.read_token_digests(shards).count() == 0
