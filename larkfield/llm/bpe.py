"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

A word is a string of byte characters whose last one carries the end mark. An Aho-Corasick
automaton finds every vocabulary token inside the word in one pass. The encoder walks from the
left, always trying the longest token that starts here. Two neighbouring tokens are accepted only
if merging could never have crossed the border between them; that answer is kept in a
compatibility table. If no token fits, the walk steps back one token and marks the position as
no border, so that each position is given up at most once and the work stays linear.

Why the border test is exact: merges of a word run in the order of their rank. At the border of
tokens ``a`` and ``b`` the symbols that touch are, over time, parts on the right edge of ``a``
and on the left edge of ``b``. A part ``x`` lives until the merge that makes its parent in
``a``. The border is crossed if some pair ``(x, y)`` has a merge that comes before both
parents' merges. Equal ranks run from the left, so the parent of ``x`` wins a tie and the
parent of ``y`` loses it.

Null and empty texts give no ids. Repeated rows are encoded one by one. Texts of any length are
taken whole, split at white space in pieces whose ids do not depend on each other.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from larkfield.llm.common import RecentTable, id_and_text, text_slices

_END = "\0"
#: Entries of a generation of a coder's word table, and of its border table before it starts anew; a bound on memory only.
_TABLE_ENTRIES = 100_000
#: Python splits at these four control characters, the tokenizer does not.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown, extra = {b: chr(b) for b in printable}, 256
    for b in range(256):
        if b not in shown:
            shown[b] = chr(extra)
            extra += 1
    return [shown[b] for b in range(256)]


class WordCoder:
    """Encoder and decoder of one vocabulary file with lower-cased words and end marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        piece = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pieces = regex.compile(piece["pattern"]["Regex"]).findall
        self._bytes = dict(enumerate(byte_characters()))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = r
            self.parts.setdefault(made, (r, a, b))
        self._build(vocab)
        self._fits: dict[tuple[int, int], bool] = {}
        self._known = RecentTable(self._chunk, _TABLE_ENTRIES)
        self._table(vocab)

    def _build(self, vocab: dict[str, int]) -> None:
        """The automaton; a match is (token, length, the longest match that is a proper prefix of this one)."""
        words = {token[: -len(self.suffix)] + _END if self.suffix and token.endswith(self.suffix) else token: i
                 for token, i in vocab.items() if token not in self.specials}
        matches: dict[str, tuple] = {}
        self.automaton = ahocorasick.Automaton()
        for word in sorted(words, key=len):
            shorter = next((matches[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in matches), None)
            matches[word] = words[word], len(word), shorter
            self.automaton.add_word(word, matches[word])
        self.automaton.make_automaton()

    def _table(self, vocab: dict[str, int]) -> None:
        names = {i: t for t, i in (vocab | self.specials).items()}
        spelled = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.spelling = np.frombuffer(b"".join(spelled), np.uint8)

    def fits(self, a: int, b: int) -> bool:
        """True if ``a`` then ``b`` is how their joined text is merged."""
        known = self._fits.get((a, b))
        if known is None:
            known = self._never_crossed(a, b)
            if len(self._fits) >= _TABLE_ENTRIES:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def _never_crossed(self, x: int, y: int) -> bool:
        """Back in time: of the parts at the border, the one made last is undone first, so each pair seen did touch."""
        x_until = y_until = never = float("inf")
        made_x, made_y = self.parts.get(x), self.parts.get(y)
        while True:
            r = self.rank.get((x, y), never)
            if r < x_until and r <= y_until:
                return False
            if made_x and (not made_y or made_x[0] > made_y[0]):
                x_until, _, x = made_x
                made_x = self.parts.get(x)
            elif made_y:
                y_until, y, _ = made_y
                made_y = self.parts.get(y)
            else:
                return True

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word given in byte characters, without its end mark."""
        text = word + _END if self.suffix else word
        size = len(text)
        longest: list[tuple | None] = [None] * (size + 1)
        for end, match in self.automaton.iter(text):
            longest[end + 1 - match[1]] = match  # shorter matches come first
        no_border = [False] * (size + 1)
        path: list[tuple] = []
        pos, match, known = 0, longest[0], self._fits
        while pos < size:
            last = path[-1][0] if path else None
            while match:
                token, length, shorter = match
                if not no_border[pos + length]:
                    if last is None:
                        break
                    fits = known.get((last, token))
                    if self.fits(last, token) if fits is None else fits:
                        break
                match = shorter
            if match:
                path.append(match)
                pos += length
                match = longest[pos]
            elif path:
                no_border[pos] = True
                _, length, match = path.pop()
                pos -= length
            else:
                raise ValueError(f"no tokens spell {word!r}")
        return [p[0] for p in path]

    def _chunk(self, text: str) -> bytes:
        """Ids of normalised text without blanks, by its pieces; a piece taken alone is that piece again."""
        pieces = [text] if text.isascii() and text.isalpha() else self._pieces(text)
        if pieces != [text]:
            return b"".join(map(self._known.__getitem__, pieces))
        if not (text.isascii() and text.isprintable()):  # others stand for themselves
            text = text.encode().decode("latin-1").translate(self._bytes)
        ids = self.encode_word(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    @staticmethod
    def _normal(text: str) -> str:
        """The normaliser's own steps: composed, then each character lower-cased by itself."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _plain(self, text: str) -> bytes:
        """Ids of text that holds no special token."""
        return b"".join(map(self._known.__getitem__, self._pieces(self._normal(text))))

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return np.zeros(0, "<u4")
        if "<|" in text or _NOT_SPACE.search(text):
            out, at = [], 0
            for m in self._special.finditer(text):
                out += [self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
                at = m.end()
            return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")
        return np.frombuffer(b"".join(map(self._known.__getitem__, self._normal(text).split())), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens' spellings with one blank between them, gathered by offset."""
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        source = np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        source += np.arange(ends[-1])
        return self.spelling[source[:-1]].tobytes()


def _digests(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordCoder(path)  # the task's own: workers live on, and later stages need their memory
        for part in text_slices(batches):
            all_ids, counts, sha_ids, sha_text = [], [], [], []
            for text in part.column("text").to_pylist():
                ids = bpe.encode(text)
                counts.append(len(ids))
                sha_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                sha_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids.astype(np.int32))
            columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()),
                       "ids_sha256": pa.array(sha_ids, pa.string()), "decoded_sha256": pa.array(sha_text, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every document.

    Null and empty texts give zero tokens; an empty table gives no rows; a null or repeated id is
    passed on as it is. One pass without a shuffle, each text whole.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(_digests(path, with_ids), schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded text of each row's ``ids``; null ids give empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordCoder(path)  # the task's own: workers live on, and later stages need their memory
        for part in text_slices(batches):
            texts = [bpe.decode(np.array(ids or [], np.int64)).decode("utf-8") for ids in part.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
