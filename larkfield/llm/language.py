"""Language of a text by its nearest TF-IDF centroid, with a distance that rejects strangers.

A text becomes counts of hashed letter trigrams (bytes of its lower-cased UTF-8, anything that is
no letter is a word border), weighted ``(1 + ln tf) * idf`` and scaled to length one. Each language
is described by a few centroids, found by spherical k-means over a bounded sample of labelled
texts; document frequencies come from all labelled texts. A text takes the language of the centroid with the largest cosine.

Short texts are farther from every centroid than long ones, so the rejection distance depends on
the number of trigrams: for each power of two, windows of that many trigrams are cut from the middle
of every labelled text and half of the cosine that all but one in a hundred reach is the floor. A text below the
floor of its length is rejected.

Defined cases: null text, empty text and text without a letter give ``und``, score 0 and are
rejected. Equal cosines take the language that sorts first. Rows whose label is null are never
learned from. Without any labelled row every text is ``und``. Repeated rows are judged alike.
Texts are read whole, in pieces that share two bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkfield.llm.common import text_slices
from larkfield.session import checkpointed, within_bytes

FEATURES = 1 << 13
UNKNOWN = "und"
_PIECE = 1 << 20
_LEVELS = 16

_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of a text's letter trigrams, in order, a piece at a time."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for start in range(0, len(raw) - 2, _PIECE):
        a = _LETTER[raw[start : start + _PIECE + 2]]
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        code = code[a[1:-1] > 0] * np.uint32(2654435761)
        yield code >> np.uint32(32 - 13)


def counts(text: str) -> np.ndarray:
    total = np.zeros(FEATURES, np.int64)
    for part in trigrams(text):
        total += np.bincount(part, minlength=FEATURES)
    return total


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors of rows of counts."""
    v = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * idf
    return v / np.maximum(np.sqrt((v * v).sum(-1, keepdims=True)), 1e-300)


def _clusters(v: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids of rows ``v``; seeds are the rows farthest from those before."""
    seeds = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        seeds.append(v[np.argmin((v @ np.array(seeds).T).max(1))])
    centres = np.array(seeds)
    for _ in range(rounds):
        nearest = (v @ centres.T).argmax(1)
        centres = np.array([v[nearest == j].mean(0) if (nearest == j).any() else c for j, c in enumerate(centres)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)
    return centres


@dataclass
class LanguageModel:
    """Centroids (unit rows), the language of each, idf, and the cosine floor by length."""

    centroids: np.ndarray
    languages: list[str]
    idf: np.ndarray
    floors: np.ndarray

    def nearest(self, tf: np.ndarray) -> tuple[str, float]:
        cosines = self.centroids @ weighted(tf, self.idf)
        best = float(cosines.max())
        return min(self.languages[i] for i in np.flatnonzero(cosines == best)), min(1.0, max(0.0, best))

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine and whether the text is too far from every centroid."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        tf = counts(text)
        lang, score = self.nearest(tf)
        return lang, score, score < self.floors[_level(int(tf.sum()))]

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, lang_pred, score, rejected of every document, in one pass."""
        judge = self.judge

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                lang, score, rejected = zip(*map(judge, part.column("text").to_pylist()))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(lang, pa.string()),
                                                  "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

        plain = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
        return plain.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")

    def keep(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """All columns of the documents that are not rejected."""
        judge, position = self.judge, docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches):
                yield part.filter(pa.array([not judge(t)[2] for t in part.column(position).to_pylist()], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)


def _level(n: int) -> int:
    return min(_LEVELS - 1, max(1, n).bit_length() - 1)


def _sparse_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches):
        found = [counts(t) for t in part.column("text").to_pylist()]
        at = [np.flatnonzero(c) for c in found]
        yield pa.RecordBatch.from_pydict({
            "lang": part.column("lang"), "at": pa.array([i.astype(np.int32) for i in at], pa.list_(pa.int32())),
            "tf": pa.array([c[i] for c, i in zip(found, at)], pa.list_(pa.int64()))})


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts hold each feature, and under -1 how many hold any."""
    seen, texts = np.zeros(FEATURES, np.int64), 0
    for part in text_slices(batches):
        for text in part.column("text").to_pylist():
            held = counts(text) > 0
            seen += held
            texts += bool(held.any())
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_pydict({"feature": pa.array([-1, *at], pa.int32()), "n": pa.array([texts, *seen[at]], pa.int64())})


def fit(docs: DataFrame, learn: Column, sample_rows: int = 2000, centroids: int = 3,
        lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id") -> LanguageModel:
    """Learn from rows where ``learn`` holds and the label is not null.

    Document frequencies and floors come from all of these rows. ``sample_rows`` bounds the expected
    number of distinct texts that the centroids are fitted on, shared evenly by the languages; which are
    drawn depends on a hash of id and text. With more languages than ``sample_rows`` some are not drawn.
    """
    labelled = docs.filter(learn & docs[lang_col].isNotNull()).select(
        docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"), F.xxhash64(docs[id_col], docs[text_col]).alias("h")
    ).filter(F.length("text") > 0)
    sizes = checkpointed(labelled.groupBy("lang").agg(F.count("*").alias("n")))
    nothing = LanguageModel(np.zeros((0, FEATURES)), [], np.ones(FEATURES), np.zeros(_LEVELS))
    shares = sizes.count()
    if not shares:
        return nothing
    scale = 1 << 30
    drawn = labelled.join(within_bytes(sizes), "lang").filter(F.pmod("h", F.lit(scale)) * F.col("n") * shares < scale * sample_rows)
    sample = drawn.groupBy("lang", "h").agg(F.first("text").alias("text"))  # repeated rows count once
    rows = sample.select("lang", "text").mapInArrow(_sparse_counts, "lang string, at array<int>, tf array<long>").collect()
    rows = sorted((r for r in rows if r.at), key=lambda r: (r.lang, r.at, r.tf))
    languages = sorted({r.lang for r in rows})
    if not languages:
        return nothing
    held = labelled.select("text").mapInArrow(_document_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(FEATURES)
    texts = next(r.n for r in held if r.feature < 0)
    for r in held:
        if r.feature >= 0:
            seen[r.feature] = r.n
    idf = np.log((1 + texts) / (1 + seen)) + 1
    centres, names = [], []
    for lang in languages:
        tf = np.zeros((sum(r.lang == lang for r in rows), FEATURES), np.float32)
        for i, r in enumerate(r for r in rows if r.lang == lang):
            tf[i, r.at] = r.tf
        found = _clusters(weighted(tf, idf), centroids)
        centres.append(found)
        names += [lang] * len(found)
    model = LanguageModel(np.concatenate(centres), names, idf, np.zeros(_LEVELS))
    model.floors = _floors(model, labelled)
    return model


def _middle(text: str, size: int) -> np.ndarray:
    """The ``size`` trigrams around the middle of the whole text, all if it has fewer."""
    total = sum(map(len, trigrams(text)))
    low, at, out = max(0, (total - size) // 2), 0, [np.zeros(0, np.uint32)]
    for part in trigrams(text):
        out.append(part[max(0, low - at) : max(0, low + size - at)])
        at += len(part)
    return np.concatenate(out)


def _floors(model: LanguageModel, labelled: DataFrame) -> np.ndarray:
    """Half of the cosine that 99 of 100 windows of each length reach, never rising with brevity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {lang: model.centroids[[i for i, x in enumerate(model.languages) if x == lang]] for lang in set(model.languages)}
        for part in text_slices(batches):
            levels, cosines = [], []
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                if lang not in of:
                    continue
                codes = _middle(text, 1 << _LEVELS - 1)
                for level in range(_LEVELS):
                    if len(codes) >= 1 << level:
                        start = (len(codes) - (1 << level)) // 2
                        at, tf = np.unique(codes[start : start + (1 << level)], return_counts=True)
                        levels.append(level)
                        cosines.append(float((of[lang][:, at] @ weighted(tf, model.idf[at])).max()))
            yield pa.RecordBatch.from_pydict({"level": pa.array(levels, pa.int32()), "cosine": pa.array(cosines, pa.float64())})

    reached = labelled.select("lang", "text").mapInArrow(run, "level int, cosine double")
    found = {r.level: r.c for r in reached.groupBy("level").agg(F.percentile_approx("cosine", 0.01, 10_000).alias("c")).collect()}
    floors, last = np.zeros(_LEVELS), 0.0
    for level in range(_LEVELS):
        last = max(last, found.get(level, 0.0) / 2)
        floors[level] = last
    return floors
