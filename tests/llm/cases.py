"""Small tables with the awkward rows every operator has to take."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [None, "", " ", "\n\t ", "x", "...", "two words", "é́ ½ Ⅷ 漢字 😀", "a\x1cb\x85c", "<|endoftext|>", "tie tie tie tie tie tie"]
WORDS = "the river runs over old stones while seven grey birds watch from wet branches and nobody hears them sing before dawn".split()


def sentence(rnd: random.Random, n: int) -> str:
    return " ".join(rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(n))


def documents(spark, rows=None, extra=False):
    """A documents frame; by default awkward texts, copies, near copies and one long text."""
    if rows is None:
        rnd = random.Random(5)
        texts = [*AWKWARD, *[sentence(rnd, 60) for _ in range(12)]]
        base = sentence(rnd, 120)
        words = base.split()
        for k in range(6):
            texts.append(" ".join(words[:k] + ["changed"] + words[k + 1 :]))
        texts += [base, base, sentence(rnd, 6000)]
        rows = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, None if i == 3 else ("en", "de")[i % 2] if i is not None else None, "src", len(t) if t else None)
                                   for i, t in rows], DOCUMENTS)
    if extra:  # columns whose names operators use inside
        for name in ("rep", "block", "group", "label", "component", "weight", "hash", "kind", "_salt", "n", "id"):
            frame = frame.selectExpr("*", f"'clash' AS `{name}`")
    return frame


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)
