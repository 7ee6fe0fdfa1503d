"""Words and five-word shingles of many texts as 64-bit hashes, computed on whole arrays of bytes.

A word is a run of letters, digits and bytes beyond ASCII in the lower-cased text; everything else
separates. A word's hash is a polynomial over random byte values, read off prefix sums, so no
Python object per word is made.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

_steps = np.random.default_rng(7).integers(1 << 40, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            table = np.ones(max(n, _PIECE + 1), np.uint64)
            done = 1
            while done < len(table):  # doubling
                more = min(done, len(table) - done)
                table[done : done + more] = table[:more] * np.uint64(pow(base, done, 1 << 64))
                done += more
            out.append(table)
        _powers[:] = out
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_values(separators: list[int], same: dict[int, int] | None = None) -> np.ndarray:
    """Random value of each byte; 0 for separators, equal for bytes that count as the same."""
    out = np.random.default_rng(20240607).integers(1 << 40, 1 << 63, 256, dtype=np.uint64)
    for b, other in (same or {}).items():
        out[b] = out[other]
    out[separators] = 0
    return out


_WORD_BYTES = byte_values([b for b in range(128) if not (48 <= b < 58 or 97 <= b < 123)])


def _piece_hashes(raw: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = values[raw]
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = v != 0
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    up, down = powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(v * up[: len(raw)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(texts: list[str | None], values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry at the end).

    With ``values`` of its own a caller says which bytes separate; the text is then not lower-cased.
    """
    if values is None:
        raw, values = [(t or "").lower().encode("utf-8", "replace") for t in texts], _WORD_BYTES
    else:
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    buffer = b"\n".join([*raw, b""])
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        cut = len(buffer)
        if cut - at > _PIECE:  # cut after a separator
            cut = max(buffer.rfind(b" ", at, at + _PIECE), buffer.rfind(b"\n", at, at + _PIECE)) + 1
            if cut <= at:
                later = [p for p in (buffer.find(b" ", at + _PIECE), buffer.find(b"\n", at + _PIECE)) if p >= 0]
                cut = min(later) + 1 if later else len(buffer)
        h, s = _piece_hashes(np.frombuffer(buffer[at:cut], np.uint8), values)
        hashes.append(h)
        starts.append(s + at)
        at = cut
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.searchsorted(s, ends)])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``size`` words from each position on, and where each text's shingles begin.

    A text of fewer words than ``size``, but at least one, has one shingle of all its words.
    """
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(n)])
    position = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    out = np.zeros(len(position), np.uint64)
    limit = np.repeat(first[1:], n)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        out += np.where(position + j < limit, padded[position + j], np.uint64(0)) * _steps[j]
    return mixed(out), begin
