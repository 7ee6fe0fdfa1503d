"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The inertia of a shifted matrix tells how many eigenvalues lie above the shift: factor it as LDLᵀ
and count the positive eigenvalues of D. Bisection on these counts isolates each leading eigenvalue in an
interval of its own, Rayleigh quotient iteration then converges cubically inside it, and counts just
above and below every value found certify its number. The matrix has a side per vector entry, never per
row, so it fits in the driver.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps
#: Bunch and Kaufman's bound on the growth of a pivot step.
_ALPHA = (1 + 17**0.5) / 8


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``matrix`` above ``shift``, by a pivoted LDLᵀ of the shifted matrix."""
    a = matrix - shift * np.eye(len(matrix))
    tiny, above = _EPS * _EPS * max(1.0, np.abs(a).max(initial=0)), 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        largest = column[r - 1] if r else 0.0
        width, swap = 1, 0
        if r and abs(a[0, 0]) < _ALPHA * largest:
            others = np.abs(a[r])
            others[r] = 0
            reach = others.max()
            if abs(a[0, 0]) * reach < _ALPHA * largest * largest:
                width, swap = (1, r) if abs(a[r, r]) >= _ALPHA * reach else (2, r)
        if swap:
            order = np.arange(len(a))
            order[width - 1], order[swap] = swap, width - 1
            a = a[np.ix_(order, order)]
        if width == 1:
            pivot = a[0, 0] if abs(a[0, 0]) > tiny else tiny
            above += pivot > 0
            side = a[1:, 0]
            a = a[1:, 1:] - np.outer(side / pivot, side)
        else:  # a pivot of two rows has one eigenvalue on each side of zero
            above += 1
            side = a[2:, :2]
            a = a[2:, 2:] - side @ np.linalg.solve(a[:2, :2], side.T)
    return int(above)


def _intervals(matrix: np.ndarray, k: int, high: float, width: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): the eigenvalues numbered first..last, one of them unless they are too close."""
    found, todo = [], [(-high, high, 0, len(matrix))]
    while todo:
        low, up, before, upto = todo.pop()
        if upto == before or before >= k:
            continue
        if upto - before == 1 or up - low <= width:
            found.append((low, up, before + 1, upto))
            continue
        middle = (low + up) / 2
        here = count_above(matrix, middle)
        todo += [(low, middle, here, upto), (middle, up, before, here)]
    return sorted(found, key=lambda f: f[2])


def _solved(matrix: np.ndarray, shift: float, v: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0, 1, 4):
        try:
            out = np.linalg.solve(matrix - (shift + nudge * _EPS * scale) * np.eye(len(matrix)), v)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out / np.linalg.norm(out)
    raise RuntimeError("no shift next to an eigenvalue could be solved")


def _apart(v: np.ndarray, earlier: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for u in earlier:
            v = v - (u @ v) * u
    return v / np.linalg.norm(v)


def _refined(matrix: np.ndarray, low: float, high: float, single: bool, earlier: list[np.ndarray], scale: float,
             seed: int) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration inside an interval, which is halved whenever the quotient leaves it."""
    rng = np.random.default_rng(seed)
    number = count_above(matrix, high)
    while True:
        middle = (low + high) / 2
        v = _apart(rng.standard_normal(len(matrix)), earlier)
        for _ in range(3):
            v = _apart(_solved(matrix, middle, v, scale), earlier)
        value, best = float(v @ matrix @ v), (np.inf, 0.0, v)
        for _ in range(12):
            if not low - _EPS * scale * len(matrix) <= value <= high + _EPS * scale * len(matrix):
                break
            rest = float(np.linalg.norm(matrix @ v - value * v))
            if rest >= best[0] / 2:
                break
            best = (rest, value, v)
            v = _apart(_solved(matrix, value, v, scale), earlier)
            value = float(v @ matrix @ v)
        if best[0] <= 64 * _EPS * scale * len(matrix) ** 0.5 or high - low <= 4 * _EPS * scale:
            return best[1], best[2]
        if not single:
            high, low = high + _EPS * scale, low - _EPS * scale  # other random start
            continue
        if count_above(matrix, middle) > number:
            low = middle
        else:
            high = middle


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest positive eigenvalues, falling, and their unit eigenvectors as columns.

    Eigenvalues that rounding cannot tell from 0 are left out, so there may be fewer than ``k``.
    """
    d = len(matrix)
    trace = float(np.trace(matrix))
    if d == 0 or not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    scaled = (matrix + matrix.T) / (2 * trace)
    floor = 8 * d * _EPS
    high = float(np.abs(scaled).sum(1).max()) * (1 + d * _EPS) + floor
    k = min(k, count_above(scaled, floor))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for low, up, first, last in _intervals(scaled, k, high, 8 * _EPS * high):
        for number in range(first, min(last, k) + 1):
            value, vector = _refined(scaled, low, up, first == last, vectors, high, number)
            values.append(value)
            vectors.append(vector)
    order = np.argsort(-np.array(values), kind="stable")
    values = np.array(values)[order]
    _certify(scaled, values, 64 * d**0.5 * _EPS * high)
    return values * trace, np.stack([vectors[i] for i in order], 1) if len(order) else np.zeros((d, 0))


def _certify(matrix: np.ndarray, values: np.ndarray, slack: float) -> None:
    """Counts beside every value, or every run of values closer than ``slack``, must give its number."""
    start = 0
    for i in range(len(values)):
        if i + 1 < len(values) and values[i] - values[i + 1] <= 2 * slack:
            continue
        above, upto = count_above(matrix, values[start] + slack), count_above(matrix, values[i] - slack)
        if above != start or upto < i + 1 or (upto > i + 1 and i + 1 < len(values)):
            raise RuntimeError(f"eigenvalues {start + 1} to {i + 1} are not numbered rightly: {above} above, {upto} down to the last")
        start = i + 1
