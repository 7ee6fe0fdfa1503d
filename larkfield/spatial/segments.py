"""Exact tests on stacks of segments, rows (x1, y1, x2, y2)."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

# The functions travel inside the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _side(p, q, r):
    return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])


def segments_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For stacks (m, na, 4) and (m, nb, 4): does any segment of a touch one of b?"""
    ap, aq = (a[:, :, None, 0], a[:, :, None, 1]), (a[:, :, None, 2], a[:, :, None, 3])
    bp, bq = (b[:, None, :, 0], b[:, None, :, 1]), (b[:, None, :, 2], b[:, None, :, 3])
    meets = np.ones((len(a), a.shape[1], b.shape[1]), dtype=bool)
    for i in (0, 1):
        meets &= np.maximum(ap[i], aq[i]) >= np.minimum(bp[i], bq[i])
        meets &= np.minimum(ap[i], aq[i]) <= np.maximum(bp[i], bq[i])
    # Neither segment may lie wholly on one side of the other's line.
    meets &= _side(bp, bq, ap) * _side(bp, bq, aq) <= 0
    meets &= _side(ap, aq, bp) * _side(ap, aq, bq) <= 0
    return meets.any(axis=(1, 2))


def holds_any(outline: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Even-odd rule per pair: does the closed outline hold an end of the other's segments?"""
    x1, y1, x2, y2 = (outline[:, :, i, None] for i in range(4))
    inside = np.zeros(len(outline), dtype=bool)
    for k in (0, 2):
        x, y = points[:, None, :, k], points[:, None, :, k + 1]
        spans = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        inside |= ((spans & (x < at)).sum(axis=1) % 2 == 1).any(axis=1)
    return inside


def meet(a: np.ndarray, a_area: np.ndarray, b: np.ndarray, b_area: np.ndarray) -> np.ndarray:
    hit = segments_meet(a, b)
    for outline, points, area in ((b, a, b_area), (a, b, a_area)):
        open_ = np.flatnonzero(~hit & area)
        if len(open_):
            hit[open_] = holds_any(outline[open_], points[open_])
    return hit


#: Cells of the largest array that a test makes.
CHUNK = 2_000_000
_BLOCK = 512


def meet_large(a: np.ndarray, a_area: bool, b: np.ndarray, b_area: bool) -> bool:
    """The test of one large pair: blocks of segments against those that reach the block's box.

    No array has more than ``CHUNK`` cells, however many points the shapes have.
    """
    low, high = np.minimum(b[:, :2], b[:, 2:]), np.maximum(b[:, :2], b[:, 2:])
    for start in range(0, len(a), _BLOCK):
        block = a[start : start + _BLOCK]
        least, most = np.minimum(block[:, :2], block[:, 2:]).min(0), np.maximum(block[:, :2], block[:, 2:]).max(0)
        near = b[((high >= least) & (low <= most)).all(1)]
        step = max(1, CHUNK // len(block))
        for at in range(0, len(near), step):
            if segments_meet(block[None], near[None, at : at + step]).any():
                return True
    for outline, points, is_area in ((b, a, b_area), (a, b, a_area)):
        step = max(1, CHUNK // len(outline))
        for at in range(0, len(points) if is_area else 0, step):
            if holds_any(outline[None], points[None, at : at + step]).any():
                return True
    return False
