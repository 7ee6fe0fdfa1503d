"""Suffix array of a sequence of numbers by grouping on Lyndon prefixes, in linear time.

First phase. Suffixes start in groups by their first number. Groups are taken from the largest to
the smallest. For each member the previous-smaller pointer leads to the closest position before it that
lies in a smaller group. A position that ``k`` adjacent members of the group point at continues
with ``k`` copies of the group's common prefix, so within its own group it is larger than all positions that
continue with fewer; it moves up accordingly. In the end, a group holds the suffixes with one Lyndon prefix,
and groups stand in the order of those prefixes.

Second phase. The smallest suffix is known. Whenever a suffix takes its place, the position before it and
the positions reached from there by pointers are the next smallest of their groups, until one is met that
has its place already. Nothing is renamed or sorted again.
"""

from __future__ import annotations

import numpy as np


def suffix_array(numbers: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``numbers``; the last number must be smaller than all others."""
    n = len(numbers)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(numbers, kind="stable")
    sorted_numbers = numbers[order]
    first = np.searchsorted(sorted_numbers, sorted_numbers, "left")
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    begin = np.empty(n, np.int64)
    begin[order] = first
    sizes = np.bincount(first, minlength=n + 1)
    groups, previous = _grouped(order.tolist(), at.tolist(), begin.tolist(), (np.arange(n + 1) + sizes).tolist())
    return np.array(_placed(groups, previous), np.int64)


def _grouped(order: list[int], at: list[int], group: list[int], end: list[int]) -> tuple[list[int], list[int]]:
    """Group (its first place) of every suffix by Lyndon prefix, and the previous-smaller pointers.

    ``order`` lists suffixes by group, ``at`` is their place in it, ``end`` the end of a group by its
    first place.
    """
    n = len(order)
    previous = [-1] * n
    top = n
    while top > 0:
        start = group[order[top - 1]]
        # a group of one, whose pointer is all that matters, is the common case late on
        members = order[start:top] if top - start == 1 else sorted(order[start:top])
        times: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] > start:
                j = previous[j]
            if j >= 0 and group[j] == start:  # the copy before this one; its pointer is known
                j = previous[j]
            previous[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            if len(times) == 1:
                layers = [list(times)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, k in times.items():
                    by_count.setdefault(k, []).append(j)
                layers = [by_count[k] for k in sorted(by_count, reverse=True)]
            for layer in layers:
                old = [group[j] for j in layer]
                ends = {g: end[g] for g in old}
                for j, g in zip(layer, old):  # move to the upper end of the old group
                    last = end[g] - 1
                    other, place = order[last], at[j]
                    order[last], order[place] = j, other
                    at[j], at[other] = last, place
                    end[g] = last
                for j, g in zip(layer, old):
                    group[j] = end[g]
                for g, e in ends.items():
                    end[end[g]] = e
        top = start
    return group, previous


def _placed(group: list[int], previous: list[int]) -> list[int]:
    """Fill the groups from their lower ends in the order in which suffixes become known."""
    n = len(group)
    front, placed, out = list(range(n)), [False] * n, [-1] * n
    out[0] = n - 1
    placed[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            placed[j] = True
            j = previous[j]
    return out
