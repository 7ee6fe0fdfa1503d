"""Packing plan for whole-number lengths, made from the count of each length alone.

Linear grouping: lengths above a share of the capacity are sorted and cut into groups of equal
cardinality, each rounded up to its largest length. For these few sizes the configurations (which
sizes share a bin) are optimised as a linear program whose columns come from a knapsack. Whole
multiples of the configurations are kept, actual lengths take the places of the rounded ones, and
what is left over goes into the remaining room by best fit, longest first. What counts as small is
tried at several shares of the capacity, as rounding costs room where many lengths share a bin; the plan with the
fewest bins is taken, or the first that reaches the bound of the summed lengths.

A plan is a list of runs. Equal lengths are interchangeable, and neighbouring bins of a configuration hold equal
lengths over long stretches, so both are kept as runs: the plan's size depends on the capacity and the
number of groups, never on how many items there are.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Plan:
    """Runs: item ``rank`` of a length, counted from ``first_rank``, is number ``rank - first_rank`` of its
    run; bin ``first_bin + number // per`` holds it at ``offset + number % per * length``."""

    n_bins: int = 0
    runs: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)  # length, first_rank, items, first_bin, per, offset

    def arrays(self) -> dict[str, np.ndarray]:
        names = ("length", "first_rank", "items", "first_bin", "per", "offset")
        table = np.array(sorted(self.runs), np.int64).reshape(-1, len(names))
        return dict(zip(names, table.T.copy()))


def groups_of(counts: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Items of at least ``least``, longest first, in groups of equal cardinality: lists of (length, items).

    Groups that round up to the same length are one. Where there are no more lengths than groups, rounding
    saves nothing and every length is a group.
    """
    lengths = least + np.flatnonzero(counts[least:])[::-1]
    if len(lengths) <= groups:
        return [[(int(n), int(counts[n]))] for n in lengths]
    total = int(counts[least:].sum())
    size = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length in range(len(counts) - 1, least - 1, -1):
        left = int(counts[length])
        while left:
            if room == 0:
                out.append([])
                room = size
            took = min(left, room)
            out[-1].append((length, took))
            left, room = left - took, room - took
    merged: list[list[tuple[int, int]]] = []
    for group in out:
        if merged and merged[-1][0][0] == group[0][0]:
            merged[-1] += group
        else:
            merged.append(group)
    return merged


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of ``sizes`` within the capacity."""
    useful = np.flatnonzero(prices > 1e-12)
    pattern = np.zeros(len(sizes), np.int64)
    if not len(useful):
        return 0.0, pattern
    s, p = sizes[useful], prices[useful]
    order = np.argsort(s, kind="stable")
    s, p, useful = s[order], p[order], useful[order]
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for c in range(int(s[0]), capacity + 1):
        k = upto[c]
        values = best[c - s[:k]] + p[:k]
        i = int(values.argmax())
        if values[i] > best[c - 1]:
            best[c], choice[c] = values[i], i
        else:
            best[c] = best[c - 1]
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[useful[choice[c]]] += 1
            c -= int(s[choice[c]])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4, most_rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns: how many of each size) and how many bins use each, as a basic solution of the linear program.

    Stops when the bound that the last prices prove is within ``gap`` of the value reached; the
    solution stands either way, so ``most_rounds`` bounds time only.
    """
    n = len(sizes)
    fits = capacity // sizes
    patterns = np.diag(fits).astype(float)
    inverse = np.diag(1.0 / fits)
    amounts = demand / fits
    for rounds in range(most_rounds):
        prices = inverse.sum(0)
        value, pattern = _knapsack(sizes, prices, capacity)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        rising = step > 1e-11
        ratios = np.where(rising, amounts / np.where(rising, step, 1), np.inf)
        leave = int(ratios.argmin())
        amounts = np.maximum(amounts - ratios[leave] * step, 0)
        amounts[leave] = ratios[leave]
        patterns[:, leave] = pattern
        row = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, row)
        inverse[leave] = row
        if rounds % 64 == 63:  # rounding of the updates does not pile up
            inverse = np.linalg.inv(patterns)
            amounts = np.maximum(inverse @ demand, 0)
    return patterns.astype(np.int64), amounts


class _Bins:
    """Bins by room left, as runs of neighbouring bin numbers."""

    def __init__(self, plan: Plan, capacity: int):
        self.plan, self.capacity = plan, capacity
        self.by_room: dict[int, list[tuple[int, int]]] = {}
        self.taken = np.zeros(capacity + 1, np.int64)

    def opened(self, bins: int) -> int:
        first, self.plan.n_bins = self.plan.n_bins, self.plan.n_bins + bins
        return first

    def keep(self, room: int, first: int, bins: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append((first, bins))

    def run(self, length: int, items: int, first_bin: int, per: int, offset: int) -> None:
        self.plan.runs.append((length, int(self.taken[length]), items, first_bin, per, offset))
        self.taken[length] += items

    def fit(self, length: int, items: int) -> None:
        """Best fit of ``items`` equal lengths: the tightest bin takes them until another is tighter or it is full."""
        while items:
            room = min((r for r in self.by_room if r >= length), default=None)
            if room is None:
                bins = -(-items // (self.capacity // length))
                self.keep(self.capacity, self.opened(bins), bins)
                continue
            first, bins = self.by_room[room].pop()
            if not self.by_room[room]:
                del self.by_room[room]
            per = min(room // length, items)
            used = min(bins, items // per)
            self.run(length, used * per, first, per, self.capacity - room)
            self.keep(room - per * length, first, used)
            if bins > used:
                self.keep(room, first + used, bins - used)
            items -= used * per


def packing_plan(counts: np.ndarray, capacity: int, groups: int = 64, small_shares: tuple[float, ...] = (1 / 8, 1 / 3, 1 / 2)) -> Plan:
    """Plan for ``counts[length]`` items of each length from 1 to ``capacity``.

    ``groups`` is the number of rounded sizes; lengths of at most a small share of the capacity are small.
    """
    counts = np.asarray(counts, np.int64)
    bound = -(-sum(int(n) * length for length, n in enumerate(counts)) // capacity)
    best = None
    for share in small_shares:
        plan = _grouped_plan(counts.copy(), capacity, groups, share)
        best = plan if best is None or plan.n_bins < best.n_bins else best
        if best.n_bins == bound:
            break
    return best


def _grouped_plan(counts: np.ndarray, capacity: int, groups: int, small_share: float) -> Plan:
    plan = Plan()
    bins = _Bins(plan, capacity)
    full = int(counts[capacity])
    if full:
        bins.run(capacity, full, bins.opened(full), 1, 0)
        counts[capacity] = 0
    large = groups_of(counts, int(capacity * small_share) + 1, groups)
    if large:
        sizes = np.array([g[0][0] for g in large])
        demand = np.array([sum(n for _, n in g) for g in large], float)
        patterns, amounts = configurations(sizes, demand, capacity)
        for column in np.argsort(-amounts, kind="stable"):
            times = int(amounts[column] + 1e-9)
            slots = [g for g in range(len(large)) for _ in range(int(patterns[g, column]))]
            times = min([times, *[sum(n for _, n in large[g]) // slots.count(g) for g in set(slots)]])
            if times > 0 and slots:
                _substituted(bins, large, slots, times, counts)
    for length in range(capacity, 0, -1):  # left over and small ones
        if counts[length]:
            bins.fit(length, int(counts[length]))
    return plan


def _substituted(bins: _Bins, large: list[list[tuple[int, int]]], slots: list[int], times: int, counts: np.ndarray) -> None:
    """Actual lengths take the slots of ``times`` bins; each stretch of bins with equal lengths is one run a slot."""
    stretches = []
    for g in slots:
        group, need, stretch = large[g], times, []
        while need:
            length, n = group.pop(0)
            took = min(n, need)
            if took < n:
                group.insert(0, (length, n - took))
            stretch.append((length, took))
            need -= took
        stretches.append(stretch)
    first, done = bins.opened(times), 0
    while done < times:
        n = min(s[0][1] for s in stretches)
        offset = 0
        for s in stretches:
            length, left = s[0]
            bins.run(length, n, first + done, 1, offset)
            counts[length] -= n
            offset += length
            if left == n:
                s.pop(0)
            else:
                s[0] = (length, left - n)
        bins.keep(bins.capacity - offset, first + done, n)
        done += n
