"""Cutting stock by column generation: which patterns of piece lengths fill bins of one capacity.

The input is a histogram with one entry for each length, so the work here depends on the capacity, not on the number
of documents.
"""

from __future__ import annotations

import numpy as np


# Sums that a pricing step holds at a time.
BLOCK = 1 << 22


class Knapsack:
    """Unbounded knapsack by doubling: the best value of at most 2 ** k pieces in every capacity, until nothing gains."""

    def __init__(self, lengths: np.ndarray, value: np.ndarray, capacity: int):
        self.lengths, self.value = lengths, value
        one = np.zeros(capacity + 1)
        np.maximum.at(one, lengths, value)
        self.best = np.maximum.accumulate(one)  # no piece is worth 0
        worth = np.full(capacity + 1, -1)
        worth[lengths] = np.where(value > 0, np.arange(len(lengths)), -1)
        grows = np.concatenate([[False], self.best[1:] > self.best[:-1]])
        self.single = np.where(grows, worth, -1)[np.maximum.accumulate(np.where(grows, np.arange(capacity + 1), 0))]
        self.splits = []  # of each doubling, the room of the first half
        all_rooms = np.arange(capacity + 1)
        while True:
            padded = np.concatenate([np.full(capacity, -np.inf), self.best])
            split = np.zeros(capacity + 1, np.int64)
            best = np.empty(capacity + 1)
            rows = max(1, BLOCK // (capacity + 1))
            for lo in range(0, capacity + 1, rows):
                room = all_rooms[lo:lo + rows]
                sums = padded[capacity + room[:, None] - all_rooms] + self.best
                split[lo:lo + rows] = at = sums.argmax(1)
                best[lo:lo + rows] = sums[np.arange(len(room)), at]
            if (best <= self.best + 1e-12).all():
                break
            self.best = best
            self.splits.append(split)

    def pattern(self, capacity: int) -> np.ndarray:
        """The counts of lengths that fit into ``capacity`` and are worth most."""
        counts, todo = np.zeros(len(self.lengths), np.int64), [(len(self.splits), capacity)]
        while todo:
            level, room = todo.pop()
            if not level:
                if self.single[room] >= 0:
                    counts[self.single[room]] += 1
            elif room:
                first = int(self.splits[level - 1][room])
                todo += [(level - 1, first), (level - 1, room - first)]
        return counts


def _columns(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The worth of the best pattern, and for each length the best pattern that holds it, if it is worth more than a bin."""
    sack = Knapsack(lengths, value, capacity)
    rest = capacity - lengths
    found = []
    for i in np.flatnonzero(value + sack.best[rest] > 1 + 1e-9):
        counts = sack.pattern(int(rest[i]))
        counts[i] += 1
        found.append(counts)
    return float(sack.best[capacity]), np.unique(np.array(found, np.int64).reshape(-1, len(lengths)), axis=0)


def first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Patterns filled with the longest pieces left, each used until a length is used up.

    A pattern holds none of the lengths that were used up before, so the square of patterns by lengths is triangular.
    """
    left = demand.astype(float)
    basis = np.zeros((len(lengths), len(lengths)), np.int64)
    open_ = np.ones(len(lengths), bool)
    while open_.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        for i in np.flatnonzero(open_)[::-1]:
            counts[i] = min(room // int(lengths[i]), int(np.ceil(left[i])))
            room -= int(counts[i] * lengths[i])
        used = np.flatnonzero(counts)
        times = (left[used] / counts[used]).min()
        left -= times * counts
        done = used[left[used] <= 1e-9 * demand[used]]
        basis[done[0]] = counts
        for i in done[1:]:
            basis[i, i] = capacity // lengths[i]
        open_[done] = False
    return basis


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """By elimination. Threaded linear algebra libraries may block in a process that runs a Java gateway; this uses none."""
    m = len(matrix)
    a = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        p = i + int(np.abs(a[i:, i]).argmax())
        if p != i:
            a[[i, p]] = a[[p, i]]
        a[i] /= a[i, i]
        others = np.flatnonzero(a[:, i])
        others = others[others != i]
        a[others] -= a[others, i][:, None] * a[i]
    return a[:, m:].copy()


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(1)


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.005):
    """Patterns (rows of counts) and how often each is used, a vertex of the linear program.

    Every length's uses add up to its demand exactly. Prices of lengths come from the current basis; a knapsack finds
    the patterns worth most at these prices, which enter in turn as long as they gain. It ends when the best bound that
    a knapsack proved is within ``gap`` (or half a bin) of the bins in use.
    """
    basis = first_basis(lengths, demand, capacity)
    bound, pivots = 0.0, 0
    inverse = _inverse(basis.T)
    use = np.maximum(_times(inverse, demand), 0)
    while True:
        worth, columns = _columns(lengths, inverse.sum(0), capacity)
        bins = use.sum()
        bound = max(bound, bins / max(worth, 1.0))
        if not len(columns) or bins - bound <= max(gap * bins, 0.5):
            return basis, use
        while True:
            gains = _times(columns, inverse.sum(0))
            best = int(gains.argmax())
            if gains[best] <= 1 + 1e-9:
                break
            step = _times(inverse, columns[best])
            out = np.flatnonzero(step > 1e-9)
            ratio = use[out] / step[out]
            leave = out[int(ratio.argmin())]
            move = float(ratio.min())
            use -= move * step
            use[leave] = move
            np.maximum(use, 0, out=use)
            basis[leave] = columns[best]
            pivots += 1
            if pivots % 100:
                pivot = inverse[leave] / step[leave]
                inverse -= np.outer(step, pivot)
                inverse[leave] = pivot
            else:
                inverse = _inverse(basis.T)
                use = np.maximum(_times(inverse, demand), 0)


def plan(histogram: dict[int, int], capacity: int, unit: int = 4, min_fill: float = 0.98):
    """Patterns {length: count} with the number of bins that use each, and what is left over as a histogram.

    The program runs on lengths in whole units. Its uses are rounded down and patterns that leave more than
    ``1 - min_fill`` of their bin empty are not used; the lengths of all these pieces come back as left over.
    """
    lengths = np.array(sorted({-(-n // unit) for n, count in histogram.items() if count and -(-n // unit) <= capacity // unit}), np.int64)
    if not len(lengths):
        return [], {n: c for n, c in histogram.items() if c}
    pools = {int(u): [] for u in lengths}  # exact lengths of a unit length with their counts, longest first
    for n in sorted(histogram, reverse=True):
        if histogram[n]:
            pools.setdefault(-(-n // unit), []).append([n, histogram[n]])
    demand = np.array([sum(c for _, c in pools[int(u)]) for u in lengths], np.int64)
    basis, use = solve(lengths, demand.astype(float), capacity // unit)
    whole = np.floor(use + 1e-7).astype(np.int64)
    out = []
    for row, k in sorted(zip(basis.tolist(), whole.tolist()), key=lambda x: -sum(a * int(u) for a, u in zip(x[0], lengths))):
        counts = {int(u): a for u, a in zip(lengths, row) if a}
        if sum(u * a for u, a in counts.items()) * unit < min_fill * capacity:
            break
        while k > 0:
            # Slots of a unit length take an exact length as long as it lasts.
            chosen, times = {}, k
            for u, a in counts.items():
                pool = pools[u]
                while pool and not pool[-1][1]:
                    pool.pop()
                need = a
                for n, c in reversed(pool):
                    got = min(need, c)
                    if got:
                        chosen[n], need = got, need - got
                        times = min(times, c // got)
                    if not need:
                        break
                if need:
                    times = 0
                    break
            if not times:
                break
            for n, got in chosen.items():
                next(p for p in pools[-(-n // unit)] if p[0] == n)[1] -= got * times
            if sum(n * c for n, c in chosen.items()) >= min_fill * capacity:
                out.append((chosen, times))
            else:
                for n, got in chosen.items():
                    next(p for p in pools[-(-n // unit)] if p[0] == n)[1] += got * times
                break
            k -= times
    return out, {n: c for pool in pools.values() for n, c in pool if c}
