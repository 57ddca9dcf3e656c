"""Periodic runs of words, by uniting suffix classes in descending order of their common prefixes.

A run is a stretch of words with smallest period q that no neighbour extends. Suffixes of one text are sorted by
prefix doubling; neighbours in that order are edges weighted with the words they share. Edges are taken from the
heaviest down, as in Kruskal's method: a union-find joins the classes of their two positions, and each class keeps its
positions in order. Two positions that become neighbours in a class at weight l, p <= l words apart, seed a run of
period p that ends l words behind the second: nothing in between shares l words with them, so p is the smallest
period. Of the seeds of one run only its leftmost pair is kept. A run of period p and length n has its leftmost pair
at weight n - p, so edges below the least such weight are never united, and texts without a repeated window of so many
words have no runs.

Each text is worked on in the task that scans it; nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytesets as bs

MIN_LENGTH, MIN_EXPONENT = 24, 3
# A class of positions is kept in sorted pieces of at most this many.
PIECE = 1024

RUNS = "n_runs bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Positions:
    """An ordered set of positions: sorted pieces and the first position of each."""

    def __init__(self, position: int):
        self.pieces, self.heads, self.size = [[position]], [position], 1

    def __iter__(self):
        for piece in self.pieces:
            yield from piece

    def add(self, x: int):
        """Insert ``x``; its neighbours, -1 where there is none."""
        k = max(0, bisect_right(self.heads, x) - 1)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else (self.pieces[k - 1][-1] if k else -1)
        after = piece[at] if at < len(piece) else (self.heads[k + 1] if k + 1 < len(self.pieces) else -1)
        piece.insert(at, x)
        if not at:
            self.heads[k] = x
        if len(piece) > PIECE:
            half = piece[PIECE // 2:]
            del piece[PIECE // 2:]
            self.pieces.insert(k + 1, half)
            self.heads.insert(k + 1, half[0])
        self.size += 1
        return before, after

    def after(self, x: int) -> int:
        k = bisect_right(self.heads, x) - 1
        at = bisect_right(self.pieces[k], x)
        if at < len(self.pieces[k]):
            return self.pieces[k][at]
        return self.heads[k + 1] if k + 1 < len(self.pieces) else -1


def least_weight(min_length: int, min_exponent: int) -> int:
    """The fewest words that the leftmost pair of a wanted run shares."""
    return min(max(min_length - p, (min_exponent - 1) * p) for p in range(1, max(2, min_length + 1)))


def suffix_edges(ids: np.ndarray, row: np.ndarray, end: np.ndarray, least: int):
    """Neighbours in the sorted suffixes of each row that share ``least`` words or more, and how many they share.

    ``end`` is the end of each position's row. Memory is some 8 bytes a word for each doubling of the longest repeat.
    """
    n = len(ids)
    at = np.arange(n)
    key = row * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, width, active = [rank], 1, order[~(new & np.append(new[1:], True))]
    while len(active):
        ahead = active + width
        inside = ahead < end[active]
        second = np.zeros(len(active), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[active] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        group = rank[active]
        here = np.arange(len(active))
        new = np.concatenate([[True], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), here, 0))
        rank = rank.copy()
        rank[active] = group + np.maximum.accumulate(np.where(new, here, 0)) - first
        active = active[~(new & np.append(new[1:], True))]
        width *= 2
        levels.append(rank)
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = at
    left, right = suffixes[:-1], suffixes[1:]
    known = min(len(levels) - 1, least.bit_length() - 1)
    close = levels[known][left] == levels[known][right]
    left, right = left[close], right[close]
    shared = np.zeros(len(left), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        a, b = left + shared, right + shared
        fits = (a < end[left]) & (b < end[right])
        fits[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        shared[fits] += 1 << k
    keep = shared >= least
    return left[keep], right[keep], shared[keep]


def kruskal_runs(ids, row, begin, left, right, shared, min_length: int, min_exponent: int):
    """(start, length, period) of the runs, starts as positions in ``ids``; edges as of ``suffix_edges``."""
    order = np.argsort(-shared, kind="stable")
    left, right, weight = left[order].tolist(), right[order].tolist(), shared[order].tolist()
    parent, sets, found, seeds = {}, {}, [], []

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for k, w in enumerate(weight):
        a, b = find(left[k]), find(right[k])
        one, two = sets.pop(a, None) or Positions(a), sets.pop(b, None) or Positions(b)
        if one.size < two.size:
            a, b, one, two = b, a, two, one
        moved = set(two)
        for x in two:
            before, after = one.add(x)
            if 0 <= before and x - before <= w and before not in moved:
                seeds.append((before, x))
            if after >= 0 and after - x <= w and after not in moved:
                seeds.append((x, after))
        parent[b], sets[a] = a, one
        if seeds and (k + 1 == len(weight) or weight[k + 1] != w):
            # All classes of this weight are whole: neighbours of before may have got another position in between.
            for i, j in seeds:
                p = j - i
                leftmost = i == begin[i] or ids[i - 1] != ids[j - 1]
                if leftmost and w + p >= max(min_length, min_exponent * p) and sets[find(i)].after(i) == j:
                    found.append((i, w + p, p))
            seeds = []
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def text_runs(data: np.ndarray, offsets: np.ndarray, min_length: int, min_exponent: int):
    """Words (starts, ends, row) of some texts and the runs among them, sorted by start and period."""
    starts, ends, row = bs.words(data, offsets)
    none = np.zeros((0, 3), np.int64)
    least = least_weight(min_length, min_exponent)
    n = len(starts) - least + 1
    if n < 2:
        return starts, ends, row, none
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    solid = data[~bs.is_space(data)]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(solid)])
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Texts with a window of ``least`` words that may occur twice; equal hashes only lead to a closer look.
    code = np.zeros(n, np.uint64)
    for k, p in enumerate(bs.powers(least, bs.WINDOW_BASE)):
        code += (ids[k:k + n].astype(np.uint64) + np.uint64(1)) * p
    inside = np.flatnonzero(row[:n] == row[least - 1:])
    maybe = np.zeros(len(offsets) - 1, bool)
    maybe[row[inside[bs.doubled(bs.mix(code[inside]) ^ bs.mix(row[inside] + 1))]]] = True
    place = np.flatnonzero(maybe[row])
    if not len(place):
        return starts, ends, row, none
    ids, rows = ids[place], row[place]
    cut = np.flatnonzero(np.diff(rows)) + 1
    edges = np.concatenate([[0], cut, [len(rows)]])
    size = np.diff(edges)
    begin, end = np.repeat(edges[:-1], size), np.repeat(edges[1:], size)
    runs = kruskal_runs(ids, rows, begin, *suffix_edges(ids, rows, end, least), min_length, min_exponent)
    runs = np.array(runs, np.int64).reshape(-1, 3)
    runs[:, 0] = place[runs[:, 0]]
    return starts, ends, row, runs


def _collapsed(data, starts, ends, row, n_rows, drop):
    """Kept words of each row joined by one space, as an Arrow string array."""
    keep = np.flatnonzero(~drop)
    starts, ends, row = starts[keep], ends[keep], row[keep]
    size = ends - starts
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    stop = np.cumsum(size + ~last)  # every word but the last of its row has a space behind it
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    move = np.concatenate([[0], stop[:-1]])[:len(size)]
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(move, size) + within] = data[np.repeat(starts, size) + within]
    bytes_of = np.bincount(row, weights=size + ~last, minlength=n_rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _run_columns(min_length: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            for first, data, offsets in bs.slices(batch.column("t")):
                n = len(offsets) - 1
                starts, ends, row, runs = text_runs(data, offsets, min_length, min_exponent)
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, runs[:, 0] + runs[:, 2], 1)
                np.add.at(step, runs[:, 0] + runs[:, 1], -1)
                of = row[runs[:, 0]]
                count = np.bincount(of, minlength=n)
                in_row = runs[:, 0] - np.searchsorted(row, of)
                structs = pa.StructArray.from_arrays(
                    [pa.array(in_row), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), structs)
                text = _collapsed(data, starts, ends, row, n, np.cumsum(step[:-1]) > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(first, n), pa.array(count.astype(np.int64)), lists, text],
                    ["doc", "n_runs", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, text="text", keep=(), min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row of ``docs``: doc (a struct of the columns ``keep``), n_runs, runs and collapsed.

    runs holds start (word number), length and period of every run of at least ``min_length`` words and
    ``min_exponent`` periods, sorted by start and period. collapsed is the text without the words that some run holds
    after its first period, joined by one space. Words are what blanks (space and \\t to \\r) part.

    ``min_exponent`` is a whole number of 2 or more. Null and empty texts have no runs and an empty collapsed text;
    repeated rows get equal results; no rows give no rows; columns may have any names. A very long text is worked on
    alone, in memory that grows with its words times the logarithm of its longest repeat.
    """
    if min_exponent < 2 or min_length < 1:
        raise ValueError("runs have two periods at least")
    t = F.coalesce(docs[f"`{text}`"] if isinstance(text, str) else text, F.lit(""))
    kept = [docs[f"`{c}`"] for c in keep] or [F.lit(0).alias("row")]
    rows = docs.select(F.struct(*kept).alias("doc"), t.alias("t"))
    schema = StructType([rows.schema["doc"], *StructType.fromDDL(RUNS).fields])
    return rows.mapInArrow(_run_columns(min_length, min_exponent), schema)


def strongest(runs):
    """The run with the greatest length / period, compared exactly; of equal ones the first. Null without runs."""
    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, empty, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
