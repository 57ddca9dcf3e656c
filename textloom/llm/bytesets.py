"""Texts of an Arrow batch as flat byte arrays: words, lines and their hashes without a loop over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# So many bytes of text are worked on at once (a longer text alone); arrays take some tens of bytes for each.
SLICE_BYTES = 1 << 20
# Odd bases of polynomial hashes modulo 2**64; any odd numbers will do.
BASE, WINDOW_BASE = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(n, np.uint64)
    out[1:] = base % 2**64
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal pieces have equal hashes, and some other pieces as well."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data), BASE), out=total[1:])
    inverse = pow(BASE, -1, 2**64)
    return mix((total[ends] - total[starts]) * powers(len(data) + 1, inverse)[starts])


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of the pieces data[start:end], which are in order and apart: equal just for equal pieces."""
    step = np.zeros(len(data) + 1, np.int8)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    solid = data[np.cumsum(step[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(solid)])
    return pieces.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def repeated(ids: np.ndarray, rows: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
    """Those of the ``places`` whose ``width`` ids also stand at another place of the same row."""
    code = np.zeros(len(places), np.uint64)
    for k, p in enumerate(powers(width, WINDOW_BASE)):
        code += (ids[places + k].astype(np.uint64) + np.uint64(1)) * p
    places = places[doubled(mix(code) ^ mix(rows[places] + 1))]
    # Equal codes may belong to different ids: number the windows step by step.
    number = rows[places]
    for k in range(width):
        number = np.unique(number * (int(ids.max(initial=0)) + 1) + ids[places + k], return_inverse=True)[1]
    return places[doubled(number)]


def slices(column: pa.Array):
    """(first row, byte array, row offsets) of parts of a string or binary column without nulls."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        yield first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def words(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and row of the words (runs without blanks, which end with their row)."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~is_space(data)
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = offsets[1:-1]
    cut = inner[(solid[inner] == 1) & (solid[np.minimum(inner + 1, len(data) + 1)] == 1)]  # rows that touch
    if len(cut):
        cut = np.unique(cut)
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lines(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and row of the lines; an empty row has none."""
    newline = np.flatnonzero(data == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.concatenate([offsets[full], newline + 1])
    ends = np.concatenate([newline, offsets[full + 1]])
    starts.sort()
    ends.sort()
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1  # right for lines that hold anything


def doubled(codes: np.ndarray) -> np.ndarray:
    """Which codes occur more than once."""
    if not len(codes):
        return np.zeros(0, bool)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(len(codes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice


def later(codes: np.ndarray) -> np.ndarray:
    """Which codes are equal to an earlier one."""
    order = np.argsort(codes, kind="stable")
    out = np.zeros(len(codes), bool)
    if len(codes):
        out[order[1:][codes[order[1:]] == codes[order[:-1]]]] = True
    return out
