"""Suffix-array dedup: remove every byte of a string of at least ``min_bytes`` that also starts anywhere else.

Every such window of bytes has an anchor: the half-length string in it with the smallest hash. Equal windows have equal
anchors at equal places, so only windows with a common anchor need to meet. Neighbouring windows with one anchor are a
piece; a piece is a few hundred bytes whatever the text. What moves between tasks are hashes of anchors and pieces;
pieces whose anchor is nowhere else go at once, equal pieces become one with a count (so copies of whole texts cost
nothing), and the bytes of one piece of each kind are brought together where an anchor has several kinds.

There the suffix array of the anchor's pieces (suffix_groups) shows which windows stand twice: they are neighbours in
the array, and their bytes are compared. What all pieces of an anchor share around it is one symbol of the array.
An anchor with many kinds is dealt in blocks; windows of such anchors that a block doesn't settle are settled by
digests over all blocks.
"""

from __future__ import annotations

import hashlib
import os.path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import bytesets as bs
from .common import numbered, shuffle_parts
from .suffix_groups import suffix_array

MIN_BYTES = 400
BLOCK_PIECES = 48
# Windows of a text that are looked at together.
STRETCH = 1 << 19
# Lists of pieces or removed spans up to this many entries (some 40 bytes each) are broadcast.
MAX_BROADCAST_ENTRIES = 500_000


def pieces_of(data: np.ndarray, width: int):
    """First window, number of windows, place of the anchor from the first window, and anchor hash of each piece."""
    gram = width // 2
    reach = width - gram + 1
    hashed = bs.hashes(data, np.arange(len(data) - gram + 1), np.arange(gram, len(data) + 1))
    n = len(hashed) - reach + 1
    key = (hashed & ~np.uint64((1 << 20) - 1)) | np.arange(len(hashed), dtype=np.uint64)
    key = np.concatenate([key, np.full(-len(key) % reach, 2**64 - 1, np.uint64)]).reshape(-1, reach)
    left = np.minimum.accumulate(key, 1).ravel()[reach - 1:reach - 1 + n]
    right = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()[:n]
    anchor = (np.minimum(left, right) & np.uint64((1 << 20) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return first, np.diff(np.append(first, n)), anchor[first] - first, hashed[anchor[first]]


_PIECE = "rf bigint, ri bigint, lo bigint, windows int, anchor int, h bigint, p bigint"


def _pieces(width: int):
    def run(batches):
        for batch in batches:
            rf, ri = np.asarray(batch.column("rf")), np.asarray(batch.column("ri"))
            for i, text in enumerate(batch.column("t")):
                text = memoryview(text.as_buffer())
                for at in range(0, len(text) - width + 1, STRETCH):
                    part = text[at:at + STRETCH + width - 1]
                    lo, windows, anchor, h = pieces_of(np.frombuffer(part, np.uint8), width)
                    p = [xxhash.xxh3_64_intdigest(part[a:a + n + width - 1]) for a, n in zip(lo.tolist(), windows.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(lo), rf[i])), pa.array(np.full(len(lo), ri[i])), pa.array(lo + at),
                         pa.array(windows.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(h.view(np.int64)),
                         pa.array(np.array(p, np.uint64).view(np.int64))],
                        [c.split()[0] for c in _PIECE.split(", ")])

    return run


_CONTENT = "h bigint, p bigint, copies bigint, kinds bigint, block int, anchor int, body binary"


def _contents(width: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, want in zip(batch.column("t"), batch.column("want").to_pylist()):
                text = memoryview(text.as_buffer())
                for w in want:
                    blocks = -(-w["kinds"] // BLOCK_PIECES)
                    out.append((w["h"], w["p"], w["copies"], w["kinds"], w["p"] % blocks, w["anchor"], bytes(text[w["lo"]:w["lo"] + w["windows"] + width - 1])))
                if len(out) > 4000:
                    yield _rows(out, _CONTENT)
                    out = []
            if out:
                yield _rows(out, _CONTENT)

    return run


_KIND = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}


def _rows(rows: list[tuple], schema: str):
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(v, _KIND[k]) for v, k in zip(zip(*rows), kinds)], list(names))


def _common(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def repeated_windows(bodies: list[bytes], anchors: list[int], gram: int, width: int) -> list[list[tuple[int, int]]]:
    """Of pieces with one anchor (at ``anchors``, ``gram`` bytes long), all different: the ranges of windows of each
    that also stand in another one or elsewhere in it, from their suffix array."""
    lead, trail = [b[:a][::-1] for b, a in zip(bodies, anchors)], [b[a + gram:] for b, a in zip(bodies, anchors)]
    left, right = len(os.path.commonprefix(lead)), len(os.path.commonprefix(trail))
    # Symbols: 0 end, 1 between pieces, 2 what all share around the anchor, then bytes.
    text: list[int] = []
    where: list[tuple[int, int]] = []  # piece and window of each symbol; -1 at the shared part, -2 behind it
    for i, (x, y) in enumerate(zip(lead, trail)):
        before, after = x[left:][::-1], y[right:]
        if len(bodies) == 2:  # they differ right beside the shared part
            before, after = before[-1:], after[:1]
        skip = len(x) - left - len(before)
        text += [c + 3 for c in before] + [2] + [c + 3 for c in after] + [1]
        where += [(i, skip + k) for k in range(len(before))] + [(i, -1)] + [(i, -2)] * (len(after) + 1)
    text.append(0)
    where.append((0, -2))
    order = suffix_array(text)
    reach = [0] * len(bodies)  # bytes from the anchor on that another piece has as well
    found: list[set[int]] = [set() for _ in bodies]
    for a, b in zip(order, order[1:]):
        (i, s), (j, t) = where[a], where[b]
        if s == t == -1:
            n = gram + right + _common(trail[i][right:], trail[j][right:])
            reach[i], reach[j] = max(reach[i], n), max(reach[j], n)
        elif s >= 0 and t >= 0 and bodies[i][s:s + width] == bodies[j][t:t + width] and min(len(bodies[i]) - s, len(bodies[j]) - t) >= width:
            found[i].add(s)
            found[j].add(t)
    out = []
    for i, (body, anchor) in enumerate(zip(bodies, anchors)):
        first, last = max(0, anchor - left), min(anchor + reach[i] - width, len(body) - width, anchor)
        ranges = [(first, last + 1)] if last >= first else []
        ranges += [(s, s + 1) for s in sorted(found[i]) if s <= len(body) - width]
        out.append(ranges)
    return out


_FOUND = "h bigint, p bigint, s int, e int, w binary"


def _groups(width: int):
    gram = width // 2

    def settle(rows):
        """Anchors of one hash may differ: only pieces with the same bytes there have it in common."""
        same = {}
        for r in rows:
            same.setdefault(r["body"][r["anchor"]:r["anchor"] + gram], []).append(r)
        for group in same.values():
            yield from settle_anchor(group)

    def settle_anchor(rows):
        bodies = [r["body"] for r in rows]
        ranges = repeated_windows(bodies, [r["anchor"] for r in rows], gram, width) if len(rows) > 1 else [[] for _ in rows]
        for r, found in zip(rows, ranges):
            if r["copies"] == 1:
                yield from ((r["h"], r["p"], s, e, None) for s, e in found)
        if rows[0]["kinds"] > BLOCK_PIECES:
            seen = set()
            for r, found in zip(rows, ranges):
                settled = {s for a, b in found for s in range(a, b)}
                for s in range(len(r["body"]) - width + 1):
                    digest = xxhash.xxh3_128_digest(r["body"][s:s + width])
                    if r["copies"] == 1 and s not in settled:
                        yield r["h"], r["p"], s, s + 1, digest
                    elif digest not in seen:
                        seen.add(digest)
                        yield r["h"], r["p"], -1, -1, digest

    def run(batches):
        """Rows come sorted by anchor and block."""
        rows, out = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if rows and (rows[0]["h"], rows[0]["block"]) != (r["h"], r["block"]):
                    out += settle(rows)
                    rows = []
                rows.append(r)
                if len(out) > 20_000:
                    yield _rows(out, _FOUND)
                    out = []
        if rows:
            out += settle(rows)
        if out:
            yield _rows(out, _FOUND)

    return run


def _merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["b"], s["e"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<b:bigint,e:bigint>>, kept binary"


def _removed(with_kept: bool):
    kind = pa.list_(pa.struct([("b", pa.int64()), ("e", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, spans in zip(batch.column("id").to_pylist(), batch.column("t"), batch.column("spans").to_pylist()):
                text = memoryview(text.as_buffer())
                merged, at, digest, kept = _merged(spans), 0, hashlib.sha256(), []
                for b, e in [*merged, (len(text), len(text))]:
                    digest.update(text[at:b])
                    if with_kept:
                        kept.append(bytes(text[at:b]))
                    at = e
                out.append((doc, len(text), sum(e - b for b, e in merged), len(merged), digest.hexdigest(),
                            [{"b": b, "e": e} for b, e in merged], b"".join(kept) if with_kept else None))
            if out:
                doc, n, removed, count, sha, spans, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                     pa.array(sha, pa.string()), pa.array(spans, kind), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, min_bytes: int = MIN_BYTES, text: Column | None = None, doc_id: Column | None = None,
    with_kept: bool = False, from_files: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges), kept (the rest, if asked).

    A null text is empty. Strings never cross rows and are judged on the input. Repeated rows are copies of each
    other, whatever their ids; null ids are rows like others. A long text is cut into stretches of windows. No rows
    give no rows. Other columns are not read.
    """
    if not 16 <= min_bytes <= STRETCH:
        raise ValueError(f"min_bytes must be from 16 to {STRETCH}")
    spark, width = docs.sparkSession, min_bytes
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"),
        "t": F.coalesce((F.col("text") if text is None else text).cast("binary"), F.lit(b"")),
    }, from_files, "repeats-rows")
    pieces = stage(rows.filter(F.octet_length("t") >= width).select("rf", "ri", "t").mapInArrow(_pieces(width), _PIECE), "repeats-pieces")
    # Written first, so that the join's two sides are dealt for the join alone and a large anchor can be split.
    repeated = stage(pieces.groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "repeats-anchors")
    known = stage(pieces.join(repeated, "h"), "repeats-known")
    # Any row of a kind will do for its bytes, as they are equal.
    kinds = stage(known.groupBy("h", "p").agg(
        F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("rf", "ri", "lo", "windows", "anchor")]), "repeats-kinds")
    several = stage(kinds.groupBy("h").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "repeats-several")
    need = stage(kinds.join(several, "h"), "repeats-need")
    wanted = need.groupBy("rf", "ri").agg(F.collect_list(F.struct("h", "p", "copies", "kinds", "lo", "windows", "anchor")).alias("want"))
    wanted = F.broadcast(wanted) if need.count() <= MAX_BROADCAST_ENTRIES else wanted
    contents = rows.join(wanted, ["rf", "ri"]).select("t", "want").mapInArrow(_contents(width), _CONTENT)
    found = stage(
        contents.repartition(4 * shuffle_parts(spark), "h", "block").sortWithinPartitions("h", "block", "p").mapInArrow(_groups(width), _FOUND),
        "repeats-found")
    digests = found.filter("w is not null")
    twice = digests.groupBy("w").agg(F.count("*").alias("c")).filter("c > 1").select("w")
    settled = (
        found.filter("w is null").select("h", "p", "s", "e")
        .union(digests.filter("s >= 0").join(twice, "w").select("h", "p", "s", "e"))
        .union(kinds.filter("copies > 1").select("h", "p", F.lit(0), "windows"))
    )
    spans = known.join(settled, ["h", "p"]).select(
        "rf", "ri", (F.col("lo") + F.col("s")).alias("b"), (F.col("lo") + F.col("e") - 1 + width).alias("e"))
    per_row = stage(spans.groupBy("rf", "ri").agg(F.collect_list(F.struct("b", "e")).alias("spans")), "repeats-spans")
    entries = per_row.agg(F.sum(F.size("spans"))).first()[0] or 0
    per_row = F.broadcast(per_row) if entries <= MAX_BROADCAST_ENTRIES else per_row
    return rows.join(per_row, ["rf", "ri"], "left").select("id", "t", "spans").mapInArrow(_removed(with_kept), _RESULT)
