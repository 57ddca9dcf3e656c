"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints have 64 bits, cut into segments of 23, 23 and 18 bits. Of at most three differing bits, two segments get
at most one each, so two near fingerprints agree in the codeword indices of one of three pairs of segments, if one of
them gives its nearest codewords and the other all codewords within reach (golay.keys). Each distinct fingerprint is
therefore stored under three keys and asks under up to 108. All that meets at a key is compared by bit distance there.

Equal fingerprints are one row from the start, so exact copies cost nothing. Rows of a key are never paired in a
join: a task walks through the sorted rows of its keys, takes a fingerprint, compares it with the rest of the key,
links what is near and goes on from there, so a dense group of n costs one pass and n - 1 links, not n * n / 2. Links
of distinct fingerprints then become components by alternating rounds of smallest-neighbour joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from . import golay
from .common import ascii_lower, numbered, shuffle_parts

SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
SEED = 42
MAX_DISTANCE = 3


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begin = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(begin)
    stop = (ends[shingle - 1:] - 1).tolist()
    for at in range(0, n, 1 << 16):
        h = np.array([digest(flat[a:b], SEED) for a, b in zip(begin[at:at + (1 << 16)], stop[at:at + (1 << 16)])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("t")
            f = [fingerprint(t, shingle) for t in batch.column(at).to_pylist()]
            signed = np.array(f, np.uint64).view(np.int64)
            yield batch.set_column(at, "fp", pa.array(signed))

    return run


def _keyed(batches):
    """Each fingerprint under its keys: side 0 is stored, side 1 asks."""
    for batch in batches:
        whole = np.asarray(batch.column("fp")).view(np.uint64)
        for first in range(0, len(whole), 4096):
            fp = whole[first:first + 4096]
            segment = [golay.keys(((fp >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
            for p, (a, b) in enumerate(PAIRS):
                (ka, na), (kb, nb) = segment[a], segment[b]
                for i in range(6):
                    for j in range(6):
                        some = np.flatnonzero((na > i) & (nb > j))
                        key = ((p << 24) | (ka[some, i] << 12) | kb[some, j]).astype(np.int32)
                        f = pa.array(fp[some].view(np.int64))
                        if i == j == 0:
                            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(len(some), np.int8)), f], ["key", "side", "fp"])
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.ones(len(some), np.int8)), f], ["key", "side", "fp"])


def _near(one, many, distance):
    return np.bitwise_count(many ^ one) <= distance


def spanning_links(stored: np.ndarray, asking: np.ndarray, distance: int):
    """Links that join what lies within ``distance``, at most one for each row: rows that are reached are not asked again.

    ``stored`` and ``asking`` are two sides of a key; a fingerprint may be on both. Only pairs of a stored and another
    row count, and every such pair ends in one connected piece.
    """
    nodes = np.unique(np.concatenate([stored, asking]))
    is_stored = np.isin(nodes, stored, assume_unique=True)
    left = np.arange(len(nodes))
    links_a, links_b = [], []
    for root in np.flatnonzero(is_stored):
        front = [root]
        left = left[left != root] if len(left) and (left == root).any() else left
        while front:
            at = front.pop()
            if not len(left):
                break
            # A pair counts if one of the two is stored.
            hit = _near(nodes[at], nodes[left], distance)
            if not is_stored[at]:
                hit &= is_stored[left]
            if hit.any():
                got = left[hit]
                links_a.append(np.full(len(got), nodes[at]))
                links_b.append(nodes[got])
                front.extend(got.tolist())
                left = left[~hit]
    if not links_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(links_a), np.concatenate(links_b)


def _links(distance: int):
    def group(parts):
        fp = np.concatenate([p[1] for p in parts]).view(np.uint64)
        side = np.concatenate([p[0] for p in parts])
        return spanning_links(fp[side == 0], fp[side == 1], distance)

    def run(batches):
        """Rows come sorted by key, those of a key together."""
        open_key, parts = None, []
        for batch in batches:
            key, side, fp = (np.asarray(batch.column(c)) for c in ("key", "side", "fp"))
            if not len(key):
                continue
            edges = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            out_a, out_b = [], []
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if key[s] != open_key:
                    if sum(map(len, (p[0] for p in parts))) > 1:
                        a, b = group(parts)
                        out_a.append(a)
                        out_b.append(b)
                    open_key, parts = key[s], []
                if e - s > 1 or e == len(key) or s == 0:
                    parts.append((side[s:e].copy(), fp[s:e].copy()))
            if out_a:
                yield _pairs(np.concatenate(out_a), np.concatenate(out_b))
        if sum(map(len, (p[0] for p in parts))) > 1:
            yield _pairs(*group(parts))

    return run


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (np.minimum(a.view(np.int64), b.view(np.int64)), np.maximum(a.view(np.int64), b.view(np.int64)))], ["a", "b"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (smallest node of its component) for every node of ``links``, by alternating stars.

    Each round is written to the shared folder. Nodes of a link are never gathered; only minima are, so a node with
    very many links costs partial minima alone. Rounds end when a round changes nothing.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    while True:
        # Large star: larger neighbours go to the smallest one, the node itself included.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        after = stage(small, "links")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        before = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        edges = after
        if same == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(
    docs: DataFrame, shingle: int = 3, max_distance: int = MAX_DISTANCE, text: Column | None = None,
    doc_id: Column | None = None, from_files: bool = False,
) -> DataFrame:
    """Per row of ``docs``: rf, ri (its identity), doc_id, fp (bigint), component_id, root (a fingerprint that names
    the component).

    Words are runs without blanks, A-Z lower-cased; a text of fewer words than a shingle is one shingle, and one
    without words (null, empty) has fingerprint zero, which links like any other. component_id is the smallest doc_id
    that links reach; null ids count last, so it is null only where no row of the component has an id. Repeated rows
    share a component. Up to three bits of distance are supported. No rows give no rows. Other columns are not read.
    """
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError("max_distance must be from 0 to 3")
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"),
        "t": ascii_lower(F.col("text") if text is None else text).cast("binary"),
    }, from_files, "simhash-rows")
    rows = stage(rows.mapInArrow(_fingerprints(shingle), "id bigint, fp bigint, rf bigint, ri bigint"), "simhash-fingerprints")
    parts = 4 * shuffle_parts(docs.sparkSession)
    distinct = stage(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    links = (
        distinct.select("fp").mapInArrow(_keyed, "key int, side byte, fp bigint")
        .repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_links(max_distance), "a bigint, b bigint")
    )
    found = components(links)
    by_root = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")
    by_root = stage(by_root, "simhash-roots")
    lowest = by_root.groupBy("root").agg(F.min("low").alias("component_id"))
    # Only fingerprints that are linked or shared need another row's id; a fingerprint holds few rows of a salt.
    answer = by_root.join(lowest, "root").select("fp", "root", "component_id")
    salt = F.pmod(F.xxhash64("rf", "ri"), F.lit(64)).cast("int")
    salted = rows.withColumn("salt", salt)
    spread = salted.select("fp", "salt").distinct().join(answer, "fp")
    return salted.join(spread, ["fp", "salt"]).select("rf", "ri", F.col("id").alias("doc_id"), "fp", "component_id", "root")
