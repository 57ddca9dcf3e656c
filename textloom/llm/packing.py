"""Packing token sequences by cutting-stock column generation.

Every document is cut at each full sequence; the tail that is left is one piece. The tails' lengths make a histogram
(at most one entry for each length below the sequence length, whatever the input), from which the driver solves the
cutting-stock program. The patterns it chooses are dealt to documents by their rank among those of equal length. Ranks
come from counts of bounded parts and a row number inside each part, so a length that a third of all documents share
is numbered by all tasks. Tails without a pattern are poured: laid end to end in rank order and cut where a sequence
ends. A piece's place follows from its length and rank alone, by a search in tables of a few thousand entries.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from . import cutting_stock
from .common import numbered, running_before, shuffle_parts

SEQUENCE = 1024
END_ID = 0
PART_ROWS = 200_000


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """Text to ids. The ranks file, if given, holds the same vocabulary for a faster library; texts that it might cut
    otherwise (beyond Latin-1, or with the special token's string) go to the tokenizer of the JSON file."""
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    if ranks_path is None:
        return lambda text: slow.encode(text, add_special_tokens=False).ids
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return slow.encode(text, add_special_tokens=False).ids
        if "<|" in text:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def public_tokenizer() -> tuple[str, str, str]:
    """Paths of the public byte-level vocabulary, as installed on every machine, and its word pattern."""
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


def _tokens(tokenizer, sequence: int):
    def run(batches):
        encode = _encoder(*tokenizer)
        for batch in batches:
            n, crcs, tails = [], [], []
            for text in batch.column("t"):
                ids = np.array([*encode(text.as_py()), END_ID], "<u4")
                n.append(len(ids))
                crcs.append([zlib.crc32(ids[i:i + sequence].tobytes()) for i in range(0, len(ids), sequence)])
                tails.append(ids[len(ids) // sequence * sequence:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("rf"), batch.column("ri"), pa.array(n, pa.int64()),
                 pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())],
                ["id", "rf", "ri", "n", "crcs", "tail"])

    return run


class Places:
    """Where the piece of a length and rank goes: tables of segments of ranks."""

    def __init__(self, histogram: dict[int, int], sequence: int):
        patterns, left = cutting_stock.plan(histogram, sequence)
        rows, taken, self.bins = [], dict.fromkeys(histogram, 0), 0
        for counts, times in patterns:
            offset = 0
            for n, count in counts.items():
                # length, first rank, first sequence, pieces a sequence, first offset
                rows.append((n, taken[n], self.bins, count, offset))
                taken[n] += count * times
                offset += n * count
            self.bins += times
        self.poured = 0
        self.pour_first = np.full(sequence + 1, -1, np.int64)  # first rank of a length that is poured
        self.pour_at = np.zeros(sequence + 1, np.int64)  # and its place on the line
        for n in sorted(left, reverse=True):
            self.pour_first[n], self.pour_at[n] = taken[n], self.poured
            self.poured += n * left[n]
        rows.sort()
        self.length, self.first, self.bin, self.count, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.sequence = sequence

    def full_from(self) -> int:
        """The first number of sequences that one document fills."""
        return self.bins + -(-self.poured // self.sequence)

    def of(self, n: np.ndarray, rank: np.ndarray):
        """(poured?, sequence and offset, or the place on the line)."""
        poured = (self.pour_first[n] >= 0) & (rank >= self.pour_first[n])
        line = self.pour_at[n] + (rank - self.pour_first[n]) * n
        lo = np.searchsorted(self.length, n, "left")
        at = lo.copy()
        for i in np.flatnonzero(~poured):
            hi = np.searchsorted(self.length, n[i], "right")
            at[i] = lo[i] + np.searchsorted(self.first[lo[i]:hi], rank[i], "right") - 1
        at = np.where(poured, 0, at)
        if not len(self.length):
            return poured, line, line
        k = rank - self.first[at]
        seq = self.bin[at] + k // self.count[at]
        return poured, np.where(poured, line, seq), self.offset[at] + k % self.count[at] * n


_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _pieces(places: Places, crc_of_tails: bool):
    sequence, full_from = places.sequence, places.full_from()

    def run(batches):
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            n, rank, before = (np.asarray(col[c]) for c in ("n", "rank", "before"))
            tail = n % sequence
            poured, place, offset = places.of(tail, rank)
            out = [[] for _ in range(7)]

            def add(*values):
                for o, v in zip(out, values):
                    o.append(v)

            for i, (doc, crcs) in enumerate(zip(col["id"].to_pylist(), col["crcs"].to_pylist())):
                total = int(n[i])
                if not crc_of_tails:
                    for k in range(total // sequence):
                        add(doc, k * sequence, sequence, crcs[k], total, full_from + int(before[i]) + k, 0)
                    if tail[i] and not poured[i]:
                        add(doc, total - int(tail[i]), int(tail[i]), crcs[-1], total, int(place[i]), int(offset[i]))
                elif tail[i] and poured[i]:
                    ids, at, start = col["tail"][i].as_py(), int(place[i]), 0
                    while start < tail[i]:
                        size = min(sequence - at % sequence, int(tail[i]) - start)
                        add(doc, total - int(tail[i]) + start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), total,
                            places.bins + at // sequence, at % sequence)
                        at, start = at + size, start + size
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], [c.split()[0] for c in _PIECE.split(", ")])

    return run


def pack(
    docs: DataFrame, tokenizer=None, sequence: int = SEQUENCE, text: Column | None = None, doc_id: Column | None = None,
    from_files: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document (null text: empty) is tokenized whole and gets an end id, so it has at least one token. Every id is
    in one piece; sequences are filled from offset 0 without gaps and hold at most ``sequence`` ids. Repeated rows and
    null ids are documents like others. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizer()
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"),
        "t": F.coalesce(F.col("text") if text is None else text, F.lit("")),
    }, from_files, "pack-rows")
    tokens = stage(rows.mapInArrow(
        _tokens(tokenizer, sequence), "id bigint, rf bigint, ri bigint, n bigint, crcs array<bigint>, tail binary"), "pack-tokens")
    tail = F.col("n") % sequence
    sizes = {r["tail"]: r["count"] for r in tokens.groupBy(tail.alias("tail")).count().collect()}  # a row for each length
    places = Places({n: c for n, c in sizes.items() if n}, sequence)
    parts = max(4 * shuffle_parts(spark), sum(sizes.values()) // PART_ROWS)
    narrow = tokens.select(
        "id", "rf", "ri", "n", "crcs", tail.alias("len"), F.pmod(F.xxhash64("rf", "ri"), F.lit(parts)).cast("int").alias("part"))
    counts = narrow.groupBy("part", "len").agg(F.count("*").alias("c"), F.sum(F.floor(F.col("n") / sequence)).alias("q"))
    counts = stage(counts, "pack-counts")
    by_len = running_before(counts, ["len"], "part", "c", "len_before").select("part", "len", "len_before")
    by_part = counts.groupBy("part").agg(F.sum("q").alias("q"))  # as many rows as parts
    by_part = running_before(by_part, [], "part", "q", "full_before").select("part", "full_before")
    inside = Window.partitionBy("part").orderBy("rf", "ri")
    ranked = (
        narrow.withColumn("in_part", F.coalesce(
            F.sum(F.floor(F.col("n") / sequence)).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("in_len", F.row_number().over(Window.partitionBy("part", "len").orderBy("rf", "ri")) - 1)
        .join(by_part, "part").join(by_len, ["part", "len"])
        .select("id", "rf", "ri", "n", "crcs", (F.col("len_before") + F.col("in_len")).cast("bigint").alias("rank"),
                (F.col("full_before") + F.col("in_part")).cast("bigint").alias("before"))
    )
    ranked = stage(ranked, "pack-ranks")
    whole = ranked.mapInArrow(_pieces(places, False), _PIECE)
    # Tails that are cut need their ids once more. Ranks rise with the part, so of each length only the tails of some
    # last parts can be among them, and only these are moved.
    first = {int(n): int(places.pour_first[n]) for n in np.flatnonzero(places.pour_first >= 0)}
    if not first:
        return whole
    rank_from = F.create_map(*[F.lit(x) for item in first.items() for x in item])
    part_from = {
        r["len"]: r["part"] for r in
        by_len.filter(F.col("len_before") <= rank_from[F.col("len").cast("int")]).groupBy("len").agg(F.max("part").alias("part")).collect()
    }  # a row for each length
    part_of = F.create_map(*[F.lit(x) for item in part_from.items() for x in (int(item[0]), int(item[1]))])
    part = F.pmod(F.xxhash64("rf", "ri"), F.lit(parts))
    tails = tokens.filter(part >= part_of[tail.cast("int")]).select("rf", "ri", "tail")
    cut = ranked.filter(F.col("rank") >= rank_from[tail.cast("int")]).join(tails, ["rf", "ri"])
    return whole.unionByName(cut.mapInArrow(_pieces(places, True), _PIECE))
