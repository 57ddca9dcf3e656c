"""Token ids by a vocabulary of any size: pieces of texts as a table, each looked up or merged once.

Texts are cut into pieces by a pattern. The distinct pieces are a table with their counts; byte-pair merges run once
for each of them, not for each occurrence. The ids then go back to the texts: the whole table travels to the tasks when
its counted size allows, else the pieces that are frequent enough for their number to be bounded, and a task puts the
ids of a text together where the text lies. Only the occurrences of all other pieces, none of which is hot, are shuffled
and joined, with the stretches of ids between them.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, stage

# Fixed value: a word with the space before it, or white space of ASCII.
PIECES = r" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
# A vocabulary is held by every Python worker.
MAX_VOCABULARY = 2_000_000
# Pieces are words, mostly short; so many with their ids stay below some 100 MB once hashed.
MAX_BROADCAST_PIECES = 500_000
# A task looks up so many pieces at once.
PORTION_PIECES = 1_000_000
# Pieces up to so many bytes are merged by a plain search for the lowest rank.
SHORT_PIECE = 48


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``token`` (bytes) and ``id`` of a rank file: a token in Base64 and its rank on each line."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0)
    return rows.select(F.unbase64(parts[0]).alias("token"), parts[1].cast("int").alias("id"))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: of all neighbours whose join is a token the lowest rank is merged, the leftmost of equal ones.

    A piece that is a token is that token. Neighbours wait in a heap, so a long piece takes n log n steps.
    """
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) <= SHORT_PIECE:
        return _merge_short(piece, ranks)
    parts = [piece[i:i + 1] for i in range(len(piece))]
    before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = []

    def offer(left: int) -> None:
        right = after[left]
        if right < len(parts) and (rank := ranks.get(parts[left] + parts[right])) is not None:
            heapq.heappush(heap, (rank, left, right, len(parts[left]), len(parts[right])))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, left, right, n, m = heapq.heappop(heap)
        if len(parts[left]) != n or after[left] != right or len(parts[right]) != m:
            continue  # one of the two was merged meanwhile
        parts[left] += parts[right]
        parts[right] = b""
        after[left] = after[right]
        if after[left] < len(parts):
            before[after[left]] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return _ids_of([p for p in parts if p], ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """As ``merge``, in steps that grow with the square of the length."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    never = float("inf")
    joins = [ranks.get(piece[i:i + 2], never) for i in range(len(piece) - 1)]
    while joins and (lowest := min(joins)) != never:
        i = joins.index(lowest)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i < len(joins):
            joins[i] = ranks.get(parts[i] + parts[i + 1], never)
        if i:
            joins[i - 1] = ranks.get(parts[i - 1] + parts[i], never)
    return _ids_of(parts, ranks)


def _ids_of(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    unknown = [p for p in parts if p not in ranks]
    if unknown:
        raise ValueError(f"not in the vocabulary: {unknown[0]!r}")
    return [ranks[p] for p in parts]


def _merged(shared):
    def run(batches):
        ranks = shared.value
        for batch in batches:
            pieces = batch.column("piece")
            ids = [merge(p.encode(), ranks) for p in pieces.to_pylist()]
            yield pa.RecordBatch.from_arrays([pieces, batch.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["piece", "n", "ids"])

    return run


def merge_pieces(pieces: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``ids`` to a table of distinct pieces (``piece``, ``n``) by a vocabulary (``token``, ``id``)."""
    if vocabulary.count() > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} tokens")
    ranks = {bytes(r["token"]): r["id"] for r in vocabulary.select("token", "id").collect()}
    shared = pieces.sparkSession.sparkContext.broadcast(ranks)
    return pieces.mapInArrow(_merged(shared), "piece string, n bigint, ids array<int>")


def occurrences(texts: DataFrame, found, keep: tuple[str, ...]) -> DataFrame:
    """A row per piece: the columns ``keep``, ``pos`` and ``piece``; a text without any has one row of nulls."""
    return texts.select(*keep, F.posexplode_outer(found).alias("pos", "piece"))


def piece_table(places: DataFrame) -> DataFrame:
    """Distinct pieces and how often each occurs."""
    return places.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def _in_place(shared, keep: tuple[str, ...], rest: bool, missing: int | None):
    """The ids of texts by a table that travels: with ``rest`` a row for each stretch of its pieces and for each other
    piece, with their place in the text, else a row for each text, in which other pieces give the id ``missing``."""
    def cut(texts: pa.RecordBatch):
        words, ids, sizes = shared.value
        n = pc.fill_null(pc.list_value_length(texts.column("pieces")), 0).to_numpy().astype(np.int64)
        pieces = texts.column("pieces").flatten()
        at = pc.fill_null(pc.index_in(pieces, value_set=words), -1).to_numpy().astype(np.int64)
        own = at < 0
        first = np.cumsum(n) - n  # of each text
        many = np.where(own, 0 if rest or missing is None else 1, np.append(sizes, 0)[at])
        behind = np.concatenate([[0], np.cumsum(many)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values = np.repeat(ends[at] - behind[:-1], many) + np.arange(behind[-1])
        values = np.append(ids, -1 if missing is None else missing)[np.where(np.repeat(own, many), len(ids), values)]
        begins = np.zeros(len(pieces) + 1, bool)
        if rest:
            begins[:-1] |= own
            begins[1:] |= own
        begins[-1] = False
        begins[first[n > 0]] = True
        starts = np.flatnonzero(begins)
        text = np.searchsorted(first + n, starts, side="right")
        starts = np.concatenate([starts, first[n == 0]])  # a text without pieces is one row
        text = np.concatenate([text, np.flatnonzero(n == 0)])
        order = np.argsort(text, kind="stable")
        starts, text = starts[order], text[order]
        lists = pa.ListArray.from_arrays(pa.array(np.append(behind[starts], behind[-1]), pa.int32()), pa.array(values, pa.int32()))
        columns = [texts.column(k).take(pa.array(text)) for k in keep]
        if not rest:
            return pa.RecordBatch.from_arrays([*columns, lists], [*keep, "input_ids"])
        place = np.where(n[text] > 0, starts - first[text], 0)
        alone = np.zeros(len(starts), bool)
        alone[n[text] > 0] = own[starts[n[text] > 0]]
        piece = pieces.take(pa.array(starts, mask=~alone))
        whole = (np.bincount(text, minlength=len(n)) == 1)[text] & ~alone
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(place, pa.int32()), piece, lists, pa.array(whole)], [*keep, "pos", "piece", "ids", "whole"])

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("pieces")), 0).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PORTION_PIECES, side="right")))
                yield cut(batch.slice(lo, hi - lo))
                lo = hi

    return run


def _least_count(table: DataFrame, most: int) -> int:
    """The lowest count that at most ``most`` pieces reach, in steps of an eighth of an octave."""
    step = F.floor(F.log2("n") * 8).cast("int")
    total, least = 0, (1 << 63) - 1
    for r in table.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("pieces"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():  # some hundred rows
        total += r["pieces"]
        if total > most:
            break
        least = r["n"]
    return least


def _same(a: DataFrame, b: DataFrame, keep: tuple[str, ...]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keep])


def piece_ids(
    texts: DataFrame, found: Column, table: DataFrame, keep: tuple[str, ...], seq_len: int | None = None, missing: int | None = None,
) -> DataFrame:
    """``input_ids`` of every text with the pieces ``found``, from a staged table (``piece``, ``ids``).

    Pieces that the table lacks give the id ``missing``, or none. Of a table of more than ``MAX_BROADCAST_PIECES`` pieces,
    which has their count ``n``, the most frequent ones travel, so none of the others is hot. Texts that ``keep`` does not tell apart are one, with their pieces in turn; they are
    put together from their occurrences.
    """
    spark = texts.sparkSession
    rest = table.count() > MAX_BROADCAST_PIECES
    frequent, rare = table, None
    if rest:
        often = F.col("n") >= _least_count(table, MAX_BROADCAST_PIECES)
        frequent, rare = table.filter(often), table.filter(~often).select("piece", "ids")
    first = frequent.select("piece", "ids").toArrow().combine_chunks()
    words, lists = (first[c].chunk(0) if first[c].num_chunks else pa.array([], t) for c, t in (("piece", pa.string()), ("ids", pa.list_(pa.int32()))))
    shared = spark.sparkContext.broadcast((words, lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)))
    again = stage(texts.groupBy(*keep).count().filter("count > 1").select(*keep), "repeated")
    single, n = texts.select(*keep, found.alias("pieces")), again.count()
    if n:
        single = single.join(broadcast_if_small(again), _same(single, again, keep), "left_anti")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in single.select(*keep).schema)
    cut = (lambda ids: ids) if seq_len is None else (lambda ids: F.slice(ids, 1, seq_len))
    if rest:
        rows = stage(single.mapInArrow(_in_place(shared, keep, True, None), f"{kept}, pos int, piece string, ids array<int>, whole boolean"), "stretches")
        parts = rows.filter(~F.col("whole"))
        other = parts.filter("piece is not null").drop("ids").join(rare, "piece", "left")
        joined = parts.filter("piece is null").unionByName(other)
        out = rows.filter("whole").select(*keep, cut(F.col("ids")).alias("input_ids")).unionByName(_gathered(joined, keep, seq_len))
    else:
        out = single.mapInArrow(_in_place(shared, keep, False, missing), f"{kept}, input_ids array<int>").withColumn("input_ids", cut(F.col("input_ids")))
    if n:
        several = texts.join(broadcast_if_small(again), _same(texts, again, keep), "left_semi")
        places = occurrences(several, found, keep).join(table.select("piece", "ids"), "piece", "left")
        if missing is not None:
            places = places.withColumn("ids", F.when(F.col("piece").isNotNull(), F.coalesce("ids", F.array(F.lit(missing)))))
        out = out.unionByName(_gathered(places, keep, seq_len))
    return out


def _gathered(rows: DataFrame, keep: tuple[str, ...], seq_len: int | None = None) -> DataFrame:
    """The ids of each text in the order of ``pos``; rows move first, so that all tasks share the sorting."""
    found = F.sort_array(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids"))))
    out = F.flatten(F.transform(found, lambda p: p["ids"]))
    return rows.select(*keep, "pos", "ids").repartition(*keep).groupBy(*keep).agg(
        (out if seq_len is None else F.slice(out, 1, seq_len)).alias("input_ids"))


def subword_ids(
    texts: DataFrame, vocabulary: DataFrame, seq_len: int | None = None, text: str = "text",
    keep: tuple[str, ...] = ("seq",), pieces: str = PIECES,
) -> DataFrame:
    """``input_ids`` of every text by byte-pair merges in the order of a vocabulary (``token``, ``id``) of any size.

    ``pieces`` is the pattern of what is merged on its own; what it skips gives no token. ``keep`` tells the texts
    apart. ``seq_len`` cuts the rest of each text off, by default nothing. Null and empty texts have no ids. The texts
    are read twice, and ``keep`` alone once more.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pieces), F.lit(0))
    table = stage(merge_pieces(piece_table(occurrences(texts, found, keep)), vocabulary), "pieces")
    return piece_ids(texts, found, table, keep, seq_len)


def word_ids(
    texts: DataFrame, words: DataFrame, size: int, found, seq_len: int | None = None, keep: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """``input_ids`` of the words in the array ``found`` by a table (``word``, ``id``) of ``size`` rows; 0 for a word
    that it lacks."""
    known = words.select(F.col("word").alias("piece"), F.array(F.col("id").cast("int")).alias("ids"))
    if size <= MAX_BROADCAST_PIECES:
        return piece_ids(texts, found, known, keep, seq_len, missing=0)
    table = piece_table(occurrences(texts, found, keep)).join(known, "piece", "left")
    table = stage(table.select("piece", "n", F.coalesce("ids", F.array(F.lit(0))).alias("ids")), "words")
    return piece_ids(texts, found, table, keep, seq_len)
