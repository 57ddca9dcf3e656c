"""Records of one large file for many tasks, where a separator only counts outside of quotes or brackets.

A file is scanned by its separator, split over tasks like any text file. The state at the start of each block follows
from what the blocks before it hold: a narrow table, one row per block, whose sums run over a file. With its start
state a task cuts its blocks into records. What a block holds of a record that begins or ends in another block are
fragments, two per block at most; they are put together by file, and no task needs a whole file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage

# Rows of the table of blocks that every task gets.
MAX_BLOCKS = 1_000_000
# What a row is: a whole record, or the last, first or an inner part of one.
WHOLE, LAST, FIRST, INNER = 0, 1, 2, 3

RECORDS = "path string, block bigint, row bigint, kind int, record string, bad boolean"


def scan_blocks(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """``path, block, value, size`` of files cut at every separator, in file order inside a task."""
    return spark.read.text(paths, lineSep=separator).select(
        F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"),
        F.col("_metadata.file_size").alias("size"))


def before(name: str) -> Column:
    """Sum of a column over the blocks of the file that lie before."""
    inside = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(inside), F.lit(0))


def _runs(batch: pa.RecordBatch):
    """First row and end of the stretches of a batch that belong to one block."""
    block = batch.column("block").to_numpy()
    path = batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cut = np.flatnonzero((np.diff(block) != 0) | (np.diff(path) != 0)) + 1
    yield from zip(np.concatenate([[0], cut]).tolist(), np.append(cut, len(block)).tolist())


def flat(values: pa.Array):
    """Bytes and row offsets of a binary column without nulls."""
    values = values.cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _cut(step, separator: bytes, states: int):
    """Cut blocks into records. ``step(data, offsets, state)`` gives for each row whether a record ends behind it, the
    state behind the last row, and whether something is wrong; ``s0``.. hold the state at the start of a block, and
    ``inside`` whether it lies inside of a record."""
    schema = pa.schema([("path", pa.string()), ("block", pa.int64()), ("row", pa.int64()), ("kind", pa.int32()), ("record", pa.string()), ("bad", pa.bool_())])

    def rows(path, block, starts, kinds, records, bad=False):
        n = len(starts)
        return pa.RecordBatch.from_arrays([
            pa.array([path] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(kinds, pa.int32()),
            records.cast(pa.binary()).view(pa.string()) if not isinstance(records, list) else pa.array(records, pa.binary()).view(pa.string()),
            pa.array([bad] * n, pa.bool_())], schema=schema)

    def run(batches):
        at, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            for first, end in _runs(batch):
                here = (batch.column("path")[first].as_py(), batch.column("block")[first].as_py())
                if here != at:
                    if held is not None and held["rows"]:
                        yield rows(*at, [held["start"]], [INNER if held["inside"] else FIRST], [separator.join(held["rows"])])
                    at = here
                    held = {"state": tuple(batch.column(f"s{k}")[first].as_py() for k in range(states)),
                            "inside": batch.column("inside")[first].as_py(), "rows": [], "start": 0, "seen": 0}
                values = batch.column("value").slice(first, end - first)
                ends, held["state"], bad = step(*flat(values), held["state"])
                if bad:
                    yield rows(*at, [held["seen"]], [WHOLE], [b""], True)
                stops = np.flatnonzero(ends) + 1
                if len(stops):
                    head = held["rows"] + values.slice(0, int(stops[0])).to_pylist()
                    yield rows(*at, [held["start"]], [LAST if held["inside"] else WHOLE], [separator.join(head)])
                    held["inside"] = False
                    if len(stops) > 1:
                        lists = pa.LargeListArray.from_arrays(
                            pa.array(stops - stops[0], pa.int64()), values.slice(int(stops[0]), int(stops[-1] - stops[0])).cast(pa.large_binary()))
                        joined = pc.binary_join(lists, pa.scalar(separator, pa.large_binary()))
                        yield rows(*at, stops[:-1] + held["seen"], np.zeros(len(stops) - 1, np.int32), joined)
                    held["rows"], held["start"] = [], held["seen"] + int(stops[-1])
                    values = values.slice(int(stops[-1]))
                held["rows"] += values.to_pylist()
                held["seen"] += end - first
        if held is not None and held["rows"]:
            yield rows(*at, [held["start"]], [INNER if held["inside"] else FIRST], [separator.join(held["rows"])])

    return run


def cut_records(scan: DataFrame, index: DataFrame, step, separator: str, states: int, name: str) -> DataFrame:
    """The records of a scan, staged: ``path, block, row`` of their start, ``record``, ``bad``.

    ``index`` has ``path``, ``block``, ``inside`` and the state at the start of every block. A row that is ``bad`` tells
    that something is wrong with its file; it holds no record.
    """
    if index.count() > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks; read the files in several lots")
    cut = scan.join(F.broadcast(index), ["path", "block"]).mapInArrow(_cut(step, separator.encode(), states), RECORDS)
    cut = stage(cut, name)
    parts = cut.filter(F.col("kind") != WHOLE)
    # In file order a record is its first part, inner parts and its last part.
    order = Window.partitionBy("path").orderBy("block", "kind")
    groups = parts.select("path", "block", "kind").withColumn("group", F.count_if(F.col("kind") == FIRST).over(order))
    piece = F.struct("block", "kind", "row", "record")
    joined = parts.join(groups, ["path", "block", "kind"]).groupBy("path", "group").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    joined = joined.select(
        "path", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["row"].alias("row"),
        F.array_join(F.transform("p", lambda x: x["record"]), separator).alias("record"), F.lit(False).alias("bad"))
    return cut.filter(F.col("kind") == WHOLE).select("path", "block", "row", "record", "bad").unionByName(joined)


# ── quotes ──

def quote_step(data: np.ndarray, offsets: np.ndarray, state: tuple):
    """A record of CSV ends with a line behind which all quotes are closed.

    Wrong is a quote inside of a cell that does not begin with one, or text behind a closing quote, or a lone carriage
    return outside of quotes: parsers differ on them, and lines may end there.
    """
    quote = np.flatnonzero(data == 34)
    upto = np.searchsorted(quote, offsets)  # quotes before each row's start
    open_ = (state[0] + upto[1:]) & 1
    starts, lasts = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    starts[offsets[:-1]] = True
    full = np.diff(offsets) > 0
    lasts[offsets[1:][full] - 1] = True
    padded = np.append(data, 44)
    closing = (state[0] + np.arange(len(quote))) & 1 == 1
    opens, closes = quote[~closing], quote[closing]
    prior = padded[opens - 1]
    wrong = ~(starts[opens] | (prior == 44) | (prior == 34))
    after = padded[closes + 1]
    tail = lasts[closes] | ((after == 13) & lasts[np.minimum(closes + 1, len(data))])
    wrong_close = ~(tail | (after == 44) | (after == 34))
    back = np.flatnonzero(data == 13)
    loose = back[~lasts[back]]
    wrong_return = (state[0] + np.searchsorted(quote, loose)) & 1 == 0
    return open_ == 0, (int(open_[-1]) if len(open_) else state[0],), bool(wrong.any() or wrong_close.any() or wrong_return.any())


def quote_index(scan: DataFrame) -> DataFrame:
    """Per block of a scan by line: whether it starts inside of quotes, and how many lines may not be records.

    Such lines leave a quote open or hold a carriage return before their end.
    """
    text = F.col("value").cast("string")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    back = F.instr(text, "\r")
    odd = (quotes % 2 == 1) | ((back > 0) & (back < F.length(text)))
    blocks = scan.groupBy("path", "block", "size").agg((F.sum(quotes) % 2).alias("odd"), F.count_if(odd).alias("open_lines"))
    return blocks.withColumn("s0", (before("odd") % 2).cast("int")).withColumn("inside", F.col("s0") == 1)


# ── brackets ──

def _marks(data: np.ndarray):
    """Positions of the quotes that no backslash escapes, and +1 or -1 for each bracket."""
    at = np.arange(len(data))
    plain = np.maximum.accumulate(np.where(data != 92, at, -1)) if len(data) else at
    quote = np.flatnonzero(data == 34)
    slashes = np.where(quote > 0, quote - 1 - plain[quote - 1], 0)
    change = np.zeros(len(data), np.int64)
    change[(data == 91) | (data == 123)] = 1
    change[(data == 93) | (data == 125)] = -1
    return quote[slashes % 2 == 0], change


def bracket_step(data: np.ndarray, offsets: np.ndarray, state: tuple):
    """An element of a JSON array ends at a comma outside of strings and of all brackets but the first.

    Wrong are bytes that are not UTF-8.
    """
    quote, change = _marks(data)
    inside = np.zeros(len(data) + 1, np.int64)
    inside[quote] = 1
    string = (state[0] + np.cumsum(inside)) & 1  # behind each byte
    depth = state[1] + np.concatenate([[0], np.cumsum(np.where(string[:-1] == 0, change, 0))])
    behind = np.concatenate([[state[0]], string[:-1]])[offsets[1:]]
    level = depth[offsets[1:]]
    return (behind == 0) & (level == 1), (int(behind[-1]), int(level[-1])) if len(level) else state, not _valid(data)


def _valid(data: np.ndarray) -> bool:
    """Whether the bytes are UTF-8."""
    if not len(data) or data.max() < 128:
        return True
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


def _bracket_sums(batches):
    """Per block: parity of its quotes, its change of depth when it starts outside or inside of a string, its bytes."""
    at, sums = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        for first, end in _runs(batch):
            here = (batch.column("path")[first].as_py(), batch.column("block")[first].as_py())
            if here != at:
                if at is not None:
                    yield _sums_row(at, sums)
                at, sums = here, [0, 0, 0, 0]
            data, _ = flat(batch.column("value").slice(first, end - first))
            quote, change = _marks(data)
            mark = np.zeros(len(data), np.int64)
            mark[quote] = 1
            string = (sums[0] + np.cumsum(mark)) & 1
            sums = [
                (sums[0] + len(quote)) & 1, sums[1] + int(change[string == 0].sum()), sums[2] + int(change[string == 1].sum()),
                sums[3] + len(data) + end - first]
    if at is not None:
        yield _sums_row(at, sums)


def _sums_row(at, sums):
    return pa.RecordBatch.from_pylist([{"path": at[0], "block": at[1], "odd": sums[0], "outside": sums[1], "within": sums[2], "bytes": sums[3]}])


def bracket_index(scan: DataFrame) -> DataFrame:
    """Per block of a scan by comma: string state and depth at its start."""
    blocks = scan.mapInArrow(_bracket_sums, "path string, block bigint, odd bigint, outside bigint, within bigint, bytes bigint")
    blocks = blocks.withColumn("s0", (before("odd") % 2).cast("int"))
    blocks = blocks.withColumn("change", F.when(F.col("s0") == 0, F.col("outside")).otherwise(F.col("within")))
    blocks = blocks.withColumn("s1", before("change").cast("int"))
    return blocks.withColumn("inside", (F.col("block") > 0) & ((F.col("s0") == 1) | (F.col("s1") != 1)))
