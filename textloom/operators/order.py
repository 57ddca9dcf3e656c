"""First rows in insertion order."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

# So many narrow positions are sorted at once when a slot is small enough.
MERGE_ROWS = 100_000
SLOTS = 65_536
# Up to so many first rows are found by a heap in each task, which is as large as the number asked for.
HEAP_ROWS = 10_000


def preview(samples: DataFrame, n: int = 5, seq: str = "seq") -> DataFrame:
    """The first n samples, in order."""
    return top_rows(samples, [F.col(seq)], n)


def top_rows(rows: DataFrame, order: list[Column], n: int, heap_rows: int = HEAP_ROWS) -> DataFrame:
    """The first n rows in an order, sorted by it; rows that are equal in it are taken in any order.

    A large n is no reason for a large heap: the rows are then sorted over all tasks and written once, and the n-th
    is found by its place in the sorted parts.
    """
    if n <= heap_rows:
        return rows.orderBy(*order).limit(n)
    at = "_place_in_order"
    placed = stage(rows.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "sorted")
    return first_rows(placed, n, at).orderBy(at).drop(at)


def first_rows(rows: DataFrame, n: int, seq: str = "seq", merge_rows: int = MERGE_ROWS) -> DataFrame:
    """The first n rows by ``seq``, exactly n of them if there are as many; 0 keeps all.

    The position of the n-th row is searched on ``seq`` alone, and the rest is a filter that each task applies on its
    own. Null positions come last. Of rows that share the last position those with the smallest hashes of their
    values are taken, so any setting and order of files gives the same rows.
    """
    if n <= 0:
        return rows
    here, left = rows.filter(F.col(seq).isNotNull()), n
    last = nth_position(here, n, seq, merge_rows)
    if last is None:
        left -= here.count()
        return here if left <= 0 else here.unionByName(_by_hash(rows.filter(F.col(seq).isNull()), left, merge_rows))
    at = F.lit(last).cast(rows.schema[seq].dataType)
    below, same = here.filter(F.col(seq) < at), here.filter(F.col(seq) == at)
    left -= below.count()
    return below.unionByName(same if same.count() <= left else _by_hash(same, left, merge_rows))


def _by_hash(rows: DataFrame, n: int, merge_rows: int) -> DataFrame:
    """n rows with the smallest hashes of all values; rows of one hash are as good as equal."""
    marked = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    last = nth_position(marked, n, "_hash", merge_rows)
    if last is None:
        return rows
    below = marked.filter(F.col("_hash") < int(last))
    return below.unionByName(marked.filter(F.col("_hash") == int(last)).limit(n - below.count())).drop("_hash")


def nth_position(rows: DataFrame, n: int, seq: str = "seq", merge_rows: int = MERGE_ROWS):
    """The n-th smallest whole-number ``seq``; None when there are not more than n rows.

    Each round counts the rows of 65,536 equal slots of the open range and goes
    on inside the slot that holds the n-th row.
    """
    pos = rows.select(F.col(seq).cast("decimal(38,0)").alias("p"))
    low, high, total = pos.agg(F.min("p"), F.max("p"), F.count("p")).first()
    if total <= n:
        return None
    low, high, left = int(low), int(high), n
    while True:
        width = (high - low) // SLOTS + 1
        inside = pos.filter((F.col("p") >= Decimal(low)) & (F.col("p") <= Decimal(high)))
        ahead, step = F.col("p") - F.lit(Decimal(low)), F.lit(Decimal(width))
        # Whole before dividing: a quotient of long decimals is rounded.
        slot = ((ahead - ahead % step) / step).cast("bigint")
        counts = inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.orderBy("slot"))
        hit = counts.withColumn("upto", upto).filter(F.col("upto") >= left).orderBy("slot").first()
        left -= hit["upto"] - hit["rows"]
        low, high = low + hit["slot"] * width, min(high, low + (hit["slot"] + 1) * width - 1)
        if low == high:
            return Decimal(low)
        if hit["rows"] <= merge_rows:
            inside = pos.filter((F.col("p") >= Decimal(low)) & (F.col("p") <= Decimal(high)))
            return inside.orderBy("p").offset(left - 1).limit(1).first()["p"]
