"""Helpers that several of the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# A broadcast list of row numbers has two bigints a row; this many stay below some 100 MB once hashed.
MAX_BROADCAST_ROWS = 1_000_000


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def numbered(df: DataFrame, columns: dict[str, Column], from_files: bool, name: str) -> DataFrame:
    """``columns`` of each row and its identity ``rf``, ``ri``, which later readings see again.

    With ``from_files``, ``df`` is a plain scan of Parquet files, whose rows are known by file and place. Anything
    else is written to a staged table once.
    """
    chosen = [c.alias(n) for n, c in columns.items()]
    if from_files:
        meta = df.metadataColumn("_metadata")
        return df.select(*chosen, F.xxhash64(meta["file_path"]).alias("rf"), meta["row_index"].cast("bigint").alias("ri"))
    return stage(df.select(*chosen, F.lit(0).cast("bigint").alias("rf"), F.monotonically_increasing_id().alias("ri")), name)


def pick_rows(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The rows of ``docs``, a plain scan of Parquet files, with an identity in ``rows`` (columns rf, ri).

    The list is broadcast only when its counted size allows; else both sides are shuffled by the unique identity.
    Columns of ``docs`` may have any names.
    """
    inner = numbered(docs, {"doc": F.struct(*[docs[f"`{c}`"] for c in docs.columns])}, True, name)
    staged = stage(rows.select("rf", "ri"), name)
    listed = F.broadcast(staged) if staged.count() <= MAX_BROADCAST_ROWS else staged
    return inner.join(listed, ["rf", "ri"], "left_semi").select("doc.*")


def running_before(rows: DataFrame, keys: list[str], order: str, value: str, name: str, fan: int = 1 << 14) -> DataFrame:
    """``rows`` with a bigint column ``name``: the sum of ``value`` over rows of the same ``keys`` with a smaller ``order``.

    ``order`` is a number from 0 on, once for each key. Sums over blocks of ``fan`` numbers are run up first and rows
    only within their block, so with n numbers no window holds more than ``fan`` or n / ``fan`` rows of a key. ``rows``
    is read twice. Nulls count as zero.
    """
    blocks = rows.withColumn("_block", F.floor(F.col(order) / fan).cast("bigint"))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    starts = sums.select(*keys, "_block", F.coalesce(F.sum("_sum").over(earlier(*keys, "_block")), F.lit(0)).alias("_start"))
    inside = blocks.withColumn("_inside", F.coalesce(F.sum(value).over(earlier(*keys, "_block", order)), F.lit(0)))
    return inside.join(starts, [*keys, "_block"]).select(*rows.columns, (F.col("_start") + F.col("_inside")).cast("bigint").alias(name))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
