"""Staged tables in the cluster's shared folder, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast row here is at most a 16-byte key and a few numbers, so this many
# rows stay below about half a gigabyte once hashed.
MAX_BROADCAST_ROWS = 4_000_000
# A bit a row: some 130 MB.
MAX_BROADCAST_BITS = 1 << 30

# From so many tasks on, rows that stay where they are are stored by task; at most so many tasks store them.
BUCKETED_TASKS, MAX_SHARDS = 256, 100_000
# monotonically_increasing_id() keeps the row number of a task in its low bits.
POS_MASK = (1 << 33) - 1


def work_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textloom-")
    return f"{root.rstrip('/')}/textloom/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return a scan of it; its path is added to ``paths``.

    This cuts the lineage, fixes every value (row positions included) and
    survives the loss of executors, because the files are in the shared folder.
    """
    path = work_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_rows(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once, with the task that wrote each row (``_shard``) and the row's number there (``_pos``).

    With many tasks the files are a bucketed table in which every bucket holds the rows of one task, so a join by
    ``_shard`` leaves them where they are. Writing them moves no row, as each task writes its own bucket. The table's
    entry in the session's catalogue is dropped again; the scan does not need it. A table of this function stays as it is.
    """
    if is_staged_by_task(df):
        return df
    spark = df.sparkSession
    tasks = df.rdd.getNumPartitions()
    if tasks > MAX_SHARDS:
        df, tasks = df.coalesce(MAX_SHARDS), MAX_SHARDS
    numbered = df.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().bitwiseAND(F.lit(POS_MASK)).alias("_pos"))
    if tasks < BUCKETED_TASKS:
        return stage(numbered.withColumnRenamed("_task", "_shard"), name, paths)
    path = work_path(spark, name)
    if paths is not None:
        paths.append(path)
    table = f"textloom_{uuid.uuid4().hex}"
    shards = _shard_numbers(spark, tasks)
    # A task beyond the counted ones shares a bucket.
    rows = numbered.join(F.broadcast(shards), "_task", "left").withColumn("_shard", F.coalesce("_shard", -1 - F.col("_task"))).drop("_task")
    rows.write.format("parquet").bucketBy(tasks, "_shard").option("path", path).saveAsTable(table)
    staged = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return staged


def is_staged_by_task(df: DataFrame) -> bool:
    return {"_shard", "_pos"} <= set(df.columns)


def _shard_numbers(spark: SparkSession, tasks: int) -> DataFrame:
    """For each task a number that Spark's bucketing puts in a bucket of its own."""
    tried = 2 * tasks
    while True:
        tried *= 4
        bucket = F.pmod(F.hash(F.col("id").cast("int")), F.lit(tasks))
        found = spark.range(tried).groupBy(bucket.alias("_task")).agg(F.min(F.col("id").cast("int")).alias("_shard"))
        if found.count() == tasks:
            return found


def keep_rows(staged: DataFrame, kept: DataFrame, key: str = "seq") -> DataFrame:
    """The rows of a whole table of ``stage_rows`` whose ``key`` is in ``kept``; the rows themselves do not move.

    Only keys and positions are shuffled. Each shard gets one bit per row, and every row looks up its own bit.
    """
    marks = kept.select(key, F.lit(True).alias("_kept"))
    bit = F.when(F.col("_kept"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_pos") % 64).cast("int"))).otherwise(0)
    words = staged.select("_shard", "_pos", key).join(marks, key, "left").groupBy(
        "_shard", F.floor(F.col("_pos") / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    sets = words.groupBy("_shard").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"))
    sets = sets.select(F.col("_shard").alias("_of"), F.transform("words", lambda w: w["bits"]).alias("_bits"))
    if staged.count() <= MAX_BROADCAST_BITS:
        sets = F.broadcast(sets)
    word = F.get("_bits", F.floor(F.col("_pos") / 64).cast("int"))
    own = F.call_function("shiftrightunsigned", word, (F.col("_pos") % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return staged.join(sets, (F.col("_shard") == F.col("_of")) & own, "left_semi").drop("_shard", "_pos")


def remove_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more, in whatever store they are."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    paths.clear()


def broadcast_if_small(staged: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when a staged narrow table is known to be small.

    The count comes from the Parquet footers. Beyond the bound the hint is left
    out and the join shuffles both sides.
    """
    return F.broadcast(staged) if staged.count() <= max_rows else staged
