"""Dedupe of a stream against a table of keys instead of state: memory does not grow with what has been seen.

Every micro-batch leaves a run: the content keys of its new texts, sorted, in a folder ``run-<first>-<last>`` that names
the batches it covers. A batch sends its own keys to the runs and learns which of them are there; the runs are only
scanned. Runs of like size are merged, so their number grows with the logarithm of the texts.

The runs and the output of a batch are folders of its number, written whole. A batch that is run again after a failure
sees the runs before it only, and replaces what it had written.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key
from ..operators.clean import clean, length_range
from ..operators.split import check_ratios
from ..storage import broadcast_if_small, remove_staged, stage
from .build import split_by_hash

# So many runs of one size class are merged into one of the next.
FAN_IN = 8
RUN_KEYS_A_FILE = 4_000_000


def _runs(spark: SparkSession, keys: str, before: int) -> list[tuple[int, int, str]]:
    """(first batch, last batch, path) of the whole runs of earlier batches; of overlapping ones the widest."""
    place = spark._jvm.org.apache.hadoop.fs.Path(keys)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        name = re.fullmatch(r"run-(\d+)-(\d+)", status.getPath().getName())
        if name and int(name[2]) < before and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append((int(name[1]), int(name[2]), status.getPath().toString()))
    found.sort(key=lambda r: (r[0], -r[1]))
    return [r for i, r in enumerate(found) if not any(o[0] <= r[0] and r[1] <= o[1] for o in found[:i])]


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema("key binary").parquet(*paths)


def _write_run(rows: DataFrame, path: str, n: int) -> None:
    parts = -(-max(n, 1) // RUN_KEYS_A_FILE)
    dealt = rows.coalesce(1) if parts == 1 else rows.repartitionByRange(parts, "key")
    dealt.sortWithinPartitions("key").write.mode("overwrite").parquet(path)


def merge_runs(spark: SparkSession, keys: str, before: int, fan_in: int = FAN_IN) -> None:
    """Merge the newest neighbouring runs of one size class while there are ``fan_in`` of them.

    A merged run is written whole before its parts are deleted; until then it hides them.
    """
    while True:
        runs = _runs(spark, keys, before)
        sizes = [_read(spark, [path]).count() for _, _, path in runs]  # from the footers
        level = [0 if n < 2 else (n - 1).bit_length() // max(1, fan_in.bit_length() - 1) for n in sizes]
        tail = len(runs)
        while tail and level[tail - 1] <= level[-1]:
            tail -= 1
        if len(runs) - tail < fan_in:
            return
        some = runs[tail:]
        _write_run(_read(spark, [p for _, _, p in some]), f"{keys}/run-{some[0][0]}-{some[-1][1]}", sum(sizes[tail:]))
        remove_staged(spark, [p for _, _, p in some])


def new_texts(batch: DataFrame, keys: str, batch_id: int, staged: list[str], fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """The rows of a batch of cleaned samples whose texts no earlier batch had, the smallest ``seq`` of each, and their
    keys. The batch is written once, as it is read several times."""
    spark = batch.sparkSession
    rows = stage(batch.withColumn("key", content_key(F.col("text"))), "batch", staged)
    own = stage(rows.groupBy("key").agg(F.min("seq").alias("seq")), "batch-keys", staged)
    merge_runs(spark, keys, batch_id, fan_in)
    runs = _runs(spark, keys, batch_id)
    if runs:
        # The small side is the batch: the runs are scanned where they lie.
        seen = _read(spark, [p for _, _, p in runs]).join(broadcast_if_small(own.select("key")), "key", "left_semi")
        own = stage(own.join(broadcast_if_small(stage(seen.distinct(), "seen", staged)), "key", "left_anti"), "new-keys", staged)
    return rows.join(broadcast_if_small(own), ["key", "seq"], "left_semi").dropDuplicates(["key"]).drop("key"), own.select("key")


def stream_build_runs(
    samples: DataFrame, output: str, checkpoint: str, keys: str, split_ratios=(0.9, 0.05, 0.05), min_chars: int = 0,
    max_chars: int = 0, available_now: bool = True, fan_in: int = FAN_IN,
) -> StreamingQuery:
    """Clean, dedupe and split a stream of samples into Parquet folders ``batch=<n>`` below ``output``.

    ``keys`` is the folder of the runs; it belongs to the checkpoint. Of equal texts the first batch keeps one, and
    inside a batch the smallest ``seq``. Every text is found again, however long ago it came.
    """
    splitting = sum(check_ratios(split_ratios)) > 0

    def process(batch: DataFrame, batch_id: int) -> None:
        staged: list[str] = []
        out, own = new_texts(length_range(clean(batch), min_chars, max_chars), keys, batch_id, staged, fan_in)
        out = split_by_hash(out, split_ratios) if splitting else out
        out.select("text", "source", "split").write.mode("overwrite").parquet(f"{output}/batch={batch_id}", compression="zstd")
        _write_run(own, f"{keys}/run-{batch_id}-{batch_id}", own.count())
        remove_staged(batch.sparkSession, staged)

    writer = samples.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
