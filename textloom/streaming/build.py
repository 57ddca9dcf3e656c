"""Streaming forms: dataset build and CSV conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key
from ..operators.clean import clean, length_range
from ..operators.split import SEED, check_ratios, order_key
from ..operators.tokens import byte_tokens
from ..sources import csv
from ..sinks.files import check_codec

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def clean_stream(
    samples: DataFrame, min_chars: int = 0, max_chars: int = 0, drop_duplicates: bool = True,
    event_time: str | None = None, delay: str = "1 hour",
) -> DataFrame:
    """Strip, filter and dedupe a stream of samples.

    The state holds 32 bytes per distinct text. Without ``event_time`` it grows
    with the number of texts; with it, copies are found within ``delay`` and the
    state stays bounded.
    """
    out = length_range(clean(samples), min_chars, max_chars)
    if not drop_duplicates:
        return out
    out = out.withColumn("_key", content_key(F.col("text")))
    if event_time:
        return out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return out.dropDuplicates(["_key"]).drop("_key")


def split_by_hash(samples: DataFrame, ratios=(0.9, 0.05, 0.05), seed: int = SEED) -> DataFrame:
    """Stateless split: the text's hash as a fraction against the ratios.

    The shares hold in expectation; an endless stream has no exact counts.
    """
    train, val, _ = check_ratios(ratios)
    # 13 hex digits are 52 bits, exact as a double.
    head = F.conv(F.substring(order_key(F.sha2("text", 256), seed), 1, 13), 16, 10).cast("double")
    part = head / F.lit(float(1 << 52))
    label = F.when(part < train, "train").when(part < train + val, "validation").otherwise("test")
    return samples.withColumn("split", label)


def start(rows: DataFrame, output: str, checkpoint: str, available_now: bool = True, fmt: str = "parquet",
          partition_by: tuple[str, ...] = (), **options) -> StreamingQuery:
    """Append the stream to a folder; each file is committed exactly once.

    The state store of the session becomes RocksDB, so that the dedupe state may be
    larger than the executors' heap, unless the session has chosen one.
    """
    conf = rows.sparkSession.conf
    if conf.get(_STORE, None) is None:
        conf.set(_STORE, ROCKSDB)
    writer = rows.writeStream.format(fmt).outputMode("append").options(**options)
    writer = writer.option("checkpointLocation", checkpoint).partitionBy(*partition_by)
    return (writer.trigger(availableNow=True) if available_now else writer).start(output)


def stream_build(
    samples: DataFrame, output: str, checkpoint: str, split_ratios=(0.9, 0.05, 0.05), min_chars: int = 0,
    max_chars: int = 0, drop_duplicates: bool = True, event_time: str | None = None, delay: str = "1 hour",
    available_now: bool = True,
) -> StreamingQuery:
    """Clean, dedupe and split a stream of samples into a Parquet folder."""
    out = clean_stream(samples, min_chars, max_chars, drop_duplicates, event_time, delay)
    if sum(check_ratios(split_ratios)) > 0:
        out = split_by_hash(out, split_ratios)
    return start(out.select("text", "source", "split"), output, checkpoint, available_now, compression="zstd")


def stream_tokens(samples: DataFrame, seq_len: int) -> DataFrame:
    """Token ids of a stream of samples; stateless."""
    return byte_tokens(clean(samples), seq_len, keep=())


def stream_csv_to_parquet(
    spark: SparkSession, folder: str, output: str, checkpoint: str, schema=None, compression: str = "zstd",
    multi_line: bool | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Convert the CSV files of a folder as they arrive.

    The types, and whether cells run over line ends, are found once in the files
    that are there at the start, and then fixed: a later cell that does not fit
    stops the query.
    """
    codec = check_codec(spark, compression)
    if multi_line is None:
        multi_line = csv.has_quoted_newlines(spark, folder)
    if schema is None:
        schema, rows = csv.infer_types(csv.read_strings(spark, folder, multi_line))
        if not rows:
            raise ValueError("the CSV holds no rows")
    names = csv.schema_names(schema)
    cells = spark.readStream.schema(csv.string_schema(names)).csv(
        folder, header=True, multiLine=multi_line, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    return start(csv.typed(csv.null_words(cells), schema), output, checkpoint, available_now, compression=codec)
