"""Writers: JSONL, JSON arrays, Parquet, split folders, the metadata record, CSV to Parquet."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import PurePosixPath

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import csv
from ..storage import work_path

FORMATS = ("jsonl", "json", "parquet")
# The codecs of the conversion.
CODECS = ("zstd", "snappy", "gzip", "brotli", "none")


def check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}; use one of {', '.join(FORMATS)}")


def output_path(path: str, fmt: str) -> str:
    """The path with the suffix of the format; a different suffix is replaced."""
    check_format(fmt)
    folder, _, name = path.rstrip("/").rpartition("/")
    name = str(PurePosixPath(name).with_suffix("." + fmt))
    return f"{folder}/{name}" if folder or path.startswith("/") else name


def metadata_path(path: str) -> str:
    folder, _, name = path.rpartition("/")
    name = str(PurePosixPath(name).with_suffix(".meta.json"))
    return f"{folder}/{name}" if folder or path.startswith("/") else name


def write_samples(samples: DataFrame, path: str, fmt: str = "jsonl", mode: str = "overwrite") -> str:
    """Write a folder of part files in one of the formats; gives back its path."""
    path = output_path(path, fmt)
    if fmt == "jsonl":
        samples.write.mode(mode).json(path, ignoreNullFields=False)
    elif fmt == "json":
        write_json_arrays(samples, path, mode)
    else:
        samples.write.mode(mode).parquet(path, compression="zstd")
    return path


def write_json_arrays(samples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Each part file is one JSON array with a record per line.

    The records are made in the JVM; the tasks only put brackets and commas
    around them, so no task needs to know the others' rows.
    """
    records = samples.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    records.mapInArrow(_array_lines, "value string").write.mode(mode).text(path)


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines(values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values], ["value"])

    yield lines(pa.array(["["]))
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("value").cast(pa.string())
        marks = pa.array([" " if first and not i else "," for i in range(len(values))])
        first = False
        yield lines(pc.binary_join_element_wise(marks, values, ""))
    yield lines(pa.array(["]"]))


def write_splits(samples: DataFrame, root: str, mode: str = "overwrite") -> str:
    """One ``split=<name>`` folder per split; samples without a split go to train."""
    split = F.when(F.length(F.btrim("split")) > 0, F.col("split")).otherwise("train")
    samples.withColumn("split", split).write.mode(mode).partitionBy("split").parquet(root, compression="zstd")
    return root


def metadata_row(
    split_counts: DataFrame, name: str, removed: dict[str, int], ratios, text_column: str, source_column: str,
    creator: str, version: str,
) -> DataFrame:
    """The metadata record of a built dataset as a one-row DataFrame.

    ``split_counts`` is the split histogram: its rows are label names, not samples.
    """
    def constant_map(values: dict[str, int]):
        if not values:
            return F.create_map().cast("map<string,bigint>")
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv]).cast("map<string,bigint>")

    return split_counts.agg(
        F.coalesce(F.sum("samples"), F.lit(0)).cast("bigint").alias("sample_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "samples")))).alias("splits"),
    ).select(
        F.lit(datetime.now(timezone.utc).isoformat()).alias("created"),
        F.lit(creator).alias("creator"), F.lit(version).alias("version"), F.lit(name).alias("name"),
        F.lit(text_column).alias("text_column"), F.lit(source_column).alias("source_column"),
        "sample_count", constant_map(removed).alias("removed"),
        F.array(*[F.lit(float(r)) for r in ratios]).alias("split_ratios"), "splits",
    )


def write_metadata(row: DataFrame, path: str) -> str:
    row.coalesce(1).write.mode("overwrite").json(path)
    return path


def check_codec(spark: SparkSession, codec: str) -> str:
    """The writer's name of the codec; an error when it is unknown or not installed."""
    if codec not in CODECS:
        raise ValueError(f"unknown compression: {codec}; use one of {', '.join(CODECS)}")
    if codec == "brotli":
        try:
            spark.range(1).write.parquet(work_path(spark, "codec"), compression=codec)
        except Exception as e:
            raise ValueError("brotli is not installed in this Spark; use zstd, snappy, gzip or none") from e
    return "uncompressed" if codec == "none" else codec


def csv_to_parquet(
    spark: SparkSession, source: str | list[str], target: str, compression: str = "zstd", schema=None,
    multi_line: bool | None = None, mode: str = "overwrite", batch_size: int = 0,
) -> dict:
    """Convert CSV to Parquet. Rows are counted while they are written.

    A batch is one file; with a ``batch_size`` no file holds more rows.
    """
    codec = check_codec(spark, compression)
    strings = csv.read_strings(spark, source, multi_line)
    if schema is None:
        schema, rows = csv.infer_types(strings)
        empty = rows == 0
    else:
        empty = strings.isEmpty()
    if empty:
        raise ValueError("the CSV holds no rows")
    seen = Observation()
    typed = csv.typed(strings, schema).observe(seen, F.count(F.lit(1)).alias("rows"))
    typed.write.mode(mode).option("maxRecordsPerFile", max(0, int(batch_size))).parquet(target, compression=codec)
    return {
        "input": source, "output": target, "rows": seen.get["rows"],
        "batches": len(spark.read.parquet(target).inputFiles()), "compression": compression,
    }
