"""Loading of finished datasets: files, folders, split folders, streams."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import first_rows
from ..storage import stage, work_path
from . import csv
from .files import FILE_DIGITS, JSONL_SUFFIXES, data_suffix, existing_files, plain_path, position_in_file, ranks, reader_paths, with_rank
from .samples import SEQ, packed_seq

# The file types of a dataset folder.
DATA_SUFFIXES = (".json", ".jsonl", ".csv")


def _json(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """JSON lines are split over tasks; an array or an indented object is one document per file.

    Files named .jsonl hold lines. Of other files each one's first line decides for that file, so a folder may hold
    both; columns that one kind lacks are null there. Only first blocks are looked at.
    """
    if all(data_suffix(p) in JSONL_SUFFIXES for p in paths):
        return spark.read.json(paths, schema=schema, mode="FAILFAST")
    found = _line_files(spark, paths, F.col("_metadata.file_block_start") == 0)
    if rest := [f for f in spark.read.text(paths).inputFiles() if plain_name(f) not in {plain_name(g) for g, _ in found}]:
        found += _line_files(spark, reader_paths(rest), F.lit(True))  # files whose first block is blank
    parts = [
        spark.read.json(reader_paths(sorted(f for f, is_lines in found if is_lines == lines)), schema=schema, multiLine=not lines, mode="FAILFAST")
        for lines in (True, False) if any(is_lines == lines for _, is_lines in found)
    ]
    if not parts:
        return spark.read.json(paths, schema=schema, mode="FAILFAST")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)


def _line_files(spark: SparkSession, paths: list[str], blocks) -> list[tuple[str, bool]]:
    """Per file with text in some ``blocks``: whether its first line is an object, which makes it a file of lines."""
    text = spark.read.text(paths).filter(blocks).select(
        F.btrim("value").alias("v"), F.col("_metadata.file_path").alias("file"), position_in_file().alias("pos")).filter("v <> ''")
    heads = text.groupBy("file").agg(F.min_by("v", "pos").alias("v"))
    heads = heads.select("file", (F.startswith("v", F.lit("{")) & F.try_parse_json("v").isNotNull()).alias("lines"))
    return [tuple(r) for r in heads.collect()]  # a row for each file


def plain_name(name: str) -> str:
    return re.sub("^file:/+", "file:/", name)


@dataclass(frozen=True)
class StoredDataset:
    """Where a dataset lies: ``provider`` is ``local`` (one file or dataset), ``folder`` (a downloaded folder, of which
    the first JSON, JSONL or CSV file or dataset counts) or ``splits`` (folders ``split=<name>``)."""

    provider: str
    place: str
    split: str = "train"
    text_column: str = "text"


def load_any(
    spark: SparkSession, source: StoredDataset, max_samples: int = 0, streaming: bool = False, checkpoint: str = "", schema=None,
) -> DataFrame:
    """Load a dataset from any provider; ``streaming`` gives a stream, to which ``max_samples`` does not apply.

    A stream of JSON or CSV keeps its types beside ``checkpoint``. The text column is renamed to ``text``; it must be
    there.
    """
    if source.provider not in ("local", "folder", "splits"):
        raise ValueError("provider must be local, folder or splits")
    if not streaming:
        if source.provider == "local":
            rows = load_dataset(spark, source.place, max_samples, schema)
        elif source.provider == "folder":
            rows = load_folder(spark, source.place, False, max_samples, schema)
        else:
            rows = load_split(spark, source.place, source.split, max_samples)
    elif source.provider == "splits":
        path = f"{source.place.rstrip('/')}/split={source.split}"
        rows = stream_dataset(spark, path, "parquet", spark.read.parquet(path).schema)
    else:
        path = source.place
        if source.provider == "folder":
            files = sorted(existing_files(spark, [path], DATA_SUFFIXES))
            if not files:
                raise FileNotFoundError(f"no JSON, JSONL or CSV file below {path}")
            chosen = first_dataset(files)
            path = reader_paths(chosen[:1] if len(chosen) == 1 else [chosen[0].rpartition("/")[0]])[0]
        if not checkpoint:
            raise ValueError("a stream needs a checkpoint")
        fmt = "json" if path.rstrip("/").lower().endswith((".json", ".jsonl")) else "csv"
        rows = stream_load(spark, path, fmt, checkpoint, schema)
    if source.text_column not in rows.columns:
        raise ValueError(f"no column {source.text_column}; there are: {', '.join(rows.columns)}")
    return rows.withColumnRenamed(source.text_column, "text")


def load_dataset(spark: SparkSession, path: str, max_samples: int = 0, schema=None) -> DataFrame:
    """A JSON, JSONL, CSV or Parquet dataset with the types found in it.

    The suffix decides, in any case; what has no known suffix is CSV. With
    ``max_samples`` the first rows are kept, in file order. A ``schema`` spares
    the pass that finds the types of JSON and CSV.
    """
    name = path.rstrip("/").lower()
    if name.endswith((".json", ".jsonl")):
        rows = _json(spark, [path], schema)
    elif name.endswith(".parquet"):
        rows = spark.read.parquet(path)
    else:
        rows = csv.read_csv(spark, path, schema)
    return take_first(rows, max_samples)


def take_first(rows: DataFrame, max_samples: int) -> DataFrame:
    """The first rows of a file scan in (path, position) order; 0 keeps all.

    Only as many leading files as hold these rows are read: the filter on the
    path prunes the file list, and the number of files grows fourfold per try.
    """
    if max_samples <= 0:
        return rows
    files = sorted(rows.inputFiles())
    path, head, n = F.col("_metadata.file_path"), rows, 1
    while n < len(files):
        first = files[:n]
        some = rows.filter(path.isin(first + [re.sub("^file:/+", "file:/", f) for f in first]))
        if some.limit(max_samples).count() >= max_samples:
            head, files = some, first
            break
        n *= 4
    head = _placed(head)
    placed = with_rank(head, ranks(files), "path_")
    placed = placed.withColumn("pos_", packed_seq(F.col("file_rank"), F.col("pos_"), FILE_DIGITS))
    return first_rows(placed, max_samples, "pos_").select(*rows.columns)


def _placed(scan: DataFrame) -> DataFrame:
    """The rows with their file and their place in it, which later readings see again.

    Parquet knows the place of each row. Rows of text forms are numbered anew in every reading, so they are written
    once.
    """
    path = plain_path(F.col("_metadata.file_path")).alias("path_")
    if "row_index" in scan.select("_metadata").schema["_metadata"].dataType.names:
        return scan.select("*", path, F.col("_metadata.row_index").cast(SEQ).alias("pos_"))
    return stage(scan.select("*", path, position_in_file().alias("pos_")), "first")


def first_dataset(files: list[str]) -> list[str]:
    """The first of the sorted files; if it is a part of a dataset that Spark wrote as a folder ``x.csv``, all its parts."""
    folder = files[0].rpartition("/")[0]
    return [f for f in files if f.rpartition("/")[0] == folder] if folder.lower().endswith(DATA_SUFFIXES) else files[:1]


def load_folder(spark: SparkSession, root: str, all_files: bool = True, max_samples: int = 0, schema=None) -> DataFrame:
    """All files below a folder of the type of its first JSON/JSONL/CSV file, by path; or that file or dataset alone."""
    files = sorted(existing_files(spark, [root], DATA_SUFFIXES))
    if not files:
        raise FileNotFoundError(f"no JSON, JSONL or CSV file below {root}")
    suffix = data_suffix(files[0])
    chosen = reader_paths([f for f in files if data_suffix(f) == suffix] if all_files else first_dataset(files))
    rows = csv.read_csv(spark, chosen, schema) if suffix == ".csv" else _json(spark, chosen, schema)
    return take_first(rows, max_samples)


def load_split(spark: SparkSession, root: str, split: str = "train", max_samples: int = 0) -> DataFrame:
    """One split of a dataset stored in ``split=<name>`` folders; other folders are not read."""
    return take_first(spark.read.parquet(root).filter(F.col("split") == split), max_samples)


def stream_dataset(spark: SparkSession, path: str, fmt: str, schema, **options) -> DataFrame:
    """A lazy load: new files of a folder as a stream. ``max_samples`` does not apply."""
    if fmt not in ("json", "csv", "parquet", "text"):
        raise ValueError(f"unknown stream format: {fmt}")
    reader = spark.readStream.format(fmt).options(**options)
    return (reader if fmt == "text" else reader.schema(schema)).load(path)


# Lines of a stream's first files that decide its types.
LOOK_ROWS = 100_000


def stream_load(
    spark: SparkSession, path: str, fmt: str, checkpoint: str, schema: str | None = None, look_rows: int = LOOK_ROWS, **options,
) -> DataFrame:
    """A typed stream of the CSV or JSON-lines files of a folder: header row, null words and types as in a batch load.

    The types are found in the first ``look_rows`` rows that are there at the first start and kept beside the
    checkpoint, so every later start has the same ones. A later value that does not fit stops the query; give a
    ``schema`` where the first rows do not tell. The same goes for CSV cells that run over line ends.
    """
    if fmt not in ("csv", "json"):
        raise ValueError(f"unknown stream format: {fmt}")
    kept = f"{checkpoint.rstrip('/')}-schema"
    multi_line = False
    try:
        found = spark.read.schema("schema string, multi_line boolean").json(kept).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        found = None
    if found is None:
        if fmt == "csv":
            multi_line = csv.has_quoted_newlines(spark, path)
            if schema is None:
                first = csv.read_strings(spark, path, multi_line).limit(look_rows)
                schema = ", ".join(f"{csv._quoted(n)} {kind}" for n, kind in csv.infer_types(first)[0].items())
        elif schema is None:
            first = work_path(spark, "first-rows")
            spark.read.text(path).limit(look_rows).write.text(first)
            schema = ", ".join(f"{csv._quoted(f.name)} {f.dataType.simpleString()}" for f in spark.read.json(first).schema)
        if not schema:
            raise ValueError(f"no rows to find types in: {path}")
        row = spark.createDataFrame([(schema, multi_line)], "schema string, multi_line boolean")
        row.coalesce(1).write.mode("overwrite").json(kept)
    else:
        schema, multi_line = found["schema"], found["multi_line"]
    if fmt == "json":
        return spark.readStream.options(**options).schema(schema).json(path, mode="FAILFAST")
    cells = spark.readStream.options(**options).schema(csv.string_schema(csv.schema_names(schema))).csv(
        path, header=True, multiLine=multi_line, quote='"', escape='"', mode="FAILFAST", enforceSchema=False)
    return csv.typed(csv.null_words(cells), schema)
