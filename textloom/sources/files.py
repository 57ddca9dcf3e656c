"""Samples from text, Markdown, JSON and JSONL files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LONG_TEXT_CHARS, paragraphs, strip, unix_newlines, valid_text
from ..operators.clean import clean
from ..storage import MAX_BROADCAST_ROWS, broadcast_if_small, stage
from .framing import bracket_index, bracket_step, cut_records, scan_blocks
from .paragraphs import file_facts, join_lines
from .samples import SEQ, packed_seq

# The suffixes that are read, in any case.
TEXT_SUFFIXES = (".txt", ".md", ".markdown")
JSON_SUFFIXES = (".json",)
JSONL_SUFFIXES = (".jsonl",)

# Text files above this size are not held whole.
LARGE_FILE_BYTES = 64 << 20

ROW_DIGITS = 11
BLOCK_DIGITS = 17
FILE_DIGITS = ROW_DIGITS + BLOCK_DIGITS
# monotonically_increasing_id() keeps the row number of a partition in its low bits.
ROW_MASK = (1 << 33) - 1


def plain_path(path: Column) -> Column:
    """One spelling for local paths: file:///x and file:/x are the same file."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def position_in_file() -> Column:
    """Order of a row inside its file, for any splittable file scan.

    Block starts grow inside a file and row numbers grow inside a block, so the
    pair orders the rows however Spark packs blocks into tasks. Only the order is
    fixed, so write the rows (``storage.stage``) before joining on the value.
    """
    return packed_seq(F.col("_metadata.file_block_start"), _row_in_task(), ROW_DIGITS)


def _row_in_task() -> Column:
    return F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK))


def existing_files(spark: SparkSession, paths: Iterable[str], suffixes: tuple[str, ...]) -> list[str]:
    """Files with one of the suffixes, in the order of the caller's list.

    An entry is a file, a folder or a glob; folders are read to any depth and in
    path order. Entries that do not exist are skipped. The list is the one that
    Spark's own file index holds.
    """
    found: dict[str, None] = {}
    for path in [paths] if isinstance(paths, str) else paths:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        try:
            names = reader.load(path).inputFiles()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                continue
            raise
        for name in sorted(names):
            if data_suffix(name) in suffixes:
                found.setdefault(name)
    return list(found)


def data_suffix(name: str) -> str:
    """Suffix that tells the form of a file, in lower case.

    Spark writes a dataset ``x.jsonl`` as a folder whose part files have suffixes
    of their own; there the folder's suffix counts.
    """
    *folders, file = name.lower().split("/")
    for part in (folders[-1] if folders else "", file):
        suffix = "." + part.rpartition(".")[2] if "." in part.lstrip(".") else ""
        if part == file or suffix in JSON_SUFFIXES + JSONL_SUFFIXES + (".csv",):
            return suffix
    return ""


def ranks(files: list[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(files)}


def with_rank(scan: DataFrame, by_name: dict[str, int], path: str = "path") -> DataFrame:
    """Add the place of each row's file as ``file_rank``."""
    table = scan.sparkSession.createDataFrame(list(by_name.items()), "listed string, file_rank bigint")
    table = table.withColumn("listed", plain_path(F.col("listed")))
    if len(by_name) <= MAX_BROADCAST_ROWS // 10:
        table = F.broadcast(table)
    return scan.join(table, scan[path] == table["listed"]).drop("listed")


def reader_paths(names: Iterable[str]) -> list[str]:
    """Reader arguments for listed URIs: decoded, with glob signs taken literally."""
    return [re.sub(r"([\\\[\]{}*?])", r"\\\1", unquote(name)) for name in names]


def _source(path: Column) -> Column:
    """Readable form of the URI in ``_metadata.file_path``."""
    escaped = F.replace(path, F.lit("+"), F.lit("%2B"))
    return F.regexp_replace(F.coalesce(F.try_url_decode(escaped), path), "^file:/+", "/")


def _whole_files(spark: _Reading, by_name: dict[str, int], condition: Column | None = None) -> DataFrame:
    scan = spark.read.text(reader_paths(by_name), wholetext=True)
    if condition is not None:
        scan = scan.filter(condition)
    return with_rank(scan.select("value", plain_path(F.col("_metadata.file_path")).alias("path")), by_name)


def _samples(rows: DataFrame, pos: str, split: str) -> DataFrame:
    return clean(rows.select(
        "text", _source(F.col("path")).alias("source"), F.lit(split).alias("split"),
        packed_seq(F.col("file_rank"), F.col(pos), FILE_DIGITS).alias("seq")))


def read_files(
    spark: SparkSession, paths: Iterable[str], text_column: str = "text", split: str = "", on_bad: str = "skip",
    large_json_bytes: int = LARGE_FILE_BYTES, on_unreadable: str = "error",
) -> DataFrame:
    """Samples from all supported files of a list, each read by its suffix, in list order.

    A record whose text is not a string is bad: ``on_bad="skip"`` drops that
    record, ``"stop_file"`` drops it and the rest of its file. JSON documents above
    ``large_json_bytes`` that are arrays are cut into elements by many tasks. A
    file that cannot be read is an error; ``on_unreadable="skip"`` goes on without
    what cannot be read of it, so a passing fault of the store loses samples too.
    """
    if on_bad not in ("skip", "stop_file"):
        raise ValueError("on_bad must be 'skip' or 'stop_file'")
    if on_unreadable not in ("error", "skip"):
        raise ValueError("on_unreadable must be 'error' or 'skip'")
    by_name = ranks(existing_files(spark, paths, TEXT_SUFFIXES + JSON_SUFFIXES + JSONL_SUFFIXES))

    def some(suffixes):
        return {name: i for name, i in by_name.items() if data_suffix(name) in suffixes}

    parts, reading = [], _Reading(spark, on_unreadable == "skip")
    if some(TEXT_SUFFIXES):
        parts.append(_text_samples(reading, some(TEXT_SUFFIXES), split))
    if some(JSON_SUFFIXES):
        parts.append(_json_samples(reading, some(JSON_SUFFIXES), text_column, split, on_bad, large_json_bytes))
    if some(JSONL_SUFFIXES):
        parts.append(_jsonl_samples(reading, some(JSONL_SUFFIXES), text_column, split, on_bad))
    if not parts:
        return spark.createDataFrame([], f"text string, source string, split string, seq {SEQ}")
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class _Reading:
    """The reader of a session that skips what cannot be read, or does not."""

    spark: SparkSession
    skip: bool

    @property
    def read(self):
        return self.spark.read.option("ignoreCorruptFiles", str(self.skip).lower())


def _text_samples(spark: _Reading, by_name: dict[str, int], split: str) -> DataFrame:
    """One sample per file, or one per paragraph when it is longer than 5000 characters.

    A large file is held whole only if its lines have no more than 5000 characters beside blanks; any other is
    longer than that, so both ways give the same samples. The filters on the size prune the file lists.
    """
    large = F.col("_metadata.file_size") > LARGE_FILE_BYTES
    path = plain_path(F.col("_metadata.file_path")).alias("path")
    scan = spark.read.text(reader_paths(by_name), lineSep="\n").filter(large)
    facts = file_facts(scan.select(path, "value", F.col("_metadata.file_size").alias("file_size"))).collect()  # a row for each large file
    listed = {re.sub("^file:/+", "file:/", name): name for name in by_name}

    def some(condition):
        return {name: by_name[name] for name in (listed[f.path] for f in facts if condition(f))}

    short = some(lambda f: f.chars <= LONG_TEXT_CHARS)
    by_line = some(lambda f: f.chars > LONG_TEXT_CHARS and (f.odd or f.marked))
    by_blank = some(lambda f: f.chars > LONG_TEXT_CHARS and not (f.odd or f.marked))
    whole = _whole_files(spark, by_name, ~large)
    if short:
        whole = whole.unionByName(_whole_files(spark, short))
    whole = whole.select("path", "file_rank", strip(unix_newlines(valid_text(F.col("value")))).alias("body"))
    parts = [whole.select("path", "file_rank", F.posexplode(paragraphs(F.col("body"))).alias("pos", "text"))]
    if by_blank:
        rows = spark.read.text(reader_paths(by_blank), lineSep="\n\n").select(
            path, F.col("value").alias("text"), position_in_file().alias("pos"))
        parts.append(with_rank(rows, by_blank))
    if by_line:
        rows = spark.read.text(reader_paths(by_line)).select(
            path, F.col("_metadata.file_block_start").alias("block"), _row_in_task().alias("row"), "value")
        marked = some(lambda f: f.marked)
        rows = with_rank(rows, {name: int(name in marked) for name in by_line}).withColumnRenamed("file_rank", "marked")
        parts.append(with_rank(join_lines(rows, F.col("marked") == 1).withColumnRenamed("paragraph", "pos"), by_line))
    return reduce(DataFrame.unionByName, [_samples(rows, "pos", split) for rows in parts])


def _json_samples(
    spark: _Reading, by_name: dict[str, int], text_column: str, split: str, on_bad: str, large_bytes: int,
) -> DataFrame:
    """Samples from documents that hold a list of objects or bare values, or one object."""
    stop = on_bad == "stop_file"

    @F.arrow_udf("array<string>")
    def texts(documents: pa.Array) -> pa.Array:
        found = [None if d is None else _document_texts(d, text_column, stop) for d in documents.to_pylist()]
        return pa.array(found, pa.list_(pa.string()))

    def whole(names, condition=None):
        valid = F.when(F.is_valid_utf8("value"), F.col("value"))
        rows = _whole_files(spark, names, condition).select("path", "file_rank", F.posexplode(texts(valid)).alias("pos", "text"))
        return _samples(rows, "pos", split)

    large = F.col("size") > large_bytes
    parts = [whole(by_name, F.col("_metadata.file_size") <= large_bytes)]
    index = stage(bracket_index(scan_blocks(spark, reader_paths(by_name), ",").filter(large)), "brackets")
    if index.count():
        arrays, others = _array_elements(spark, by_name, index, large)
        if others:
            parts.append(whole(others))
        if arrays is not None:
            rows = stage(parse_json_lines(arrays, text_column), "elements")
            wrong = stage(rows.filter("wrong or no_json or broken_bytes").select("path").distinct(), "wrong")
            rows = rows.join(broadcast_if_small(wrong), "path", "left_anti")
            parts.append(_samples(_good_records(rows, on_bad), "pos", split))
    return reduce(DataFrame.unionByName, parts)


# White space of JSON.
_BLANK = " \t\n\r"


def _array_elements(spark: _Reading, by_name: dict[str, int], index: DataFrame, large: Column):
    """Elements of the large documents that are arrays (``path, file_rank, value, pos, wrong``), and the other documents.

    ``wrong`` marks what no document may hold between two commas; no element of such a document counts.
    """
    listed = {re.sub("^file:/+", "file:/", name): name for name in by_name}
    scan = scan_blocks(spark, reader_paths(by_name), ",").filter(large)
    records = cut_records(scan, index.select("path", "block", "inside", "s0", "s1"), bracket_step, ",", 2, "arrays")
    place = F.struct("block", "row")
    facts = stage(records.groupBy("path").agg(
        F.max(place).alias("last"), F.max((F.col("block") == 0) & (F.col("row") == 0) & F.col("record").rlike(r"^[ \t\n\r]*\[")).alias("array"),
    ).join(scan.groupBy("path").agg(F.max("size").alias("size")).join(index.groupBy("path").agg(F.sum("bytes").alias("bytes")), "path"), "path"), "documents")
    kinds = facts.select("path", "array").collect()  # a row for each large document
    others = {listed[r.path]: by_name[listed[r.path]] for r in kinds if not r.array}
    if len(others) == len(kinds):
        return None, others
    first = (F.col("block") == 0) & (F.col("row") == 0)
    rows = records.join(F.broadcast(facts.filter("array")), "path").withColumn("at_end", place == F.col("last"))
    value = F.when(first, F.regexp_replace("record", r"^[ \t\n\r]*\[", "")).otherwise(F.col("record"))
    closed = F.col("record").rlike(r"\][ \t\n\r]*\z")
    value = F.when(F.col("at_end"), F.regexp_replace(value, r"\][ \t\n\r]*\z", "")).otherwise(value)
    rows = rows.withColumn("value", F.btrim(value, F.lit(_BLANK)))
    # A reader that leaves out a byte order mark sees fewer bytes than the file has.
    wrong = (F.col("at_end") & ~closed) | (F.col("value") != strip(F.col("value"))) | (F.col("bytes") < F.col("size")) | F.col("bad")
    empty = F.col("value") == ""
    rows = rows.filter(~(empty & first & F.col("at_end") & ~wrong)).withColumn("wrong", wrong | empty)
    # What is wrong must not be lost as a blank line.
    rows = rows.withColumn("value", F.when(F.col("wrong"), "]").otherwise(F.col("value")))
    rows = rows.withColumn("pos", packed_seq(F.col("block"), F.col("row"), ROW_DIGITS))
    return with_rank(rows.select("path", "value", "pos", "wrong"), by_name), others


def _jsonl_samples(spark: _Reading, by_name: dict[str, int], text_column: str, split: str, on_bad: str) -> DataFrame:
    """Samples from JSON lines; large files are split over tasks.

    Lines that are no JSON are skipped. With ``stop_file`` a file that holds
    invalid UTF-8 is dropped whole.
    """
    scan = spark.read.text(reader_paths(by_name)).select(
        "value", plain_path(F.col("_metadata.file_path")).alias("path"), position_in_file().alias("pos"))
    rows = parse_json_lines(with_rank(scan, by_name), text_column)
    if on_bad == "stop_file":
        rows = stage(rows, "jsonl")
    return _samples(_good_records(rows, on_bad), "pos", split)


def _good_records(rows: DataFrame, on_bad: str) -> DataFrame:
    """Records with a text; with ``stop_file`` only those before the first bad one of their file (staged rows)."""
    if on_bad == "stop_file":
        bad_at = F.when(F.col("broken_bytes"), F.lit(-1).cast(SEQ)).otherwise(F.col("pos"))
        first_bad = stage(rows.filter("bad").groupBy("file_rank").agg(F.min(bad_at).alias("bad_at")), "bad")
        rows = rows.join(broadcast_if_small(first_bad), "file_rank", "left").filter(
            F.col("bad_at").isNull() | (F.col("pos") < F.col("bad_at")))
    return rows.filter("not bad and text is not null")


_END = "#textloom-end#"


def parse_json_lines(rows: DataFrame, text_column: str) -> DataFrame:
    """Add ``text``, ``bad``, ``no_json`` and ``broken_bytes`` to rows of JSON lines in ``value``.

    The common shapes (an object, a bare string) are read as a variant. Spark's
    parser stops at the end of the first value and would accept trailing junk, so
    each line is parsed as ``[line, end mark]`` and the mark has to come second.
    Whatever that does not settle goes to Python's parser; those lines are few.
    """
    line = F.col("_line")
    rows = rows.withColumn("_line", strip(F.col("value"))).filter(F.col("_line") != "")
    rows = rows.withColumn("broken_bytes", ~F.is_valid_utf8("_line"))
    framed = F.concat(F.lit("["), line, F.lit(f',"{_END}"]'))
    # An escaped half of a surrogate pair is legal JSON but no legal text.
    plain = ~F.contains(line, F.lit(_END)) & ~F.col("broken_bytes")
    for half in ("\\ud", "\\uD"):
        plain = plain & ~F.contains(line, F.lit(half))
    rows = rows.withColumn("_v", F.when(plain, F.try_parse_json(framed)))
    rows = rows.withColumn("_v", F.when(F.try_variant_get("_v", "$[1]", "string") == _END, F.col("_v")))
    if any(c in text_column for c in "\"'\\[]"):
        rows = rows.withColumn("_v", F.lit(None).cast("variant"))
        path = '$[0]["text"]'
    else:
        path = f'$[0]["{text_column}"]'
    rows = rows.withColumn("_field", F.try_variant_get("_v", path, "variant"))
    rows = rows.withColumn("_type", F.schema_of_variant("_field"))
    rows = rows.withColumn(
        "_kind",
        F.when(F.col("_v").isNotNull() & F.startswith(line, F.lit("{")),
               F.when(F.col("_field").isNull(), "missing").when(F.col("_type") == "STRING", "text").otherwise("bad"))
        .when(F.col("_v").isNotNull() & F.startswith(line, F.lit('"')), "bare"))

    @F.arrow_udf("text string, bad boolean")
    def exact(lines: pa.Array) -> pa.Array:
        found = [_line_text(v, text_column) for v in lines.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([t for t, _ in found], pa.string()), pa.array([b for _, b in found], pa.bool_())], ["text", "bad"])

    rows = rows.withColumn("_exact", exact(F.when(F.col("_kind").isNull() & ~F.col("broken_bytes"), line)))
    text = (
        F.when(F.col("_kind") == "text", F.try_variant_get("_field", "$", "string"))
        .when(F.col("_kind") == "bare", F.try_variant_get("_v", "$[0]", "string"))
        .when(F.col("_kind").isNull(), F.col("_exact.text"))
    )
    bad = F.col("broken_bytes") | F.coalesce(F.col("_kind") == "bad", F.col("_exact.bad"), F.lit(False))
    # Unfolding a one-element array keeps later filters above the parsing; pushed
    # below, they would parse every line again.
    kept = [c for c in rows.columns if not c.startswith("_") and c != "value"]
    no_json = F.col("_kind").isNull() & ~F.col("broken_bytes") & F.col("_exact.text").isNull() & ~F.coalesce(F.col("_exact.bad"), F.lit(False))
    return rows.select(*kept, F.inline(F.array(F.struct(text.alias("text"), bad.alias("bad"), no_json.alias("no_json")))))


class BadRecord(Exception):
    """A record without a text that can be stored."""


def _record_text(value, field: str) -> str:
    """The text that a parsed JSON value stands for.

    Records give their field, or an empty text without it; any other value stands for itself as Python writes it.
    What is no string, or holds half of a surrogate pair, cannot be stored.
    """
    match value:
        case {**record}:
            found = record[field] if field in record else ""
        case str():
            found = value
        case _:
            found = str(value)
    if type(found) is not str or any("\ud800" <= c <= "\udfff" for c in found):
        raise BadRecord
    return found


def _line_text(line, text_column: str):
    """(text, bad) of one line; (None, False) when it is no JSON."""
    if line is None:
        return None, False
    try:
        item = json.loads(line)
    except json.JSONDecodeError:
        return None, False
    except (RecursionError, ValueError):
        return None, True
    try:
        return _record_text(item, text_column), False
    except BadRecord:
        return None, True


def _document_texts(document: str, text_column: str, stop: bool) -> list[str]:
    try:
        data = json.loads(document)
    except (ValueError, RecursionError):
        return []
    if isinstance(data, dict):
        items = [data] if text_column in data else []
    else:
        items = data if isinstance(data, list) else []
    texts = []
    for item in items:
        try:
            texts.append(_record_text(item, text_column))
        except BadRecord:
            if stop:
                break
    return texts
