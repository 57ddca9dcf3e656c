"""Samples from tables and lists, and the ordered union of several inputs.

A sample row is ``text, source, split, seq``. ``seq`` carries the insertion order
that Spark rows do not have. Tables bring it as an id column; files and exploded
texts get a decimal(38,0) made of (place of the parent, place inside it).
"""

from __future__ import annotations

import re
from decimal import Decimal
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import lines
from ..operators.clean import clean
from ..storage import MAX_BROADCAST_ROWS

SEQ = "decimal(38,0)"
# Digits of the inner part of a packed ``seq``.
INSIDE_DIGITS = 10


def packed_seq(parent: Column, inside: Column, digits: int = INSIDE_DIGITS) -> Column:
    """parent * 10^digits + inside; an inner part that is negative or exceeds its digits is an error, as it would
    collide with its neighbour's."""
    shift = F.lit("1" + "0" * digits).cast(SEQ)
    packed = ((parent.cast(SEQ) * shift).cast(SEQ) + inside.cast(SEQ)).cast(SEQ)
    bad = (inside.cast(SEQ) < 0) | (inside.cast(SEQ) >= shift)
    return F.when(bad, F.raise_error(F.lit(f"a position exceeds its {digits} digits")).cast(SEQ)).otherwise(packed)


def from_table(
    table: DataFrame, text_column: str = "text", source: str | Column = "manual", split: str | Column = "",
    seq: str | Column = "seq",
) -> DataFrame:
    """Samples from one text column of any table; other columns are pruned from the scan.

    A string ``source`` or ``split`` is a constant; pass a column to read it. A
    table without the text column gives empty texts and therefore no samples.
    """
    text = F.coalesce(F.col(text_column), F.lit("")) if text_column in table.columns else F.lit("")
    rows = table.select(
        text.alias("text"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (F.lit(split) if isinstance(split, str) else split).alias("split"),
        (F.col(seq) if isinstance(seq, str) else seq).alias("seq"),
    )
    return clean(rows)


def from_texts(spark: SparkSession, texts: list[str], source: str = "manual", split: str = "") -> DataFrame:
    """Samples from a list that the caller holds, in list order."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("seq", T.LongType())])
    table = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], schema)
    return from_table(table, source=source, split=split)


def from_lines(
    table: DataFrame, text_column: str = "text", source: str | Column = "text-input", split: str | Column = "",
    seq: str | Column = "seq",
) -> DataFrame:
    """One sample per non-blank line of a text column."""
    rows = table.select(
        (F.col(seq) if isinstance(seq, str) else seq).alias("parent"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (F.lit(split) if isinstance(split, str) else split).alias("split"),
        F.posexplode(lines(F.col(text_column))).alias("pos", "text"),
    )
    return rows.select("text", "source", "split", packed_seq(F.col("parent"), F.col("pos")).alias("seq"))


def ingest(inputs: list[tuple[str, DataFrame]]) -> DataFrame:
    """All rows of several inputs, the first input first.

    Each entry is (kind, samples); the kind is kept as ``input_kind``. The numbers of each input are moved behind the
    largest one so far, so the order inside an input stays, no two inputs share a number, and the range of the result
    is the sum of theirs: ingests of ingests and any number of inputs fit. The ends of the ranges are found in one
    job over the ``seq`` columns. ``seq`` must be stored or otherwise repeatable. An input that is given several times
    is read once; many stored tables go by ``ingest_tables``.
    """
    if not inputs:
        raise ValueError("no input given")
    distinct: list[DataFrame] = []
    by_hash: dict[int, list[int]] = {}
    chosen = []
    for _, samples in inputs:
        same = by_hash.setdefault(samples.semanticHash(), [])
        found = next((k for k in same if distinct[k].sameSemantics(samples) and distinct[k].columns == samples.columns), None)
        if found is None:
            found = len(distinct)
            same.append(found)
            distinct.append(samples)
        chosen.append(found)
    ends = [
        samples.agg(F.lit(k).alias("k"), F.min("seq").cast(SEQ).alias("low"), F.max("seq").cast(SEQ).alias("high"))
        for k, samples in enumerate(distinct)
    ]
    found = {r["k"]: r for r in _union(ends).collect()}  # a row for each input
    moves = _moves([(found[k]["low"], found[k]["high"]) for k in chosen])
    parts = []
    for k, samples in enumerate(distinct):
        places = F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.lit(move).cast(SEQ).alias("move"))
            for (kind, _), of, move in zip(inputs, chosen, moves) if of == k])
        rows = samples.select("text", "source", "split", F.col("seq").cast(SEQ).alias("seq"), F.explode(places).alias("at"))
        parts.append(rows.select(
            F.col("at.kind").alias("input_kind"), "text", "source", "split", (F.col("seq") + F.col("at.move")).cast(SEQ).alias("seq")))
    return _union(parts)


def _moves(ranges) -> list[Decimal]:
    """What is added to the numbers of each input; an input without rows has no range."""
    moves, base = [], 0
    for low, high in ranges:
        moves.append(Decimal(base - int(low or 0)))
        if low is not None:
            base += int(high) - int(low) + 1
    return moves


def ingest_tables(
    spark: SparkSession, inputs: list[tuple[str, str]], text_column: str = "text", source: str = "manual", seq: str = "seq",
) -> DataFrame:
    """``ingest`` of stored Parquet tables, (kind, path) each, by one scan over all paths.

    Which inputs a file belongs to comes from a table of the files, so the plan does not grow with the inputs. A path
    may come several times; its files are read once. The tables need the columns ``text_column`` and ``seq``.
    """
    if not inputs:
        raise ValueError("no input given")
    roots = {path: _qualified(spark, path) for _, path in inputs}
    scan = spark.read.parquet(*dict.fromkeys(roots.values()))
    of_root: dict[str, list[str]] = {}
    for name in scan.inputFiles():
        plain = re.sub("^file:/+", "file:/", unquote(name))
        parts = plain.split("/")
        for n in range(len(parts), 0, -1):
            of_root.setdefault("/".join(parts[:n]), []).append(re.sub("^file:/+", "file:/", name))
    entries = [(file, rank) for rank, (_, path) in enumerate(inputs) for file in of_root.get(roots[path], [])]
    file = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("file")
    table = spark.createDataFrame(pa.table({"file": [f for f, _ in entries], "rank": pa.array([r for _, r in entries], pa.int32())}))

    def with_inputs(rows, more):
        return rows.join(F.broadcast(more) if len(entries) <= MAX_BROADCAST_ROWS // 10 else more, "file")

    position = F.col(seq).cast(SEQ).alias("seq")
    ends = with_inputs(scan.select(file, position).groupBy("file").agg(F.min("seq").alias("low"), F.max("seq").alias("high")), table)
    found = {r["rank"]: r for r in ends.groupBy("rank").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}  # a row for each input
    moves = _moves([(found[r]["low"], found[r]["high"]) if r in found else (None, None) for r in range(len(inputs))])
    places = spark.createDataFrame(pa.table({
        "rank": pa.array(range(len(inputs)), pa.int32()), "input_kind": [k for k, _ in inputs],
        "move": pa.array([str(m) for m in moves])})).withColumn("move", F.col("move").cast(SEQ))
    rows = clean(scan.select(
        file, F.coalesce(text_column, F.lit("")).alias("text"), F.lit(source).alias("source"), F.lit("").alias("split"), position))
    rows = with_inputs(rows, table.join(F.broadcast(places), "rank"))
    return rows.select("input_kind", "text", "source", "split", (F.col("seq") + F.col("move")).cast(SEQ).alias("seq"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The full form of a path, as the names of its files begin."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return re.sub("^file:/+", "file:/", full)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union by name, as a balanced tree: a long chain would make a deep plan."""
    while len(parts) > 1:
        parts = [a.unionByName(b[0]) if b else a for a, b in ((parts[i], parts[i + 1:i + 2]) for i in range(0, len(parts), 2))]
    return parts[0]


def ingest_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("input_kind").agg(F.count(F.lit(1)).alias("accepted"))
