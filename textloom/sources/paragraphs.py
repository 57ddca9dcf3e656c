"""Paragraphs of text files that are too large to hold whole.

One pass over the lines of such files tells how to read each. Nearly all are read with the blank line as record
separator, split over tasks like any text file. Files with other line ends, broken bytes or a byte order mark are read
by line; the lines of a block are grouped at its empty lines, and then the groups that go on in a later block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip, valid_text
from ..storage import stage

BYTE_ORDER_MARK = "\ufeff"


def file_facts(lines: DataFrame) -> DataFrame:
    """Per file of a scan by ``\\n`` with ``path, value, file_size``: ``chars``, ``marked``, ``odd``.

    ``chars`` are the characters of all lines stripped, at most as many as the stripped file has. The reader leaves
    out a byte order mark, so such a file is longer than its lines.
    """
    value = F.col("value")
    size = F.sum(F.octet_length(value) + 1)
    return lines.groupBy("path").agg(
        F.sum(F.length(strip(valid_text(value)))).alias("chars"), (size < F.max("file_size")).alias("marked"),
        F.max(F.contains(value, F.lit("\r")) | ~F.is_valid_utf8(value)).alias("odd"))


def join_lines(lines: DataFrame, marked: Column) -> DataFrame:
    """``path, paragraph, text`` of a scan with ``path, block, row, value``; ``marked`` tells files with a byte order mark.

    Lines are dealt by block, so a file without any empty line is shared out as well until its one text is built.
    """
    block = Window.partitionBy("path", "block").orderBy("row")
    first = (F.col("block") == 0) & (F.row_number().over(block) == 1)
    line = F.concat(F.when(first & marked, BYTE_ORDER_MARK).otherwise(""), valid_text(F.col("value")))
    lines = lines.select("path", "block", "row", line.alias("line"))
    lines = lines.withColumn("part", F.count_if(F.col("line") == "").over(block))
    full = F.when(F.col("line") != "", F.struct("row", "line"))
    parts = stage(lines.groupBy("path", "block", "part").agg(
        F.array_join(F.array_sort(F.collect_list(full))["line"], "\n").alias("text")), "paragraphs")
    # One row for each block: the empty lines before it.
    before = F.sum("empty").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = parts.groupBy("path", "block").agg(F.max("part").alias("empty")).withColumn("before", F.coalesce(before, F.lit(0)))
    numbered = parts.filter(F.col("text") != "").join(blocks, ["path", "block"]).withColumn("paragraph", F.col("before") + F.col("part"))
    pieces = F.array_sort(F.collect_list(F.struct("block", "text")))
    return numbered.groupBy("path", "paragraph").agg(F.array_join(pieces["text"], "\n").alias("text"))
