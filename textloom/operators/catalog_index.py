"""An index for substring search in a catalogue: which rows hold which three characters in a row.

A text that contains a query contains each of its three-character pieces. The index has a row per piece and catalogue
row, sorted by piece, and a row per piece with the number of catalogue rows. A search takes the query's rarest pieces,
finds the few catalogue rows that hold them all, and reads only these; the text itself still decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import broadcast_if_small, remove_staged, stage
from .catalog import search_catalog, with_optional

GRAM = 3
# So many of the query's pieces are looked up, the rarest first.
LOOKED_UP = 3
# Candidate rows up to this number are a filter that Parquet's statistics prune by.
LISTED_ROWS = 1000
# A task stores and cuts up so many catalogue rows, however few files they come from.
TASK_ROWS = 50_000


def _grams(batches):
    """``row`` and each distinct piece of three characters of its texts; a shorter text has none."""
    for batch in batches:
        found, sizes = [], []
        for texts in zip(batch.column("id").to_pylist(), batch.column("description").to_pylist()):
            pieces = {t[i:i + GRAM] for t in texts for i in range(len(t) - GRAM + 1)}
            found.extend(pieces)
            sizes.append(len(pieces))
        rows = np.repeat(batch.column("row").to_numpy(), sizes)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], ["row", "gram"])


def write_index(catalog: DataFrame, path: str, files: int | None = None) -> str:
    """Store a catalogue with its index below ``path``: ``rows``, ``postings`` and ``counts``.

    Postings are dealt by range of piece and row, so a piece that nearly all rows hold is shared out. The catalogue is
    read twice, first to count it.
    """
    spark = catalog.sparkSession
    tasks = -(-catalog.count() // TASK_ROWS)
    catalog = with_optional(catalog)
    if catalog.rdd.getNumPartitions() < tasks:
        catalog = catalog.repartition(tasks)
    catalog.withColumn("row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    lower = lambda c: F.make_valid_utf8(F.lower(F.coalesce(c, F.lit("")))).alias(c)
    paths: list[str] = []
    found = stage(rows.select("row", lower("id"), lower("description")).mapInArrow(_grams, "row bigint, gram string"), "grams", paths)
    dealt = found.repartitionByRange(files, "gram", "row") if files else found.repartitionByRange("gram", "row")
    dealt.sortWithinPartitions("gram", "row").write.mode("overwrite").parquet(f"{path}/postings")
    remove_staged(spark, paths)
    counts = spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/counts")
    return path


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """``row`` of the catalogue rows that hold the query's rarest pieces; None for a query without pieces."""
    word = query.lower()
    wanted = sorted({word[i:i + GRAM] for i in range(len(word) - GRAM + 1)})
    if not wanted:
        return None
    counts = spark.read.parquet(f"{path}/counts").filter(F.col("gram").isin(wanted)).collect()  # a row for each piece
    rarest = [r["gram"] for r in sorted(counts, key=lambda r: (r["rows"], r["gram"]))[:LOOKED_UP]]
    postings = spark.read.parquet(f"{path}/postings")
    if len(counts) < len(wanted):
        return postings.select("row").limit(0)  # some piece stands nowhere
    return postings.filter(F.col("gram").isin(rarest)).groupBy("row").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") == len(rarest)).select("row")


def search_indexed(spark: SparkSession, path: str, query: str = "", **options) -> DataFrame:
    """``search_catalog`` over a stored catalogue; the same rows, but the index tells which are read."""
    catalog = spark.read.parquet(f"{path}/rows")
    found = candidates(spark, path, query)
    if found is not None:
        found = stage(found, "candidates")
        n = found.count()
        if n <= LISTED_ROWS:
            catalog = catalog.filter(F.col("row").isin([r["row"] for r in found.collect()]))
        else:
            catalog = catalog.join(broadcast_if_small(found), "row", "left_semi")
    return search_catalog(catalog.drop("row"), query=query, **options)
