"""Exact dedup: runs of sorted digests, exchanged and merged in binomial rounds.

Every partition starts with one sorted run of digests. In each round a partition hands its entries to the partners
whose number differs from its own in the next bits (four binomial steps at once, so up to sixteen runs meet), sorts
what it gets by digest, which merges the runs and may spill, and keeps one entry per verified text: the preferred
row and the count. Bits come from the digest, so after the last round each digest is in one place while no task ever
holds more than its share, and a text that makes up a third of all rows sends one entry per run.

A 64-bit digest orders the runs; SHA-256 and byte length verify that entries with equal digests have equal texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import ascii_lower, numbered, shuffle_parts

FAN_BITS = 4
_RUN = "digest bigint, sha binary, n bigint, id bigint, rf bigint, ri bigint, copies bigint, at int, home int"


def _collapse(batches):
    """One row per text of a sorted run: the first one, with the sum of the counts."""
    pending = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if pending is not None:
            table = pa.concat_tables([pending, table])
        table = table.combine_chunks()
        new = np.ones(table.num_rows, bool)
        if table.num_rows > 1:
            differs = None
            for c in ("digest", "sha", "n"):
                col = table.column(c).combine_chunks()
                x = pc.not_equal(col[1:], col[:-1])
                differs = x if differs is None else pc.or_(differs, x)
            new[1:] = np.asarray(differs)
        starts = np.flatnonzero(new)
        counts = np.add.reduceat(np.asarray(table.column("copies")), starts)
        merged = table.take(pa.array(starts))
        merged = merged.set_column(merged.schema.get_field_index("copies"), batch.schema.field("copies"), pa.array(counts))
        pending = merged.slice(len(starts) - 1)
        yield from merged.slice(0, len(starts) - 1).to_batches()
    if pending is not None:
        yield from pending.to_batches()


def _round(runs: DataFrame, parts: int, target: Column, keep: str) -> DataFrame:
    first = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    return (
        runs.withColumn("at", target.cast("int")).repartitionById(parts, F.col("at"))
        .sortWithinPartitions("digest", "sha", "n", first, "rf", "ri").mapInArrow(_collapse, _RUN)
    )


def exact_dedup(
    docs: DataFrame, text: Column | None = None, doc_id: Column | None = None, keep: str = "smallest",
    from_files: bool = False,
) -> DataFrame:
    """Group the rows of ``docs`` by text.

    Returns per row: rf, ri (its identity), doc_id, keep_id, group_size, kept, text_sha256. Texts are equal when they
    are identical after lower-casing A-Z; a null text is an empty one. Of equal texts the row with the smallest (or
    ``keep="largest"``: largest) doc_id stays. A null doc_id comes last; rows with equal texts and ids are told apart
    by their place, so exactly one row of each group has ``kept``. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.col("text") if text is None else text)
    sha = F.unhex(F.sha2(norm, 256))
    bits = max(1, (shuffle_parts(spark) - 1).bit_length())
    parts = 1 << bits
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"), "digest": F.xxhash64(norm), "sha": sha,
        "n": F.octet_length(norm).cast("bigint"),
    }, from_files, "dedup-rows")
    rows = stage(rows.withColumn("home", F.pmod(F.xxhash64("rf", "ri"), F.lit(parts)).cast("int")), "dedup-keys")
    runs = stage(_round(
        rows.select("digest", "sha", "n", "id", "rf", "ri", F.lit(1).cast("bigint").alias("copies"), "home",
                    F.col("home").alias("at")).select("digest", "sha", "n", "id", "rf", "ri", "copies", "at", "home"),
        parts, F.col("home"), keep), "dedup-runs")
    merged = runs
    for done in range(0, bits, FAN_BITS):
        mask = (1 << min(bits, done + FAN_BITS)) - 1
        shard = F.pmod("digest", F.lit(parts))
        merged = _round(merged, parts, F.col("at").bitwiseAND(F.lit(~mask)).bitwiseOR(shard.bitwiseAND(F.lit(mask)).cast("int")), keep)
    groups = merged.filter("copies > 1").select(
        "digest", "sha", "n", F.col("id").alias("g_id"), F.col("rf").alias("g_rf"), F.col("ri").alias("g_ri"),
        F.col("copies").alias("g_size"))
    # Back down: a group meets one entry per run, and each run's entry the rows of its own partition.
    down = runs.select("home", "digest", "sha", "n").join(groups, ["digest", "sha", "n"])
    out = rows.join(down, ["home", "digest", "sha", "n"], "left")
    grouped = F.col("g_size").isNotNull()
    return out.select(
        "rf", "ri", F.col("id").alias("doc_id"), F.when(grouped, F.col("g_id")).otherwise(F.col("id")).alias("keep_id"),
        F.coalesce("g_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(grouped, (F.col("g_rf") == F.col("rf")) & (F.col("g_ri") == F.col("ri"))).otherwise(F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
