"""Statistics of a dataset: lengths, splits, sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import top_rows


def dataset_stats(samples: DataFrame, name: str, text: str = "text") -> DataFrame:
    """One row with count, average, shortest, longest and total length."""
    n = F.length(text)
    return samples.agg(
        F.count(F.lit(1)).alias("count"),
        (F.sum(n) / F.count(n).cast("double")).alias("avg_length"),
        F.min(n).alias("min_length"),
        F.max(n).alias("max_length"),
        F.sum(n).alias("total_chars"),
    ).select(F.lit(name).alias("name"), F.lit(text).alias("text_column"), "*")


def stats_record(samples: DataFrame, name: str, text: str = "text", top: int = 10) -> DataFrame:
    """``dataset_stats`` with the splits and the largest sources, as one row.

    Split names and the ``top`` sources are what is gathered; both come from aggregates that merge inside map tasks.
    """
    splits = split_histogram(samples.withColumn("split", F.coalesce("split", F.lit("")))).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "samples")))).alias("splits"))
    ranked = top_sources(samples, top).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("samples")).alias("order"), "first_seq", "source", "samples"))).alias("s"))
    ranked = ranked.select(F.transform("s", lambda x: F.struct(x["source"].alias("source"), x["samples"].alias("samples"))).alias("top_sources"))
    # Three rows of one each.
    key = F.lit(1).alias("_one")
    one = dataset_stats(samples, name, text).select("*", key)
    return one.join(splits.select("*", key), "_one").join(ranked.select("*", key), "_one").drop("_one")


def split_histogram(samples: DataFrame) -> DataFrame:
    return samples.groupBy("split").agg(F.count(F.lit(1)).alias("samples"))


def source_histogram(samples: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Rows per source and the position of its first row; a hot source is merged map-side."""
    return samples.groupBy(source).agg(F.count(F.lit(1)).alias("samples"), F.min(seq).alias("first_seq"))


def top_sources(samples: DataFrame, n: int = 10, source: str = "source", seq: str = "seq") -> DataFrame:
    """The largest sources; among equals the one seen first."""
    return top_rows(source_histogram(samples, source, seq), [F.desc("samples"), F.asc("first_seq")], n)
