"""Strip, length filters, exact dedupe and the counts of removed samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_key, strip
from .. import storage
from ..storage import keep_rows, stage, stage_rows


def clean(samples: DataFrame, text: str = "text") -> DataFrame:
    """Strip every text and drop the empty ones.

    Unfolding a one-element array keeps this filter and later ones above the stripping; pushed below, each of them
    would strip every text again.
    """
    others = [c for c in samples.columns if c != text]
    once = samples.select(*others, F.inline(F.array(F.struct(strip(F.col(text)).alias(text)))))
    return once.select(*samples.columns).filter(F.col(text) != "")


def min_length(samples: DataFrame, chars: int, text: str = "text") -> DataFrame:
    return samples.filter(F.length(text) >= chars)


def max_length(samples: DataFrame, chars: int, text: str = "text") -> DataFrame:
    return samples.filter(F.length(text) <= chars)


def length_range(samples: DataFrame, min_chars: int = 0, max_chars: int = 0, text: str = "text") -> DataFrame:
    """Both length filters; a bound of 0 or less is off."""
    if min_chars > 0:
        samples = min_length(samples, min_chars, text)
    if max_chars > 0:
        samples = max_length(samples, max_chars, text)
    return samples


def distinct_texts(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per text: first position, number of copies, length.

    ``rows`` holds ``seq``, ``key`` (content key) and ``n`` (length). All buffers
    are fixed width, so this is a hash aggregate that first merges copies inside
    each map task: a text that makes up a third of all rows sends one row per
    task through the shuffle.
    """
    return rows.groupBy("key").agg(
        F.min(seq).alias(seq), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n")
    )


def key_columns(text: str = "text") -> list[Column]:
    """Content key and length of a text."""
    return [content_key(F.col(text)).alias("key"), F.length(text).alias("n")]


def text_keys(samples: DataFrame, text: str = "text", seq: str = "seq", keep: tuple[str, ...] = ()) -> DataFrame:
    """The narrow form of the samples that dedupe, counts and splits work on."""
    return samples.select(seq, *key_columns(text), *keep)


def dedupe(samples: DataFrame, text: str = "text", seq: str = "seq") -> DataFrame:
    """Keep the first row of each distinct text, with its own source and split.

    ``seq`` must be stored or otherwise repeatable, because the samples are read
    twice: once for the keys, which are staged, and once for the output. No text
    moves: the smaller side, copies or survivors, is broadcast when its counted
    size allows; beyond that the samples are written once by the tasks that read
    them, and each task looks its rows up in its own set of positions.
    """
    rows = stage(text_keys(samples, text, seq), "keys")
    first = stage(distinct_texts(rows, seq).select(seq), "first")
    kept = first.count()
    copies = rows.count() - kept
    if not copies:
        return samples
    if copies <= min(kept, storage.MAX_BROADCAST_ROWS):
        dropped = stage(rows.select(seq).join(first, seq, "left_anti"), "copies")
        return samples.join(F.broadcast(dropped), seq, "left_anti")
    if kept <= storage.MAX_BROADCAST_ROWS:
        return samples.join(F.broadcast(first), seq, "left_semi")
    return keep_rows(stage_rows(samples, "samples"), first, seq)


def removed_counts(
    samples: DataFrame, drop_duplicates: bool = True, min_chars: int = 0, max_chars: int = 0,
    text: str = "text", seq: str = "seq",
) -> DataFrame:
    """One row: samples removed by each stage that is on, and samples left.

    Duplicates go first, so a short duplicate counts as a duplicate. Only the
    narrow keys are shuffled.
    """
    return count_removed(text_keys(samples, text, seq), drop_duplicates, min_chars, max_chars, seq)


def count_removed(
    rows: DataFrame, drop_duplicates: bool, min_chars: int, max_chars: int, seq: str = "seq",
) -> DataFrame:
    if drop_duplicates:
        rows = distinct_texts(rows, seq) if "copies" not in rows.columns else rows
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("bigint"))
    short = F.col("n") < min_chars if min_chars > 0 else F.lit(False)
    long = F.col("n") > max_chars if max_chars > 0 else F.lit(False)

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    out = [total(F.col("copies")).alias("total")]
    if drop_duplicates:
        out.append(total(F.col("copies") - 1).alias("duplicates"))
    if min_chars > 0:
        out.append(F.count_if(short).alias("too_short"))
    if max_chars > 0:
        out.append(F.count_if(~short & long).alias("too_long"))
    out.append(F.count_if(~short & ~long).alias("kept"))
    return rows.agg(*out)
