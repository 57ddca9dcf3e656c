"""Column functions on catalogue rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import shorten

# Fixed value: the address in front of a dataset id.
DATASET_URL = "https://huggingface.co/datasets/"


def author_or_owner(author: Column, dataset_id: Column) -> Column:
    """The author; when missing, the id part before the slash, else empty."""
    owner = F.when(F.contains(dataset_id, F.lit("/")), F.split_part(dataset_id, F.lit("/"), F.lit(1)))
    return F.coalesce(author, owner, F.lit(""))


def first_tags(tags: Column, n: int = 8) -> Column:
    return F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, n)


def dataset_url(dataset_id: Column) -> Column:
    return F.concat(F.lit(DATASET_URL), dataset_id)


def split_names(files: Column) -> Column:
    """Sorted distinct first folders of the file names; ["train"] when there are none."""
    nested = F.filter(files, lambda f: F.contains(f, F.lit("/")))
    names = F.array_sort(F.array_distinct(F.transform(nested, lambda f: F.split_part(f, F.lit("/"), F.lit(1)))))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit("train")))


def summary_line(row_id: Column, downloads: Column, likes: Column, tags: Column, description: Column) -> Column:
    """Three-line description of a catalogue row."""
    shown = F.slice(tags, 1, 5)
    tag_text = F.when(F.size(shown) > 0, F.array_join(shown, ", ")).otherwise(F.lit("—"))
    return F.concat(
        row_id, F.lit("\n  ↓ "), F.format_number(downloads, 0), F.lit("  ❤ "), likes.cast("string"),
        F.lit("  Tags: "), tag_text, F.lit("\n  "), shorten(description, 120),
    )
