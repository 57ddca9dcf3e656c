"""Search, detail and split listing on a dataset catalogue.

A catalogue row is ``id, author, downloads, likes, tags, description, trending,
lastModified, createdAt, siblings``; all but the id may be missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import author_or_owner, dataset_url, first_tags, split_names, summary_line
from ..functions.text import shorten
from .order import top_rows

# Sort columns.
SORT_COLUMNS = ("downloads", "likes", "trending", "lastModified", "createdAt")
_OPTIONAL = {
    "author": "string", "downloads": "bigint", "likes": "bigint", "tags": "array<string>", "description": "string",
    "trending": "double", "lastModified": "timestamp", "createdAt": "timestamp",
    "siblings": "array<struct<rfilename:string>>",
}


def with_optional(catalog: DataFrame) -> DataFrame:
    """The catalogue with every optional column; those it lacks are null."""
    missing = {c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in catalog.columns}
    return catalog.withColumns(missing) if missing else catalog


def filter_catalog(catalog: DataFrame, query: str = "", task: str = "", language: str = "", author: str = "") -> DataFrame:
    """Rows that meet all given filters; a blank filter is off.

    ``query`` is searched in id and description without regard to case; task and
    language are tags, plain or with the prefix ``task_categories:`` / ``language:``.
    """
    catalog = with_optional(catalog)
    if query:
        word = F.lit(query.lower())
        where = F.contains(F.lower("id"), word) | F.contains(F.lower(F.coalesce("description", F.lit(""))), word)
        catalog = catalog.filter(where)
    for name, value in (("task_categories", task), ("language", language)):
        if value:
            catalog = catalog.filter(F.arrays_overlap("tags", F.array(F.lit(value), F.lit(f"{name}:{value}"))))
    if author:
        catalog = catalog.filter(author_or_owner(F.col("author"), F.col("id")) == author)
    return catalog


def search_catalog(
    catalog: DataFrame, query: str = "", sort: str = "downloads", direction: int = -1, limit: int | None = 30,
    task: str = "", language: str = "", author: str = "", max_results: int | None = None,
) -> DataFrame:
    """The best matches as a top-n over the filtered rows; ties go by id.

    Without a limit (None) all matches come, sorted. ``max_results`` bounds the limits that callers may ask for; by
    default none does.
    """
    if sort not in SORT_COLUMNS:
        raise ValueError(f"unknown sort: {sort}; use one of {', '.join(SORT_COLUMNS)}")
    if int(direction) not in (-1, 1):
        raise ValueError("direction must be -1 or 1")
    rows = filter_catalog(catalog, query, task, language, author)
    order = F.desc(sort) if int(direction) == -1 else F.asc(sort)
    limits = [max(0, int(n)) for n in (limit, max_results) if n is not None]
    order = [order, F.asc("id")]
    top = top_rows(rows, order, min(limits)) if limits else rows.orderBy(*order)
    return top.select(
        "id", author_or_owner(F.col("author"), F.col("id")).alias("author"),
        F.coalesce("downloads", F.lit(0)).cast("bigint").alias("downloads"),
        F.coalesce("likes", F.lit(0)).cast("bigint").alias("likes"),
        first_tags(F.col("tags")).alias("tags"),
        F.coalesce("description", F.lit("")).alias("description"),
        dataset_url(F.col("id")).alias("url"),
    )


def compact_results(results: DataFrame, description_chars: int = 200) -> DataFrame:
    """Results for a list view: five tags and a cut description."""
    return results.withColumn("tags", first_tags(F.col("tags"), 5)).withColumn(
        "description", shorten(F.col("description"), description_chars, ""))


def summaries(results: DataFrame) -> DataFrame:
    line = summary_line(*[F.col(c) for c in ("id", "downloads", "likes", "tags", "description")])
    return results.select("id", line.alias("summary"))


def dataset_detail(catalog: DataFrame, dataset_id: str) -> DataFrame:
    """The detail row of one dataset id."""
    return dataset_details(catalog.filter(F.col("id") == dataset_id))


def dataset_details(catalog: DataFrame) -> DataFrame:
    """Detail rows: defaults for missing fields and the number of files."""
    catalog = with_optional(catalog)
    no_tags = F.array().cast("array<string>")
    return catalog.select(
        "id", F.coalesce("author", F.lit("")).alias("author"),
        F.coalesce("downloads", F.lit(0)).cast("bigint").alias("downloads"),
        F.coalesce("likes", F.lit(0)).cast("bigint").alias("likes"),
        F.coalesce("tags", no_tags).alias("tags"),
        F.coalesce("description", F.lit("")).alias("description"),
        dataset_url(F.col("id")).alias("url"),
        F.greatest(F.size(F.coalesce("siblings", F.array().cast(catalog.schema["siblings"].dataType))), F.lit(0))
        .alias("siblings_count"),
    )


def list_splits(catalog: DataFrame) -> DataFrame:
    """Split names per catalogue row, from its own file list: a projection without shuffle."""
    catalog = with_optional(catalog)
    names = F.coalesce(F.col("siblings.rfilename"), F.array().cast("array<string>"))
    return catalog.select("id", split_names(names).alias("splits"))


def list_splits_of_files(files: DataFrame) -> DataFrame:
    """Split names from a flat table ``id, rfilename``, one row per name.

    Both aggregates merge inside the map tasks, so a dataset that owns a third
    of all files sends only its distinct folder names.
    """
    nested = F.contains("rfilename", F.lit("/"))
    named = files.filter(nested).select("id", F.split_part("rfilename", F.lit("/"), F.lit(1)).alias("split")).distinct()
    flat = files.groupBy("id").agg(F.bool_or(F.coalesce(nested, F.lit(False))).alias("any"))
    return named.unionByName(flat.filter(~F.col("any")).select("id", F.lit("train").alias("split")))
