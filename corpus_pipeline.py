"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes a table with the columns of documents, a plain scan of Parquet files, and works on all its rows; its
result is written and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import quality
from textloom.llm.common import MAX_BROADCAST_ROWS, numbered, pick_rows
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.mixing import mix
from textloom.llm.packing import pack
from textloom.llm.queries import MAX_BITS, SHINGLE
from textloom.llm.simhash import simhash_components
from textloom.storage import stage

# SQL has neither a conditional random field nor a linear program; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules or hold too little content. The field learns from the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.line_quality(docs, quality.fit(docs, labels)).filter("kept").select("doc.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the one with the largest doc_id."""
    rows = exact_dedup(docs, keep="largest", from_files=True)
    return pick_rows(docs, rows.filter("kept"), "pipeline-kept")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints keep the smallest doc_id; of repeated ids, the first row."""
    rows = stage(simhash_components(docs, SHINGLE, MAX_BITS, from_files=True), "pipeline-components")
    place = F.struct("rf", "ri")
    lowest = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(place).alias("first"))
    return pick_rows(docs, lowest.select("first.*"), "pipeline-lowest")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their target weights."""
    rows = stage(mix(docs, from_files=True).filter("copies > 0").select("rf", "ri", "copies"), "pipeline-copies")
    rows = F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows
    whole = numbered(docs, {"doc": F.struct(*[docs[f"`{c}`"] for c in docs.columns])}, True, "pipeline-docs")
    return whole.join(rows, ["rf", "ri"]).select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, from_files=True)


STAGES = [
    ("quality rules", quality_rules), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
