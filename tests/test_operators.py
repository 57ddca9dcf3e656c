import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from textloom.operators import clean, order, split, stats


def texts(df):
    return [r.seq for r in df.orderBy("seq").collect()]


def test_dedupe_keeps_the_first(samples):
    rows = samples([(1, "a", "s1"), (2, "b", "s2"), (3, "a", "s3"), (4, "A", "s4")])
    got = clean.dedupe(rows).orderBy("seq").collect()
    assert [(r.seq, r.source) for r in got] == [(1, "s1"), (2, "s2"), (4, "s4")]


def test_dedupe_with_one_text_in_a_third_of_all_rows(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    assert clean.dedupe(rows).count() == 20_001
    hot = clean.dedupe(rows).filter("text = 'hot'").collect()
    assert [r.seq for r in hot] == [0]


def test_dedupe_shuffles_only_narrow_keys(samples):
    """The aggregate sees key and seq and has a map-side part; the texts are never dealt out."""
    rows = samples([(1, "a", "s"), (2, "a", "s"), (3, "b", "s")])
    keys = clean.distinct_texts(clean.text_keys(rows))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in keys and keys.count("partial_min") == 1
    for out in (clean.dedupe(rows), clean.dedupe(rows.unionByName(rows))):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_removed_counts_in_stage_order(samples):
    rows = samples([(1, "ab", "s"), (2, "ab", "s"), (3, "abcdef", "s")])
    got = clean.removed_counts(rows, True, 3, 5).first().asDict()
    assert got == {"total": 3, "duplicates": 1, "too_short": 1, "too_long": 1, "kept": 0}
    got = clean.removed_counts(rows, False, 3, 0).first().asDict()
    assert got == {"total": 3, "too_short": 2, "kept": 1}


def test_length_edges(samples):
    rows = samples([(n, "x" * n, "s") for n in (39, 40, 41)])
    assert texts(clean.length_range(rows, 40)) == [40, 41]
    assert texts(clean.length_range(rows, 0, 40)) == [39, 40]
    assert texts(clean.length_range(rows)) == [39, 40, 41]


@pytest.mark.parametrize("n, ratios, want", [
    (3, (0.9, 0.05, 0.05), (2, 0, 1)),
    (10, (0.9, 0.05, 0.05), (9, 0, 1)),
    (100, (0.9, 0.05, 0.05), (90, 5, 5)),
    (100, (0.29, 0.0, 0.71), (28, 0, 72)),
    (100, (0.9, 0.5, 0.0), (90, 10, 0)),
    (100, (1.5, 0.0, 0.0), (100, 0, 0)),
    (100, (0.0, 0.0, 1.0), (0, 0, 100)),
    (100, (0.0, 1.0, 0.0), (0, 100, 0)),
])
def test_split_counts(spark, n, ratios, want):
    rows = spark.range(n).withColumnRenamed("id", "seq")
    got = {r.split: r.samples for r in stats.split_histogram(split.assign_splits(rows, *ratios)).collect()}
    assert tuple(got.get(k, 0) for k in ("train", "validation", "test")) == want


def test_split_equals_a_global_sort(spark):
    ids = random.Random(1).sample(range(10**9), 5000)
    rows = spark.createDataFrame([(i,) for i in ids], "seq bigint")
    got = {r.seq: r.split for r in split.assign_splits(rows, 0.333, 0.333, 0.334).collect()}
    ranked = sorted(ids, key=lambda i: (hashlib.sha256(f"42:{i}".encode()).hexdigest(), i))
    want = {i: "train" if r < 1665 else "validation" if r < 3330 else "test" for r, i in enumerate(ranked)}
    assert got == want


def test_split_keeps_labels_for_zero_ratios_and_rejects_negative(samples):
    rows = samples([(1, "a", "s")]).withColumn("split", F.lit("mine"))
    assert split.assign_splits(rows, 0, 0, 0).first().split == "mine"
    with pytest.raises(ValueError):
        split.assign_splits(rows, -0.1, 0.5, 0.6)
    assert split.assign_splits(rows.limit(0)).count() == 0


def test_split_moves_no_rows(spark):
    rows = spark.range(1000).withColumnRenamed("id", "seq")
    plan = split.assign_splits(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_stats(samples):
    rows = samples([(1, "ab", "x"), (2, "abcd", "y"), (3, "a", "y"), (4, "😀", "x")])
    got = stats.dataset_stats(rows, "d").first()
    assert (got["count"], got.avg_length, got.min_length, got.max_length, got.total_chars) == (4, 2.0, 1, 4, 8)
    assert stats.dataset_stats(rows.limit(0), "d").first()["count"] == 0
    # Equal counts: the source that came first.
    assert [r.source for r in stats.top_sources(rows).collect()] == ["x", "y"]


def test_first_rows(spark):
    rows = spark.range(1000, 0, -1).withColumnRenamed("id", "seq")
    assert [r.seq for r in order.preview(rows).collect()] == [1, 2, 3, 4, 5]
    assert order.first_rows(rows, 0).count() == 1000
    assert order.first_rows(rows, 2000).count() == 1000


@pytest.mark.parametrize("n", [0, 1, 5, 333, 500, 10**9])
def test_top_rows_without_a_heap(spark, n):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 101).alias("a"), "id")
    asked = [F.desc("a"), F.asc("id")]
    want = sorted(((r.a, r.id) for r in rows.collect()), key=lambda r: (-r[0], r[1]))[:n]
    for heap_rows in (0, 10**4):
        assert [tuple(r) for r in order.top_rows(rows, asked, n, heap_rows).collect()] == want


@pytest.mark.parametrize("n", [1, 2, 777, 1999, 2000])
def test_nth_position(spark, n):
    rng = random.Random(3)
    values = sorted({rng.randrange(10**35) for _ in range(1500)} | set(rng.sample(range(10**4), 501)))
    assert len(values) == 2001
    rows = spark.createDataFrame([(Decimal(v),) for v in values], "seq decimal(38,0)")
    assert order.nth_position(rows, n, merge_rows=5) == values[n - 1]
    assert order.nth_position(rows, 2001) is None


def test_first_rows_by_search(spark):
    rows = spark.range(5000).select((F.col("id") * 7).alias("seq"))
    assert order.first_rows(rows, 1234, merge_rows=10).agg(F.max("seq"), F.count("seq")).first() == (1233 * 7, 1234)


def test_first_rows_with_ties_and_nulls(spark):
    rows = spark.range(300).selectExpr("if(id % 50 = 49, null, id div 3) as seq", "id % 7 as v")
    for n in (1, 2, 10, 100, 294, 295, 300, 400):
        got = {size: sorted(map(str, order.first_rows(rows.repartition(p), n, merge_rows=size).collect())) for size, p in ((2, 1), (100_000, 5))}
        assert got[2] == got[100_000] and len(got[2]) == min(n, 300)
    equal = spark.range(500).selectExpr("1 as seq", "2 as v")
    assert order.first_rows(equal, 123, merge_rows=3).count() == 123


@pytest.mark.parametrize("digits", [0, 1, 4, 6, 9])
def test_nested_bucket_starts(spark, digits):
    keys = spark.range(500).select(F.sha2(F.col("id").cast("string"), 256).alias("key"))
    got = {r["bucket"]: r["start"] for r in split.bucket_starts(keys, digits).collect()}
    hexes = sorted(r["key"] for r in keys.collect())
    want = {}
    for i, k in enumerate(hexes):
        want.setdefault(k[:digits], i)
    assert got == want


@pytest.mark.parametrize("bucket_rows", [1, 7, 10**6])
def test_cuts_of_any_depth(spark, bucket_rows):
    import hashlib

    rows = spark.range(700).withColumnRenamed("id", "seq")
    cuts = split.split_cuts(rows, (0.31, 0.4, 0.29), bucket_rows=bucket_rows)
    order_ = sorted((hashlib.sha256(f"42:{i}".encode()).hexdigest(), i) for i in range(700))
    assert (cuts["train_key"], cuts["train_seq"]) == order_[217 - 1]
    assert (cuts["val_key"], cuts["val_seq"]) == order_[217 + 280 - 1]


def test_cuts_among_repeated_positions(spark):
    rows = spark.range(40).select(F.lit(5).alias("seq"))
    cuts = split.split_cuts(rows, (0.5, 0.5, 0), bucket_rows=1)
    assert cuts["train_seq"] == cuts["val_seq"] == 5
    assert set(split.split_cuts(rows.limit(0)).values()) == {None}
