"""Reproducible train/validation/test split with exact counts.

Every row has a pseudo-random key, ``sha256("<seed>:<seq>")``. Sorted by key, the
first ``int(n * train)`` rows are train, the next ``int(n * validation)`` are
validation and the rest are test. No row is sorted or shuffled for that: only
the keys of the last train row and the last validation row are searched, and
each row then compares its own key with the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
# Hex digits of the key that are counted at a time: 65,536 buckets at most.
STEP_DIGITS = 4
# A bucket with more rows is divided by further digits.
BUCKET_ROWS = 512
KEY_DIGITS = 64


def order_key(seq: str | Column = "seq", seed: int = SEED) -> Column:
    c = F.col(seq) if isinstance(seq, str) else seq
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")), 256)


def check_ratios(ratios) -> tuple[float, float, float]:
    train, val, test = (float(r) for r in ratios)
    if min(train, val, test) < 0:
        raise ValueError("split ratios must not be negative")
    return train, val, test


def bucket_digits(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Hex digits of even buckets that hold so many rows on average, or fewer."""
    digits = 0
    while rows > bucket_rows * 16 ** digits and digits < KEY_DIGITS:
        digits += 1
    return digits


def bucket_starts(keys: DataFrame, digits: int, key: str = "key") -> DataFrame:
    """``bucket``, the first digits of a hex key, and ``start``, the number of rows with smaller ones."""
    counts = keys.groupBy(F.substring(key, 1, digits).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    return _starts(counts, digits)


def _starts(counts: DataFrame, digits: int) -> DataFrame:
    """Running totals inside each parent bucket of four digits less, on top of the parent's own start.

    No window holds more than 65,536 rows, however deep the buckets are.
    """
    before = F.sum("rows").over(Window.partitionBy("parent").orderBy("bucket")) - F.col("rows")
    inner = counts.withColumn("parent", F.substring("bucket", 1, max(0, digits - STEP_DIGITS))).withColumn("inside", before)
    if digits <= STEP_DIGITS:
        return inner.select("bucket", F.col("inside").alias("start"))
    parents = inner.groupBy("parent").agg(F.sum("rows").alias("rows"))
    outer = _starts(parents.withColumnRenamed("parent", "bucket"), digits - STEP_DIGITS).withColumnRenamed("bucket", "parent")
    return inner.join(outer, "parent").select("bucket", (F.col("start") + F.col("inside")).alias("start"))


def split_cuts(rows: DataFrame, ratios=(0.9, 0.05, 0.05), seq: str = "seq", seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> dict:
    """Key and seq of the last train row and of the last validation row; null where no row belongs to that part.

    The rows are counted, then by bucket of their key; only the one or two buckets with a cut are divided again, until
    each holds no more than ``bucket_rows``. A pass over n rows divides them by 65,536, and hands two rows to the driver.
    """
    train, val, _ = check_ratios(ratios)
    total = rows.count()
    # Double arithmetic, truncated: int(100 * 0.29) is 28.
    wanted = {"train": int(total * train), "val": int(total * train) + int(total * val)}
    parts = {part: ("", total, min(rank, total)) for part, rank in wanted.items() if rank > 0 and total}
    keyed = rows.select(F.col(seq).alias("cut_seq"), order_key(seq, seed).alias("cut_key"))
    depth = 0
    while open_parts := {p: v for p, v in parts.items() if v[1] > bucket_rows and len(v[0]) == depth < KEY_DIGITS}:
        digits = min(STEP_DIGITS, bucket_digits(max(size for _, size, _ in open_parts.values()), bucket_rows))
        parent = F.substring("bucket", 1, depth)
        near = keyed.filter(F.substring("cut_key", 1, depth).isin(*{p for p, _, _ in open_parts.values()})) if depth else keyed
        counts = near.groupBy(F.substring("cut_key", 1, depth + digits).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
        counts = counts.withColumn("upto", F.sum("rows").over(Window.partitionBy(parent).orderBy("bucket")))
        for part, (prefix, _, nth) in open_parts.items():
            counts = counts.withColumn(part, (parent == prefix) & (F.col("upto") - F.col("rows") < nth) & (nth <= F.col("upto")))
        hit = F.lit(False)
        for part in open_parts:
            hit = hit | F.col(part)
        for row in counts.filter(hit).collect():  # a row for each part
            for part, (prefix, _, nth) in open_parts.items():
                if row[part]:
                    parts[part] = (row["bucket"], row["rows"], nth - row["upto"] + row["rows"])
        depth += digits
    cuts = {f"{part}_{name}": None for part in ("train", "val") for name in ("key", "seq")}
    if parts:
        ranked = None
        for part, (prefix, _, nth) in parts.items():
            some = keyed.filter(F.startswith("cut_key", F.lit(prefix))).select(F.lit(part).alias("part"), F.lit(nth).alias("nth"), "cut_key", "cut_seq")
            ranked = some if ranked is None else ranked.union(some)
        place = F.row_number().over(Window.partitionBy("part").orderBy("cut_key", "cut_seq"))
        for row in ranked.withColumn("place", place).filter("place = nth").collect():  # a row for each part
            cuts |= {f"{row['part']}_key": row["cut_key"], f"{row['part']}_seq": row["cut_seq"]}
    return cuts


def label_rows(samples: DataFrame, cuts: dict, seq: str = "seq", seed: int = SEED) -> DataFrame:
    """Set ``split`` by comparing each row's own key with the two cuts."""

    def within(key, last) -> Column:
        if key is None:
            return F.lit(False)
        last = F.lit(last).cast(samples.schema[seq].dataType)
        return (F.col("_key") < key) | ((F.col("_key") == key) & (F.col(seq) <= last))

    label = (
        F.when(within(cuts["train_key"], cuts["train_seq"]), "train")
        .when(within(cuts["val_key"], cuts["val_seq"]), "validation")
        .otherwise("test")
    )
    return samples.withColumn("_key", order_key(seq, seed)).withColumn("split", label).drop("_key")


def assign_splits(
    samples: DataFrame, train: float = 0.9, val: float = 0.05, test: float = 0.05,
    seq: str = "seq", seed: int = SEED, keys: DataFrame | None = None,
) -> DataFrame:
    """Set ``split`` on every row; with three zero ratios keep what is there.

    The search for the cuts runs at once and hands two keys to the driver; the
    wide rows are then labelled by a projection, neither shuffled nor joined.
    Pass ``keys`` (a stored table with the same ``seq`` values) to spare two
    evaluations of ``samples``.
    """
    ratios = check_ratios((train, val, test))
    if sum(ratios) <= 0:
        return samples
    rows = keys if keys is not None else samples.select(seq)
    return label_rows(samples, split_cuts(rows, ratios, seq, seed), seq, seed)
