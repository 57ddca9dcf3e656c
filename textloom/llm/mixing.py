"""Mixing sources to target weights: min-cost flow for overlapping sources.

Documents are aggregated by their pattern of sources. The driver sees one row for each pattern, routes the patterns'
words to the sources' quotas by min-cost flow, where each further repetition of a pattern costs more than the one
before, and each connected part of the graph is solved alone. A seeded order then selects documents: all of a pattern
for its full repetitions, the first ones of the order for the rest. Places in the order come from sums over hash
buckets, run up in two levels, and a running sum inside each bucket, so a source that holds a third of all rows is ordered by all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage
from .common import numbered, running_before
from .min_cost_flow import min_cost_flow

WORDS = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 2
BUCKET_ROWS = 2_000
#: Distinct patterns that the driver takes; about 100 bytes each.
MAX_PATTERNS = 1_000_000


def targets(sizes: dict, weights=(3, 1, 2), share=(3, 2), max_repeats: int = MAX_REPEATS) -> dict:
    """Target words of each source: ``share`` (a fraction) of all words by weight, none above ``max_repeats`` of its own.

    Sources are in code-point order, null last, with the weights in turn. What a source can't take is shared again by
    weight among the others.
    """
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    top, bottom = share
    total, rest = top * sum(sizes.values()), sum(weight.values())  # in units of 1 / bottom
    out, used = {}, 0
    by_limit = sorted(names, key=lambda s: sizes[s] / weight[s])
    for i, s in enumerate(by_limit):
        limit = max_repeats * sizes[s]
        if (total - bottom * used) * weight[s] <= bottom * limit * rest:
            for x in by_limit[i:]:
                out[x] = (total / bottom - used) * weight[x] / rest
            break
        out[s] = float(limit)
        used += limit
        rest -= weight[s]
    return out


def route(patterns: list[tuple[tuple, int]], quotas: dict, max_repeats: int) -> list[dict]:
    """For each (sources, words) the words that go to each source."""
    group: dict = {}

    def root(s):
        while group.setdefault(s, s) != s:
            group[s] = s = group[group[s]]
        return s

    for sources, _ in patterns:
        for s in sources[1:]:
            group[root(s)] = root(sources[0])
    parts: dict = {}
    for i, (sources, _) in enumerate(patterns):
        if sources:
            parts.setdefault(root(sources[0]), []).append(i)
    flows: list[dict] = [{} for _ in patterns]
    for members in parts.values():
        edges, meaning = [], []
        for i in members:
            sources, words = patterns[i]
            for k in range(max_repeats):
                edges.append(("in", ("p", i), words, k * k))
                meaning.append(None)
            for s in sources:
                edges.append((("p", i), ("s", s), words * max_repeats, 0))
                meaning.append((i, s))
        for s in dict.fromkeys(s for i in members for s in patterns[i][0]):
            edges.append((("s", s), "out", int(quotas.get(s, 0)), 0))
            meaning.append(None)
        for m, f in zip(meaning, min_cost_flow(edges, "in", "out")):
            if m and f:
                flows[m[0]][m[1]] = f
    return flows


def mix(
    docs: DataFrame, sources: Column | None = None, size: Column | None = None, doc_id: Column | None = None,
    quota_of=targets, max_repeats: int = MAX_REPEATS, seed: str = "mix", from_files: bool = False,
) -> DataFrame:
    """Per row of ``docs``: rf, ri (its identity), doc_id, size, sources, source_sizes, targets, copies, taken, taken_for.

    ``sources`` is an array (by default of the column source alone; a null source is a source, a null or empty array
    belongs nowhere and is not taken); ``size`` defaults to the words of text, null for none. ``quota_of`` gives the
    target of each source from the sizes of all. A document is taken whole, ``copies`` times; taken_for names the
    source that each copy serves. Those of size zero are taken zero times. The order is by md5 of seed and doc_id, then
    by place for repeated ids, so reruns agree. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"),
        "pattern": F.array_sort(F.array_distinct(F.coalesce(F.array("source") if sources is None else sources, F.array().cast("array<string>")))),
        "size": F.regexp_count("text", F.lit(WORDS)) if size is None else size,
    }, from_files, "mix-rows")
    rows = stage(rows.withColumn("size", F.coalesce("size", F.lit(0)).cast("bigint"))
                 .withColumn("order", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))), "mix-sizes")
    known = rows.groupBy("pattern").agg(F.sum("size").alias("words"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(known) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns = sorted(((tuple(r.pattern), r.words) for r in known), key=lambda p: [(s is None, s or "") for s in p[0]])
    sizes: dict = {}
    for own, words in patterns:
        for s in own:
            sizes[s] = sizes.get(s, 0) + words
    quotas = quota_of(sizes)
    flows = route(patterns, {s: int(t) for s, t in quotas.items()}, max_repeats)
    solved = []
    for (own, words), flow in zip(patterns, flows):
        ends, total, serve = [], 0, []
        for s in own:
            if flow.get(s):
                total += flow[s]
                ends.append(total)
                serve.append(s)
        solved.append((list(own), words, total, ends, serve, [sizes[s] for s in own], [float(quotas.get(s, 0)) for s in own]))
    plan = spark.createDataFrame(
        solved, "pattern array<string>, words bigint, flow bigint, ends array<bigint>, serve array<string>, "
        "source_sizes array<bigint>, targets array<double>")
    total_rows = sum(r.n for r in known)
    bits = max(4, min(28, (total_rows // BUCKET_ROWS).bit_length()))
    rows = rows.withColumn("bucket", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint"), 32 - bits))
    sums = stage(rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    starts = running_before(sums, ["pattern"], "bucket", "words", "before").select("pattern", "bucket", "before")
    inside = Window.partitionBy("pattern", "bucket").orderBy("order", "rf", "ri").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, ["pattern", "bucket"]).join(plan, "pattern")
        .withColumn("place", F.col("before") + F.col("inner"))
    )
    # Copy k of a document lies at k * words + place on the pattern's line; it is taken if its middle is within the flow.
    middle = lambda k: 2 * (k * F.col("words") + F.col("place")) + F.col("size")
    copies = sum(((F.col("size") > 0) & (middle(k) <= 2 * F.col("flow"))).cast("int") for k in range(max_repeats))
    serves = F.transform(
        F.filter(F.array(*[middle(k) for k in range(max_repeats)]), lambda m: (F.col("size") > 0) & (m <= 2 * F.col("flow"))),
        lambda m: F.element_at("serve", (F.size(F.filter("ends", lambda e: 2 * e < m)) + 1).cast("int")))
    return placed.select(
        "rf", "ri", F.col("id").alias("doc_id"), "size", F.col("pattern").alias("sources"), "source_sizes", "targets",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"), serves.alias("taken_for"))
