import random

from pyspark.sql import functions as F

from textloom.llm.min_cost_flow import min_cost_flow
from textloom.llm.mixing import mix, route, targets


def test_flow_prefers_cheap_edges():
    edges = [("s", "a", 4, 0), ("s", "b", 4, 1), ("a", "t", 3, 0), ("b", "t", 9, 0), ("a", "b", 9, 2)]
    assert min_cost_flow(edges, "s", "t") == [4, 4, 3, 5, 1]


def test_targets_stop_at_twice_the_size():
    t = targets({"a": 10, "b": 1000, "c": 90, None: 100, "d": 0})
    assert t["a"] == 20 and t["d"] == 0
    assert abs(sum(t.values()) - 1800) < 1e-9
    assert all(t[s] <= 2 * n for s, n in {"a": 10, "b": 1000, "c": 90, None: 100}.items())
    assert targets({}) == {} and targets({"a": 0, None: 0}) == {"a": 0.0, None: 0.0}


def test_overlapping_sources_share_a_pattern():
    flows = route([(("a",), 100), (("a", "b"), 100), (("b",), 10)], {"a": 150, "b": 60}, 2)
    assert sum(f.get("a", 0) for f in flows) == 150 and sum(f.get("b", 0) for f in flows) == 60
    assert sum(flows[1].values()) <= 200 and all(sum(f.values()) <= 2 * w for f, w in zip(flows, (100, 100, 10)))
    # No pattern is repeated while another has words that were not taken.
    assert max(sum(f.values()) / w for f, w in zip(flows, (100, 100, 10))) <= 1.01


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i % 400 if i % 50 else None, "w " * rng.randint(0, 30) if i % 7 else None, rng.choice(["a", "b", "é", None, "hot", "hot"]), 1, 2)
            for i in range(900)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken int")
    got = mix(docs, size=F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = {}
    for r in got:
        s, = r.sources
        assert r.source_sizes == [sizes[s]] and r.targets == [want[s]] and r.taken == r.size * r.copies <= 2 * r.size
        assert r.taken_for == [s] * r.copies
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)
    assert mix(docs.limit(0)).count() == 0


def test_overlap_in_a_table(spark):
    rows = [(i, "x " * (i % 9 + 1), [["a"], ["a", "b"], ["b", "a", "a"], [], None][i % 5]) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    got = mix(docs, sources=F.col("tags"), quota_of=lambda s: {"a": 900, "b": 300}).collect()
    served = {"a": 0, "b": 0}
    for r in got:
        assert len(r.taken_for) == r.copies and set(r.taken_for) <= set(r.sources)
        for s in r.taken_for:
            served[s] += r.size
    assert abs(served["a"] - 900) <= 20 and abs(served["b"] - 300) <= 20
