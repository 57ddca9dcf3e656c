import hashlib
import random

import duckdb
import pytest

from textloom.llm import exact_dedup as ed
from textloom.llm.queries import ORACLES, QUERIES


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("keep,parts", [("largest", 4), ("smallest", 300)])
def test_odd_rows(spark, keep, parts):
    rng = random.Random(parts)
    texts = [None, "", "A", "a", "É", "é", "x" * 500_000, "X" * 500_000, " a"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), "k", 1) for _ in range(300)] + [(i, "hot", "k", 1) for i in range(200)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, kept int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = ed.exact_dedup(docs, keep=keep).collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(hashlib.sha256(lower(t).encode()).hexdigest(), []).append(d)
    pick = max if keep == "largest" else min
    best = {k: pick((d for d in v if d is not None), default=None) for k, v in groups.items()}
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(
        ((d, best[k], len(v), k) for k, v in groups.items() for d in v), key=str)
    kept = [r for r in got if r.kept]
    assert sorted(r.text_sha256 for r in kept) == sorted(groups) and all(r.doc_id == r.keep_id for r in kept)
    assert ed.exact_dedup(docs.limit(0)).count() == 0


def test_equal_digests_are_verified(spark):
    """Entries with one digest and different SHA-256 stay apart."""
    import pyarrow as pa
    rows = [(1, b"a", 1, 5, 0, 0, 1, 0, 0), (1, b"a", 1, 4, 0, 1, 2, 0, 0), (1, b"b", 1, 9, 0, 2, 1, 0, 0)]
    names = ["digest", "sha", "n", "id", "rf", "ri", "copies", "at", "home"]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i]]) for i in range(9)], names) for r in rows]
    out = [r for b in ed._collapse(iter(batches)) for r in b.to_pylist()]
    assert [(r["sha"], r["id"], r["copies"]) for r in out] == [(b"a", 5, 3), (b"b", 9, 1)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, sf).select(*columns)
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())
