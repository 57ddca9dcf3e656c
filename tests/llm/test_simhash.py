import random
import re

import numpy as np
import xxhash

from textloom.llm import golay, simhash
from textloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(fps):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return [low.get(find(i)) for i in range(len(fps))]


def test_golay_keys_meet_for_one_bit():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 4000)
    k, n = golay.keys(words)
    assert set(n.tolist()) <= {1, 6}
    for bit in range(23):
        other = words ^ (1 << bit)
        near = golay.keys(other)[0][:, 0]
        assert (((k == near[:, None]) & (np.arange(6) < n[:, None])).any(1)).all()


def test_spanning_links_join_all_near_pairs():
    rng = random.Random(2)
    for _ in range(30):
        center = rng.getrandbits(64)
        fps = [center ^ sum(1 << b for b in set(rng.choices(range(64), k=rng.randint(0, 5)))) for _ in range(60)]
        fps += [rng.getrandbits(64) for _ in range(10)]
        x = np.array(sorted(set(fps)), np.uint64)
        a, b = simhash.spanning_links(x, x, 3)
        assert len(a) < len(x)
        parent = {int(v): int(v) for v in x}

        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v

        for p, q in zip(a.tolist(), b.tolist()):
            assert (p ^ q).bit_count() <= 3
            parent[find(p)] = find(q)
        for p in parent:
            for q in parent:
                assert (p ^ q).bit_count() > 3 or find(p) == find(q)


def test_components_of_a_chain(spark):
    links = spark.range(0, 300).selectExpr("id as a", "id + 1 as b").union(spark.createDataFrame([(1000, 900), (900, 1000), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000: 900} or got == {i: 0 for i in range(0, 301)} | {1000: 900, 900: 900}


def test_odd_rows(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    texts = [None, "", "  \n", "One", "one two", "ONE  TWO", "one two three", "x" * 200_000, "É a b c"]
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(300)] = "zz"
        texts.append(" ".join(t))
    rows = [(None if i % 11 == 5 else i % 100, t, "y", i) for i, t in enumerate(texts)]
    rows += rows[:3] + [(None, "alone by itself here", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, rf int")
    got = simhash.simhash_components(docs).collect()
    fps = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    want = [(d, f, c) for (d, f), c in zip(fps, brute_components(fps))]
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(want, key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(fps, brute_components(fps))}
    got = [tuple(r) for r in QUERIES["op9_simhash_dedup"](spark, sf).collect()]
    assert len(got) == len(docs) and set(got) == want
