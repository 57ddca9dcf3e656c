import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from textloom.llm import cutting_stock, packing
from textloom.llm.cutting_stock import plan
from textloom.llm.queries import QUERIES

SLOW = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return SLOW.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, docs, sequence=1024):
    """Every id of every document in one piece, sequences without gaps; gives the padding's share."""
    docs = sorted(((d, ids_of(t)) for d, t in docs), key=str)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d in {d for d, _ in docs}:
        mine = [ids for e, ids in docs if e == d]
        want = sorted((len(ids),) for ids in mine)
        assert sorted((r.doc_tokens,) for r in by_doc[d] if r.start == 0) == want
        if len(mine) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r.start):
                assert r.start == at and 0 < r.length and r.ids_crc32 == crc(mine[0][at:at + r.length])
                at += r.length
            assert at == len(mine[0])
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in docs)
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
        assert fill[r.sequence_id] <= sequence
    return 1 - sum(fill.values()) / (sequence * max(1, len(fill)))


def test_fast_and_slow_ids_agree():
    encode = packing._encoder(*packing.public_tokenizer())
    rng = random.Random(1)
    pool = [chr(c) for c in range(256)] + ["  ", "'s", "<|endoftext|>", "é", "日本", " ", "ſ", "１", "don't", " 12345"]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 60)))
        assert list(encode(text)) == SLOW.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n,hot", [(0, 0), (1, 0), (300, 0), (20000, 0), (3000, 9000)])
def test_plan_holds_every_piece(n, hot):
    rng = np.random.default_rng(n)
    tails = np.concatenate([rng.integers(1, 1024, n), np.full(hot, 700)])
    histogram = {int(a): int(b) for a, b in zip(*np.unique(tails, return_counts=True))}
    patterns, left = plan(histogram, 1024, unit=16)
    used = dict(left)
    for counts, times in patterns:
        assert sum(a * c for a, c in counts.items()) <= 1024
        for a, c in counts.items():
            used[a] = used.get(a, 0) + c * times
    assert used == histogram


@pytest.mark.parametrize("seed", range(6))
def test_knapsack_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 90))
    lengths = np.unique(rng.integers(1, capacity + 1, rng.integers(1, 30)))
    value = rng.uniform(-0.2, 1, len(lengths)) * (lengths / capacity if seed % 2 else 1)
    best = [0.0] * (capacity + 1)
    for c in range(1, capacity + 1):
        best[c] = max([best[c - 1]] + [v + best[c - n] for n, v in zip(lengths, value) if n <= c])
    sack = cutting_stock.Knapsack(lengths, value, capacity)
    assert np.allclose(sack.best, best)
    for c in range(capacity + 1):
        counts = sack.pattern(c)
        assert counts @ lengths <= c and np.isclose(counts @ value, best[c])


def test_program_meets_every_demand_near_its_bound():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(3, 257, 150))
    for demand in (rng.integers(1, 50, len(lengths)).astype(float), np.where(lengths > 130, 9e6, 1.0), np.full(len(lengths), 1e9)):
        first = cutting_stock.first_basis(lengths, demand, 256)
        assert (first @ lengths <= 256).all() and abs(np.linalg.det(first / first.max(1, keepdims=True))) > 0
        basis, use = cutting_stock.solve(lengths, demand, 256)
        assert (basis @ lengths <= 256).all() and np.allclose(basis.T @ use, demand, rtol=1e-6)
        # No packing has fewer bins than the pieces' room, nor than the pieces above half a bin.
        least = max(demand @ lengths / 256, demand[lengths > 128].sum())
        assert use.sum() <= 1.02 * least + 1


def test_capacity_that_is_no_multiple_of_the_unit():
    histogram = {1021: 5, 1022: 3, 300: 40, 1: 7}
    patterns, left = plan(histogram, 1022)
    used = dict(left)
    for counts, times in patterns:
        assert sum(a * c for a, c in counts.items()) <= 1022
        for a, c in counts.items():
            used[a] = used.get(a, 0) + c * times
    assert {n: c for n, c in used.items() if c} == histogram


def test_odd_documents(spark):
    texts = [None, "", " ", "a", "<|endoftext|> and", "é日本", "x" * 30_000, "word " * 40_000] + ["same length here"] * 700
    rows = [(None if i == 3 else i, t, i, "z") for i, t in enumerate(texts)] + [(5, "again", 1, "z"), (5, "again", 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, crcs string")
    got = packing.pack(docs).collect()
    assert check(got, [(d, t) for d, t, *_ in rows]) < 0.05
    assert packing.pack(docs.limit(0)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert check(QUERIES["op6_packing"](spark, sf).collect(), docs) < 0.02
