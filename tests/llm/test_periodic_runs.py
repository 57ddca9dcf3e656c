import hashlib
import random
import zlib

import numpy as np
import pytest

from textloom.llm import periodic_runs as pr
from textloom.llm.queries import QUERIES


def brute(words, min_length, min_exponent):
    """All runs by looking at every period; the smallest period of a stretch by its border."""
    found, n = [], len(words)
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q):
                part = words[i:i + length]
                if all(any(part[k] != part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(text, min_length, min_exponent):
    data = np.frombuffer(text.encode(), np.uint8)
    return [tuple(r) for r in pr.text_runs(data, np.array([0, len(data)]), min_length, min_exponent)[3].tolist()]


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (6, 2), (4, 3), (1, 2)])
def test_runs_equal_brute_force(min_length, min_exponent):
    rnd = random.Random(min_length)
    for trial in range(250):
        kinds = rnd.choice([1, 2, 3, 8])
        words = []
        while len(words) < rnd.choice([0, 3, 40, 120]):
            if rnd.random() < 0.5 and words:
                p = rnd.randint(1, min(12, len(words)))
                tail = words[-p:]
                words += (tail * 9)[:rnd.randint(1, 5 * p)]
            else:
                words += [f"w{rnd.randrange(kinds)}" for _ in range(rnd.randint(1, 9))]
        assert runs_of(" ".join(words), min_length, min_exponent) == brute(words, min_length, min_exponent), words


def test_long_texts_of_few_kinds():
    one = "a " * 30000
    assert runs_of(one, 24, 3) == [(0, 30000, 1)]
    words = ([f"x{i}" for i in range(70)] * 400)[:27000]
    assert runs_of(" ".join(words), 24, 3) == [(0, 27000, 70)]


def test_ordered_positions(monkeypatch):
    monkeypatch.setattr(pr, "PIECE", 4)
    rnd = random.Random(3)
    numbers = rnd.sample(range(1000), 300)
    held, seen = pr.Positions(numbers[0]), [numbers[0]]
    for x in numbers[1:]:
        seen = sorted(seen + [x])
        k = seen.index(x)
        assert held.add(x) == (seen[k - 1] if k else -1, seen[k + 1] if k + 1 < len(seen) else -1)
    assert list(held) == seen and held.size == len(seen)
    assert [held.after(x) for x in seen] == seen[1:] + [-1]


def rewritten(doc_id, text):
    words = (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\f", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


def expected(doc_id, text):
    words = rewritten(doc_id, text)
    runs = brute(words, 24, 3)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(None, "a b " * 20), (1, None), (2, ""), (3, " \t\n"), (4, "x " * 23), (5, "x " * 24), (6, "é ü " * 30), (7, "a\x0bb\r" * 12)]
    rows += [(i % 400, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 90)))) for i in range(8, 600)]
    rows += [(700 + i, "one two three " * 20 + " ".join(map(str, range(60))) + " zz" * 30) for i in range(40)]
    spark.createDataFrame([(i, t, 0, 1) for i, t in rows], "doc_id bigint, text string, t int, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(NAMES).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[6:])
    assert sorted(map(tuple, got), key=key) == sorted([expected(*r) for r in rows], key=key)


def test_query_over_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").select(NAMES).collect()}
    small = [r for r in docs if len(r["text"] or "") < 6000]
    assert len(got) == len(docs) and len(small) > 100
    assert all(got[r["doc_id"]] == expected(*r) for r in small)


def test_empty_table_and_any_columns(spark):
    none = spark.createDataFrame([], "text string, doc string")
    assert pr.find_runs(none, keep=["doc"]).collect() == []
    odd = spark.createDataFrame([("b " * 30, 7, 8)], "`t.x` string, doc int, n_runs int")
    row = pr.find_runs(odd, text="t.x", keep=["doc", "n_runs"]).first()
    assert (row["doc"]["doc"], row["doc"]["n_runs"], row["n_runs"], row["collapsed"]) == (7, 8, 1, "b")
    with pytest.raises(ValueError):
        pr.find_runs(none, min_exponent=1)
