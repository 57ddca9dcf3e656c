import hashlib
import random
from collections import Counter

import pytest

from textloom.llm import suffix_dedup as sd
from textloom.llm.queries import QUERIES
from textloom.llm.suffix_groups import suffix_array


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 3, 5])
        s = [rng.randint(1, k) for _ in range(n)]
        if rng.random() < 0.3 and n > 3:
            s = (s[:rng.randint(1, 4)] * 20)[:n]
        s.append(0)
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(texts, width):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if count[t[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def run(spark, texts, width):
    docs = spark.createDataFrame([(i if i % 17 else None, t, b"x", "k") for i, t in enumerate(texts)], "doc_id long, text string, t binary, spans string").coalesce(1)
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs, width).collect()]


@pytest.mark.parametrize("seed", range(3))
def test_edited_copies_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(sd, "BLOCK_PIECES", [48, 3, 5][seed])
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 6)))
    base = [" ".join(word() for _ in range(60)) for _ in range(8)]
    texts = [None, "", "a", "é" * 90, "ab" * 150, "ab" * 20, "z" * 23, "z" * 24, "z" * 25]
    for _ in range(160):
        t = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            i = rng.randrange(len(t))
            t = t[:i] + rng.choice(["", word(), t[i:i + 1] * 2]) + t[i + rng.randint(0, 2):]
        cut = rng.randrange(len(t))
        texts.append(rng.choice([t, t[cut:], t[:cut], t[cut:] + " " + word() + " " + rng.choice(base)[:rng.randint(10, 200)]]))
    texts += [" ".join(word() for _ in range(12)) + base[0][50:110] + " ".join(word() for _ in range(12)) for _ in range(60)]
    got, want = run(spark, texts, 24), brute(texts, 24)
    for t, g, w in zip(texts, got, want):
        assert g == w, t


def test_long_texts_and_no_rows(spark, monkeypatch):
    rng = random.Random(9)
    unique = "".join(rng.choices("abcdefghij ", k=1_300_000))
    texts = [unique, unique[700_000:700_900] + "x", "q" * 5000, unique[:399]]
    got = run(spark, texts, 400)
    assert got[0][1] == 900 and got[1][1] == 900 and got[2][1] == 5000 and got[3][1] == 0
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = sd.remove_repeats(spark.createDataFrame([(1, "k" * 10 + "m" * 500)], "doc_id long, text string"), with_kept=True).collect()
    assert bytes(rows[0].kept) == b"k" * 10 and [tuple(s) for s in rows[0].spans] == [(10, 510)]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {d.doc_id: w for d, w in zip(docs, brute([d.text for d in docs], 400))}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_suffix_dedup"](spark, sf).collect()}
    assert got == want


def test_anchors_that_polynomials_confuse(spark):
    rng = random.Random(9)
    parity = lambda n, letters: "".join(letters[bin(i).count("1") % 2] for i in range(n))
    junk = lambda n: "".join(rng.choice("cdefgh") for _ in range(n))
    shared = junk(4200)
    texts = [junk(300) + parity(4096, "ab") + junk(2500), junk(200) + parity(4096, "ba") + junk(2500), parity(4096, "ab") + junk(500),
             parity(4096, "ba") + junk(700), junk(90) + shared, shared + junk(80)]
    for width in (2048, 4096):
        assert sorted(run(spark, texts, width)) == sorted(brute(texts, width))


def test_pieces_of_unlike_anchors_with_one_hash(spark):
    """Even when the hash does not tell anchors apart, only equal bytes are removed."""
    a, b = b"x" * 40 + b"ANCHOR-1" + b"y" * 40, b"x" * 40 + b"anchor_2" + b"y" * 40
    rows = [{"h": 1, "p": k, "block": 0, "copies": 1, "kinds": 2, "anchor": 40, "body": body} for k, body in enumerate((a, b))]
    import pyarrow as pa

    found = list(sd._groups(16)([pa.RecordBatch.from_pylist(rows)]))
    spans = [(r["p"], r["s"], r["e"]) for batch in found for r in batch.to_pylist()]
    windows = lambda t: {t[i:i + 16] for i in range(len(t) - 15)}
    for p, s, e in spans:
        other = b if p == 0 else a
        assert all(rows[p]["body"][i:i + 16] in windows(other) for i in range(s, e))
