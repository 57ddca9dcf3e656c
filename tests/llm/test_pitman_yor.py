import math
import re
import zlib
from collections import Counter

import numpy as np

from textloom.llm import pitman_yor as py
from textloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + [""]


def base_of(train, texts):
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for t in texts]


def test_tables_are_seated_as_by_single_customers():
    """Means of sampled tables against the sequential rule, few and many customers."""
    rng = np.random.default_rng(3)
    for customers, weight, d in ((1, 0.5, 0.5), (5, 0.7, 0.4), (200, 3.0, 0.6), (3000, 40.0, 0.3), (3000, 1e-6, 0.9)):
        got = py.sample_tables(np.full(4000, customers), np.full(4000, weight), d, rng.integers(0, 2**63, 4000).astype(np.uint64))
        tables = np.ones(4000)
        for n in range(1, customers):
            tables += rng.random(4000) < weight / (weight + n - d * tables)
        assert got.min() >= 1 and got.max() <= customers
        assert abs(got.mean() - tables.mean()) < 0.05 * tables.mean() + 0.05, (customers, weight, d)


def test_spelling_is_a_distribution():
    words = [b"the", b"then", b"that", b"", b"\xc3\xa9t\xc3\xa9"] * 3
    codes, n = np.unique(py.codes_of(words)[0], return_counts=True)
    one = py.Spelling(codes, n, 1)
    s = py.average([py.Spelling(codes, n, 2, one), py.Spelling(codes, n, 3, one)])
    assert abs(s.p1.sum() - 1) < 1e-9 and np.allclose(s.p2.reshape(256, 256).sum(1), 1)
    for context in (0x2020, 0x2074, 0x7468, 0x4142):
        p = s.back[context] * s.p2[(context & 0xFF) << 8:((context & 0xFF) << 8) + 256].sum() + s.seen[s.codes >> 8 == context].sum()
        assert abs(p - 1) < 1e-9
    assert abs(sum(10 ** s.log10([bytes([b])])[0] for b in range(256) if b != 32) + 10 ** s.log10([b""])[0]) < 1
    assert s.log10([b"then"])[0] > s.log10([b"zzzz"])[0]


def test_words_are_a_distribution(spark):
    docs = spark.createDataFrame([("a b a",), ("a c",)], "text string")
    m = py.fit(docs)
    got = m.words.collect()
    assert {bytes(r.w): r.c for r in got} == {b"a": 3, b"b": 1, b"c": 1, b"": 2} and m.n == 7 and m.v == 4
    seen = sum(10**r.p for r in got)
    unseen = 10**m.back * (1 - sum(10 ** m.spelling.log10([bytes(r.w)])[0] for r in got))
    assert abs(seen + unseen - 1) < 1e-6 and abs(10**m.other - unseen) < 1e-9


def test_odd_rows(spark):
    texts = [None, "", " \n", "The the THE", "é É", "x" * 300_000, "new words only qqq", "w " * 20_000]
    docs = spark.createDataFrame([(i % 5 if i else None, t, 1, b"w") for i, t in enumerate(texts * 2)], "doc_id long, text string, n_known int, w binary")
    train = docs.filter("text is null or text not like 'new%'")
    model = py.fit(train)
    n, want = base_of([t for t in texts * 2 if not (t or "").startswith("new")], texts * 2)
    for frequent in (0, 2, 1000):
        got = py.score(docs, model, frequent_words=frequent).collect()
        assert model.n == n and len(got) == len(texts) * 2
        key = lambda r: (r[0], r[1], round(r[2], 6))
        assert sorted(key((r.n_tokens, r.n_known, r.base_score)) for r in got) == sorted(map(key, want))
        assert all(r.score < 0 and r.perplexity > 1 for r in got)
    spelt = py.score(docs, model, open_vocabulary=True).collect()
    assert sum(r.score for r in spelt) < sum(r.score for r in got) and sum(r.score != q.score for r, q in zip(spelt, got)) == 2
    first = sorted((r.n_tokens, r.score) for r in got)
    again = sorted((r.n_tokens, r.score) for r in py.score(docs.repartition(3), py.fit(train.repartition(5))).collect())
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(first, again))
    empty = py.fit(docs.limit(0))
    assert empty.n == 0 and py.score(docs.limit(0), model).count() == 0
    assert all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in py.score(docs, empty).collect())


def test_scores_equal_a_plain_reader_of_the_seatings(spark, monkeypatch):
    kept = []

    class Recording(py.Model):
        def __init__(self, words, spelling, seatings, *rest):
            kept.extend(seatings)
            super().__init__(words, spelling, seatings, *rest)

    monkeypatch.setattr(py, "Model", Recording)
    train = ["the cat sat on the mat", "the cat the cat", "a dog", "", "mat mat dogs"] * 3
    model = py.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    sp, one = model.spelling, py.STRENGTH
    c3, t3 = ({int(k): x for k, x in zip(sp.codes, col)} for col in (sp.c3, sp.t3))

    def byte(a, b, c):
        p = (sp.c1[c] - sp.d * sp.t1[c] + (one + sp.d * sum(sp.t1)) / 256) / (one + sum(sp.c1))
        row = range(b << 8, (b << 8) + 256)
        p = (sp.c2[b << 8 | c] - sp.d * sp.t2[b << 8 | c] + (one + sp.d * sum(sp.t2[i] for i in row)) * p) / (one + sum(sp.c2[i] for i in row))
        mine = [k for k in c3 if k >> 8 == (a << 8 | b)]
        code = a << 16 | b << 8 | c
        return (c3.get(code, 0) - sp.d * t3.get(code, 0) + (one + sp.d * sum(t3[k] for k in mine)) * p) / (one + sum(c3[k] for k in mine))

    def spelt(word):
        line = b"  " + word + b" "
        return math.prod(byte(*line[i:i + 3]) for i in range(len(word) + 1))

    counts = Counter(w.encode() for t in train for w in tokens(t))
    n, tables = sum(counts.values()), sum(s.tables_after for s in kept) / len(kept)
    up = (one + model.d * tables) / (one + n)
    word_p = {w: (c - model.d * sum(s.seat([w], np.array([c]))[0] for s in kept) / len(kept)) / (one + n) + up * spelt(w) for w, c in counts.items()}
    other = up * (1 - sum(map(spelt, counts)))
    texts = ["the cat", "THE unseen cat unseen", "", "mat dog a", "new"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for frequent in (0, 3, 100):
        got = {r.doc_id: r.score for r in py.score(docs, model, frequent_words=frequent).collect()}
        for i, t in enumerate(texts):
            assert math.isclose(got[i], sum(math.log10(word_p.get(w.encode(), other)) for w in tokens(t)), rel_tol=1e-9), (i, frequent)


def test_query_and_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 10 == 0}
    n, base = base_of([t for i, t in docs.items() if i not in held], docs.values())
    rows = {r.doc_id: r for r in QUERIES["op7_lm_score"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (tok, known, b) in zip(docs, base):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, tok, known, n)
        assert math.isclose(r.base_score, b, rel_tol=1e-9)
    model, plain = (sum(getattr(rows[i], c) for i in held) for c in ("score", "base_score"))
    print("held out, log10 a token:", model / sum(rows[i].n_tokens for i in held), plain / sum(rows[i].n_tokens for i in held))
    assert model > plain
