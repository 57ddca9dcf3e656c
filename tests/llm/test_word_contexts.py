import math
from collections import Counter


import numpy as np
import pyarrow as pa

from textloom.llm import word_contexts as wc
from textloom.llm.queries import QUERIES

from test_pitman_yor import base_of, tokens


def pairs_of(text):
    words = [w.encode() for w in tokens(text)]
    return list(zip([b""] + words[:-1], words))


def test_tokens_of_texts():
    texts = ["", " \n", "The cat\x0b\x0cTHE\tcat ", "é É  x\x1c", "a", "a" * 70, "", "end"]
    kinds, got, n = wc.tokens_of(pa.array([t.encode() for t in texts], pa.binary()).slice(1))
    assert [kinds[int(i)].as_py() for i in got] == [w.encode() for t in texts[1:] for w in tokens(t)]
    assert n.tolist() == [len(tokens(t)) for t in texts[1:]] and len(set(kinds.to_pylist())) == len(kinds)


def test_words_behind_each_context_are_a_distribution(spark):
    train = ["the cat sat on the mat", "the cat the cat", "a dog", "", "mat mat dogs"] * 3
    model = wc.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    counts = Counter(p for t in train for p in pairs_of(t))
    pairs = {(bytes(r.u), bytes(r.w)): r for r in model.pairs.collect()}
    words = {bytes(r.w): r for r in model.words.collect()}
    back = {bytes(r.u): r.back for r in model.contexts.collect()}
    assert {k: r.c for k, r in pairs.items()} == counts and model.n == sum(counts.values()) and model.v == len(words)
    assert all(r.own == words[w].c for (_, w), r in pairs.items())
    assert abs(sum(10**r.p for r in words.values()) + 10**model.other - 1) < 1e-9
    for u in back:
        seen = sum(10**r.p for (v, _), r in pairs.items() if v == u)
        others = 10**model.other + sum(10**r.p for w, r in words.items() if (u, w) not in pairs)
        assert abs(seen + 10 ** back[u] * others - 1) < 1e-9, u
    assert pairs[b"the", b"cat"].p > pairs[b"", b"the"].p - 1 and pairs[b"the", b"cat"].p > words[b"cat"].p

    def p(u, w):
        return pairs[u, w].p if (u, w) in pairs else back.get(u, 0) + (words[w].p if w in words else model.other)

    texts = ["the cat", "cat the", "THE unseen cat unseen", None, "", "mat dog a", "new", "the cat sat " * 300]
    docs = spark.createDataFrame([(i % 6 or None, t) for i, t in enumerate(texts * 2)], "doc_id bigint, text string")
    for frequent in (0, 3, 1000):
        got = sorted((r.n_tokens, r.score) for r in wc.score(docs, model, frequent_pairs=frequent).collect())
        want = sorted((len(pairs_of(t)), sum(p(*x) for x in pairs_of(t))) for t in texts * 2)
        assert all(a == b and math.isclose(x, y, rel_tol=1e-9) for (a, x), (b, y) in zip(got, want, strict=True)), frequent


def test_tables_of_one_sweep_by_a_plain_reader(spark):
    """Two sweeps: in the first each pair and each word has one table; the second is drawn anew here from its state."""
    train = ["a b a b a b c", "b a b c c c", "a b"] * 4
    model = wc.fit(spark.createDataFrame([(t,) for t in train], "text string"), sweeps=1, burn_in=0)
    counts = Counter(p for t in train for p in pairs_of(t))
    one, d = wc.STRENGTH, wc.discount_of(sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values()))
    kinds, rooms, n = Counter(w for _, w in counts), Counter(u for u, _ in counts), Counter()
    for (u, _), c in counts.items():
        n[u] += c
    e = wc.discount_of(sum(c == 1 for c in kinds.values()), sum(c == 2 for c in kinds.values()))
    total = sum(kinds.values())
    for r in model.pairs.collect():
        u, w = bytes(r.u), bytes(r.w)
        word = (kinds[w] - e) / (one + total) + (one + e * len(kinds)) / (one + total) * 10 ** model.spelling.log10([w])[0]
        want = (counts[u, w] - d) / (one + n[u]) + (one + d * rooms[u]) / (one + n[u]) * word
        assert math.isclose(10**r.p, want, rel_tol=1e-9), (u, w)


def test_odd_rows(spark):
    texts = [None, "", " \n", "The the THE", "é É", "x" * 300_000, "new words only qqq", "w " * 20_000]
    docs = spark.createDataFrame([(i % 5 if i else None, t, 1, b"w") for i, t in enumerate(texts * 2)], "doc_id long, text string, n_known int, w binary")
    train = docs.filter("text is null or text not like 'new%'")
    model = wc.fit(train)
    n, want = base_of([t for t in texts * 2 if not (t or "").startswith("new")], texts * 2)
    for frequent in (0, 2, 1000):
        got = wc.score(docs, model, frequent_pairs=frequent).collect()
        assert model.n == n and len(got) == len(texts) * 2
        key = lambda r: (r[0], r[1], round(r[2], 6))
        assert sorted(key((r.n_tokens, r.n_known, r.base_score)) for r in got) == sorted(map(key, want))
    spelt = wc.score(docs, model, open_vocabulary=True).collect()
    assert sum(r.score for r in spelt) < sum(r.score for r in got)
    first = sorted((r.n_tokens, r.score) for r in got)
    again = sorted((r.n_tokens, r.score) for r in wc.score(docs.repartition(3), wc.fit(train.repartition(5))).collect())
    assert all(a[0] == b[0] and math.isclose(a[1], b[1], rel_tol=1e-9) for a, b in zip(first, again))
    empty = wc.fit(docs.limit(0))
    assert empty.n == 0 and wc.score(docs.limit(0), model).count() == 0
    assert all(abs(r.base_score) < 1e-9 and r.n_known == 0 for r in wc.score(docs, empty).collect())


def test_query_knows_the_order_of_words(spark, tmp_path):
    rows = [(i, "the cat sat on the mat and the dog ran off") for i in range(60)] + [(100 + i, t) for i, t in enumerate(
        ["the cat sat on the mat", "mat the on sat cat the"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_lm_score"](spark, str(tmp_path)).collect()}
    assert got[100].n_tokens == got[101].n_tokens and math.isclose(got[100].base_score, got[101].base_score, rel_tol=1e-9)
    assert got[100].score > got[101].score + 1


def test_parts_make_no_difference_and_rows_are_arrays(spark, monkeypatch):
    """Some words and tokens a part, and contexts that are dealt by both words; before, each pair was a row of its own."""
    texts = ["the " + " ".join(f"w{(i * j) % 97} the" for j in range(60)) for i in range(30)] + [None, "", "the the the"]
    docs = spark.createDataFrame([(i % 31 or None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    train = docs.filter("doc_id is null or doc_id % 5 > 0")
    rows, staged = [], wc.stage

    def counting(*args):
        out = staged(*args)
        rows.append(out.count())
        return out

    def scores(frequent):
        got = wc.score(docs, wc.fit(train), frequent_pairs=frequent).collect()
        return sorted((r.n_tokens, r.n_known, r.base_score, r.score) for r in got)

    want = scores(1000)
    monkeypatch.setattr(wc, "stage", counting)
    model = wc.fit(train)
    assert sum(rows) < len(model.pairs.collect())
    monkeypatch.setattr(wc, "PART_WORDS", 20)
    monkeypatch.setattr(wc, "PART_TOKENS", 300)
    monkeypatch.setattr(wc, "HEAVY", 50)
    for frequent in (0, 20):
        got = scores(frequent)
        assert all(a[:2] == b[:2] and all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(a[2:], b[2:])) for a, b in zip(got, want, strict=True))


def test_arrays_are_read_back():
    for x in ([], [0], [5, 5, 9, 2**40], [-1, 3, 127, 128], [2**31, -(2**31)], [-5, -4], [2**62, 0]):
        assert wc._ints(wc._put(np.array(x, np.int64))).tolist() == x
