import re
from collections import Counter

from textloom.llm import quality as ql
from textloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            marked.update(range(i, i + 8))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


ODD = [
    None, "", " ", "\n\n", "a", "\na\na\n", "x y\nx y \nx y", "ü é\x0bß z", "#*$ %&|<>\n" * 30, "w " * 50, "a b c d e f g h " * 9,
    "\r\n".join(f"line {i % 7} has a few words in it." for i in range(40)), "z" * 3_000_000, ("ab " * 500 + "\n") * 400,
    "0 " * 7 + "\n" + "0 " * 7,
]


def measured(rows):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]


def test_metrics_of_odd_texts_equal_brute_force(spark):
    rows = [(i % 9 if i else None, t, i, "x") for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int, `a.b` string").coalesce(1)
    out = ql.line_quality(docs, ql.train(*[__import__("numpy").zeros((0, 9))] * 3))
    got = out.select("doc.doc_id", *[c for c in out.columns if c != "doc"])
    assert sorted(measured(got.collect()), key=str) == sorted(((i, *brute(t)) for i, t, *_ in rows), key=str)
    assert out.select("doc.*").columns == docs.columns
    assert ql.line_quality(docs.limit(0), ql.train(*[__import__("numpy").zeros((0, 9))] * 3)).count() == 0


def test_query_equals_brute_force_and_learns_quality(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert sorted(measured(rows)) == sorted((i, *brute(t)) for i, t in docs.items())
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_held_out_labels(spark):
    """Trained on half of the labels, the verdict agrees with the other half."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = ql.fit(docs, labels.filter("doc_id % 2 = 0"), max_docs=200)
    rows = ql.line_quality(docs.join(labels.filter("doc_id % 2 = 1"), "doc_id"), model).filter("not base_failed")
    n, wrong_bad, good, lost = rows.selectExpr(
        "count_if(doc.quality = 0)", "count_if(doc.quality = 0 and kept)", "count_if(doc.quality = 1)",
        "count_if(doc.quality = 1 and not kept)").first()
    print(n, wrong_bad, good, lost)
    assert wrong_bad <= 0.1 * n and lost <= 0.01 * good


def parity(n, letters="ab"):
    """The parity sequence: it and its mirror collide under any polynomial modulo a power of two."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_lines_and_words_that_polynomials_confuse(spark):
    texts = [parity(n) + sep + parity(n, "ba") for n in (1024, 2048, 4096) for sep in ("\n", " ")]
    windows = " ".join(parity(1024) for _ in range(8)) + " x " + " ".join(parity(1024, "ba") for _ in range(8))
    texts += [windows, parity(2048) + "\n" + parity(2048), windows + " " + windows]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = ql.line_quality(docs, ql.train(*[__import__("numpy").zeros((0, 9))] * 3)).select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted(measured(out.collect())) == [(i, *brute(t)) for i, t in enumerate(texts)]
