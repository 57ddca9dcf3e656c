from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import clean


def column(spark, values, expr, kind="string"):
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in table.orderBy("i").select(expr(F.col("v"))).collect()]


NASTY = st.lists(st.one_of(
    st.sampled_from(list(tx.WHITESPACE) + ["\n\n", "\r\n", "a", "😀", "é", "\ufffd", "\ufdd0"]),
    st.characters(exclude_categories=["Cs"])), max_size=20).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(NASTY, min_size=100, max_size=200))
def test_text_functions_equal_python(spark, values):
    import re

    assert column(spark, values, tx.strip) == [v.strip() for v in values]
    assert column(spark, values, tx.collapse_whitespace) == [re.sub(r"\s+", " ", v) for v in values]
    assert column(spark, values, F.length) == [len(v) for v in values]
    assert column(spark, values, lambda c: tx.pieces(c, "\n\n")) == [
        [p.strip() for p in v.split("\n\n") if p.strip()] for v in values]
    assert column(spark, values, tx.unix_newlines) == [v.replace("\r\n", "\n").replace("\r", "\n") for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(
    [b"a", "é".encode(), "😀".encode(), "\ufffd".encode(), "\ufdd0".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\xed\xa0\x80",
     b"\xf0\x9f", b"\x80", b"\xc0\xaf", b"\xf5"]), max_size=8).map(b"".join), min_size=100, max_size=200))
def test_invalid_utf8_is_dropped_like_python(spark, values):
    got = column(spark, values, lambda c: tx.valid_text(c.cast("string")), "binary")
    assert got == [v.decode("utf-8", errors="ignore") for v in values]


def test_strip_drops_blank_rows(samples):
    rows = samples([(1, "  \t x y \u0085\n", "a"), (2, " ", "a"), (3, "\x1cb", "a"), (4, None, "a")])
    assert [(r.seq, r.text) for r in clean.clean(rows).orderBy("seq").collect()] == [(1, "x y"), (3, "b")]


def test_paragraphs_only_above_the_limit(spark):
    half = "x" * 2499
    short, long = f"{half}\n\n{half}", f"{half}\n\n{half}y"
    assert (len(short), len(long)) == (5000, 5001)
    assert column(spark, [short, long], tx.paragraphs) == [[short], [half, half + "y"]]


def test_paths_and_urls(spark):
    paths = ["/a/b.TXT", "/a.d/b", "b.tar.gz", "/a/.hidden"]
    assert column(spark, paths, tx.file_suffix) == [".txt", "", ".gz", ""]
    urls = ["http://a/b", "HTTPS://a", "ftp://a", "a/b", "http://[bad", None]
    assert column(spark, urls, tx.is_http_url) == [True, True, False, False, False, False]
    odd = ["http://a.com/x|y", "http://a.com/a b", "https://a.com/{id}?q=[1]", " http://a", "http://[::1]/", "https//a"]
    assert column(spark, odd, tx.is_http_url) == [True, True, True, True, True, False]


def test_shorten(spark):
    assert column(spark, ["abc", "abcd"], lambda c: tx.shorten(c, 3)) == ["abc", "abc…"]


def test_hash(spark):
    import hashlib

    assert column(spark, ["é"], tx.content_hash) == [hashlib.sha256("é".encode()).hexdigest()]


def test_nested_arguments_are_evaluated_once(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("t"))
    inner = tx.collapse_whitespace(F.col("t"))
    for outer in (tx.strip(inner), tx.paragraphs(inner), tx.strip(tx.strip(inner))):
        plan = df.select(outer.alias('x'))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("(?U)") == 1
