import pytest

from textloom.sources import html, pages

LONG = "forty characters of text are needed here, at least"


def blocks(source, selector=None):
    return list(html.text_blocks(source, html.parse_selector(selector or html.DEFAULT_SELECTOR)))


def test_extract(spark):
    page = (
        f"<html><head><script>var t='</p>';</script><style>p{{}}</style></head><body><main>"
        f"<article><h1>T &amp; U</h1><p>{LONG}\n  <b>bold</b><!-- no --></p>"
        f"<p>{LONG} open<script>x</script><div>{LONG} inner</div></article><p>short</p></main></body>")
    table = spark.createDataFrame(
        [(1, "http://a/1", page), (2, "file:///x", page), (3, "HTTPS://b", None), (4, "http://e", "")],
        "page_id bigint, url string, html string")
    got = [(r.url, r.text) for r in pages.extract_blocks(table).orderBy("seq", "pos").collect()]
    open_p = f"{LONG} open {LONG} inner"
    whole = f"T & U {LONG} bold {open_p}"
    assert got == [("http://a/1", whole + " short"), ("http://a/1", whole), ("http://a/1", f"{LONG} bold"), ("http://a/1", open_p)]
    rows = pages.from_pages(table, "article > p", split="s").orderBy("seq").collect()
    assert [(r.text, r.source, r.split) for r in rows] == [(f"{LONG} bold", "http://a/1", "s"), (open_p, "http://a/1", "s")]


def test_min_length_counts_collapsed_text(spark):
    table = spark.createDataFrame(
        [(1, "http://a", f"<p>{'a' * 20}  \n\t {'b' * 19}</p><p>{'a' * 20}   {'b' * 18}</p>")],
        "page_id bigint, url string, html string")
    assert [r.text for r in pages.extract_blocks(table).collect()] == ["a" * 20 + " " + "b" * 19]


def test_tree_rules():
    assert blocks("<p>a<br>b<br/>c</p>") == ["a b c"]
    assert blocks("<p>one<p>two</p>three") == ["one two three", "two"]
    assert blocks("<div><p>one</div>two") == ["one"]
    assert blocks("<p/>x") == [""]
    assert blocks("</p><p>a</b>b</p>") == ["a b"]
    assert blocks("<p>a<template>no<b>no</b></template>b</p>") == ["a b"]
    assert blocks("<p>caf&eacute; &#33;&amp;c</p>") == ["café !&c"]


@pytest.mark.parametrize("selector, want", [
    ("article p", ["a", "b"]), ("article > p", ["a"]), ("#x", ["b"]), (".k.m", ["c"]), ("p.k", []), ("*.m", ["c"]),
    ("[data-v]", ["d"]), ("[data-v='1 2']", ["d"]), ('span[data-v="1"]', []), ("span, #x", ["b", "d"]),
    ("article div > p, article>p", ["a", "b"]), ("body p", []), ("P", ["a", "b"]),
])
def test_selectors(selector, want):
    page = ("<article><p>a</p><div><p id=x>b</p></div></article><div class='m k'>c</div>"
            "<span data-v='1 2'>d</span>")
    assert blocks(page, selector) == want


@pytest.mark.parametrize("selector", ["p:first-child", "a + b", "a ~ b", "p >", "> p", "p,,b", "p[", "p[a^=b]", "1p"])
def test_unsupported_selectors(selector):
    with pytest.raises(ValueError):
        html.parse_selector(selector)


def test_unclosed_elements_share_one_text():
    import tracemalloc

    n = 10_000
    page = "".join(f"<p>paragraph {i} " for i in range(n))
    tracemalloc.start()
    text, ranges = html.block_ranges(page, html.parse_selector("p"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ranges) == n and peak < 60e6  # the blocks have 800 million characters in all
    for i in (0, 1, 5000, n - 1):
        first, size = ranges[i]
        assert text[first:first + size] == " ".join(f"paragraph {k}" for k in range(i, n))


def test_many_nested_blocks_are_rows(spark):
    page = "".join(f"<p>paragraph number {i} of this page " for i in range(300))
    table = spark.createDataFrame([(7, "http://a", page), (8, "http://b", "<main>é😀 " + "x" * 40 + "</main>")], "page_id bigint, url string, html string")
    got = {(r.seq, r.pos): r.text for r in pages.extract_blocks(table, "p, main", min_chars=20).collect()}
    assert len(got) == 301 and got[8, 0] == "é😀 " + "x" * 40
    for i in range(300):
        assert got[7, i] == " ".join(f"paragraph number {k} of this page" for k in range(i, 300))
    assert [r.text for r in pages.extract_blocks(table.filter("page_id = 9")).collect()] == []
    empty = spark.createDataFrame([(1, "http://a", "<p></p><p>y</p>")], "page_id bigint, url string, html string")
    assert [r.text for r in pages.extract_blocks(empty, min_chars=0).orderBy("pos").collect()] == ["", "y"]
