"""Samples from a table of stored HTML pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import is_http_url
from ..operators.clean import clean
from .html import DEFAULT_SELECTOR, block_ranges, parse_selector
from .samples import packed_seq

# Fixed value: shortest block by default.
MIN_BLOCK_CHARS = 40
# Output rows are handed back to the JVM once they reach this size.
_FLUSH_CHARS = 8 << 20


def extract_blocks(
    pages: DataFrame, selector: str | None = None, url: str = "url", html: str = "html", seq: str = "page_id",
    min_chars: int = MIN_BLOCK_CHARS, keep_failed: bool = False,
) -> DataFrame:
    """``seq, url, pos, text``: the text blocks of every http(s) page.

    Parsing is the only Python step. It sees pages one by one in the task that
    scans them, so there is no shuffle, and hands back each page's text once, with
    the ranges of its blocks of at least ``min_chars``; they are cut out in the JVM.
    With ``keep_failed`` a page that cannot be parsed is a row with
    place -1 and a null text; ``failed_pages`` gives these alone.
    """
    chains = parse_selector(selector or DEFAULT_SELECTOR)
    rows = pages.filter(is_http_url(F.col(url)) & F.col(html).isNotNull()).select(
        F.col(seq).alias("seq"), F.col(url).alias("url"), F.col(html).alias("html"))
    seq_type = rows.schema["seq"].dataType

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, body, blocks, size = [], [], [], 0
            for i, page in enumerate(batch.column("html")):
                try:
                    text, ranges = block_ranges(page.as_py(), chains)
                except (AssertionError, ValueError, RecursionError):
                    if keep_failed:
                        at.append(i)
                        body.append(None)
                        blocks.append([(-1, 0, 0)])
                    continue
                found = [(p, first + 1, n) for p, (first, n) in enumerate(ranges) if n >= min_chars]
                if found:
                    at.append(i)
                    body.append(text)
                    blocks.append(found)
                    size += len(text)
                if size >= _FLUSH_CHARS:
                    yield _page_rows(batch, at, body, blocks)
                    at, body, blocks, size = [], [], [], 0
            yield _page_rows(batch, at, body, blocks)

    found = rows.mapInArrow(
        parse, f"seq {seq_type.simpleString()}, url string, body string, blocks array<struct<pos:int,first:int,chars:int>>")
    # Unfolded first and cut behind it, so no more than one block of a page is held.
    cut = found.select("seq", "url", "body", F.inline("blocks"))
    return cut.select("seq", "url", "pos", F.substring("body", F.col("first"), F.col("chars")).alias("text"))


def failed_pages(pages: DataFrame, **options) -> DataFrame:
    """``seq, url`` of the http(s) pages that cannot be parsed."""
    return extract_blocks(pages, keep_failed=True, **options).filter("pos = -1").select("seq", "url")


_RANGES = pa.list_(pa.struct([("pos", pa.int32()), ("first", pa.int32()), ("chars", pa.int32())]))


def _page_rows(batch: pa.RecordBatch, at: list, body: list, blocks: list) -> pa.RecordBatch:
    at = pa.array(at, pa.int32())
    blocks = [[{"pos": p, "first": first, "chars": n} for p, first, n in found] for found in blocks]
    return pa.RecordBatch.from_arrays(
        [batch.column("seq").take(at), batch.column("url").take(at), pa.array(body, pa.string()), pa.array(blocks, _RANGES)],
        ["seq", "url", "body", "blocks"])


def from_pages(
    pages: DataFrame, selector: str | None = None, split: str = "", url: str = "url", html: str = "html",
    seq: str = "page_id", min_chars: int = MIN_BLOCK_CHARS, failed: Observation | None = None,
) -> DataFrame:
    """Samples from pages; the source of each is its URL. ``failed`` observes the number of ``failed_pages``."""
    blocks = extract_blocks(pages, selector, url, html, seq, min_chars, keep_failed=failed is not None)
    if failed is not None:
        blocks = blocks.observe(failed, F.count_if(F.col("pos") == -1).alias("failed_pages")).filter("pos >= 0")
    return clean(blocks.select(
        "text", F.col("url").alias("source"), F.lit(split).alias("split"),
        packed_seq(F.col("seq"), F.col("pos")).alias("seq")))
