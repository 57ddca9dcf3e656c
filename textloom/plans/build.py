"""The build: dedupe, length filters, split, write, metadata record."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import __version__, storage
from ..operators import clean
from ..operators.clean import count_removed, distinct_texts, key_columns, length_range, text_keys
from ..operators.order import preview
from ..operators.split import assign_splits, check_ratios, label_rows, split_cuts
from ..operators.stats import split_histogram
from ..sinks.files import check_format, metadata_path, metadata_row, write_metadata, write_samples
from ..sources.files import read_files
from ..sources.pages import from_pages
from ..sources.samples import from_table, from_texts
from ..storage import is_staged_by_task, keep_rows, remove_staged, stage, stage_rows

DEFAULT_RATIOS = (0.9, 0.05, 0.05)
# Fixed value: shortest text of the three convenience builds.
DEFAULT_MIN_CHARS = 40


@dataclass(frozen=True)
class BuildResult:
    output: str
    metadata: str
    samples: int
    removed: dict[str, int]
    format: str
    name: str
    splits: dict[str, int]
    failed_pages: int = 0


def build(
    samples: DataFrame, output: str, name: str, format: str = "jsonl", split_ratios=DEFAULT_RATIOS,
    dedupe: bool = True, min_chars: int = 0, max_chars: int = 0, text_column: str = "text",
    source_column: str = "source", seq_is_stored: bool = False, ordered: bool = False,
    creator: str = "textloom",
) -> BuildResult:
    """Clean samples and write them as a dataset.

    The texts are read twice: once for their keys and once for the output. The
    work in between runs on a stored table of 44 bytes per sample. ``samples``
    must give the same ``seq`` in both readings; unless ``seq_is_stored`` says so
    (an id column of a table), they are staged first, together with their keys.

    ``ordered`` sorts the output by ``seq``; by default no row moves for order.
    """
    check_format(format)
    if not name:
        raise ValueError("a dataset name is required")
    ratios = check_ratios(split_ratios)
    splitting = sum(ratios) > 0
    keep = () if splitting else ("split",)
    rows, staged = None, []
    if not seq_is_stored:
        samples = stage_rows(samples.select("text", "source", "split", "seq", *key_columns()), "samples", staged)
        rows = samples.select("seq", "key", "n", *keep)

    chosen = choose(samples, dedupe, min_chars, max_chars, keep, rows, staged)
    counts, kept = chosen.counts, chosen.kept
    if not counts["total"]:
        raise ValueError("no samples to write; add texts first")
    removed = {k: counts[k] for k in ("duplicates", "too_short", "too_long") if k in counts}

    out = chosen.apply(samples)
    if splitting:
        cuts = split_cuts(kept.select("seq"), ratios)
        out = label_rows(out, cuts)
        histogram = split_histogram(label_rows(kept.select("seq"), cuts))
    elif dedupe:
        histogram = split_histogram(chosen.rows.select("seq", "split").join(kept.select("seq"), "seq", "left_semi"))
    else:
        histogram = split_histogram(kept)

    if ordered:
        out = out.orderBy("seq")
    # Behind the sort: its sampling pass must not be counted.
    written = Observation()
    out = out.observe(written, F.count(F.lit(1)).alias("rows"))
    path = write_samples(
        out.select(F.col("text").alias(text_column), F.col("source").alias(source_column), "split"), output, format)
    if written.get["rows"] != counts["kept"]:
        raise RuntimeError(
            f"wrote {written.get['rows']} of {counts['kept']} samples: the input changed between its two readings")

    record = metadata_row(histogram, name, removed, ratios, text_column, source_column, creator, __version__)
    sidecar = write_metadata(record, metadata_path(path))
    splits = record.sparkSession.read.schema(record.schema).json(sidecar).first()["splits"]
    remove_staged(record.sparkSession, staged)
    return BuildResult(path, sidecar, counts["kept"], removed, format, name, dict(splits))


@dataclass(frozen=True)
class Choice:
    """Which samples stay, worked out on stored keys; see ``choose``."""

    rows: DataFrame
    first: DataFrame
    kept: DataFrame
    counts: dict[str, int]
    min_chars: int
    max_chars: int
    staged: list | None = None

    def apply(self, samples: DataFrame) -> DataFrame:
        """The chosen samples.

        The lengths are a filter. Copies are dropped by the smaller side, copies
        or survivors, which is broadcast when its counted size allows; beyond
        that the samples stay with the tasks that wrote them (``keep_rows``).
        No text moves either way.
        """
        out = length_range(samples, self.min_chars, self.max_chars)
        copies, survivors = self.counts.get("duplicates", 0), self.counts["kept"]
        if not copies:
            return out
        kept = self.kept.select("seq")
        if survivors <= min(copies, storage.MAX_BROADCAST_ROWS):
            return out.join(F.broadcast(kept), "seq", "left_semi")
        if copies <= storage.MAX_BROADCAST_ROWS:
            dropped = stage(self.rows.select("seq").join(self.first.select("seq"), "seq", "left_anti"), "copies", self.staged)
            return out.join(F.broadcast(dropped), "seq", "left_anti")
        return keep_rows(samples if is_staged_by_task(samples) else stage_rows(out, "samples", self.staged), kept)


def choose(
    samples: DataFrame, drop_duplicates: bool = True, min_chars: int = 0, max_chars: int = 0, keep: tuple[str, ...] = (),
    rows: DataFrame | None = None, staged: list | None = None,
) -> Choice:
    """Choose the samples that stay; paths of what it stages are added to ``staged``.

    ``rows`` are the keys where they are stored already; else the texts are read
    once and their keys are staged.
    """
    if rows is None:
        rows = text_keys(samples, keep=keep)
        rows = stage(rows if drop_duplicates else rows.drop("key"), "keys", staged)
    first = stage(distinct_texts(rows), "first", staged) if drop_duplicates else rows
    counts = count_removed(first, drop_duplicates, min_chars, max_chars).first().asDict()
    kept = first
    if min_chars > 0:
        kept = kept.filter(F.col("n") >= min_chars)
    if max_chars > 0:
        kept = kept.filter(F.col("n") <= max_chars)
    return Choice(rows, first, kept, counts, min_chars, max_chars, staged)


def cleaned_splits(
    samples: DataFrame, ratios=DEFAULT_RATIOS, drop_duplicates: bool = True, min_chars: int = 0, max_chars: int = 0,
) -> DataFrame:
    """Dedupe, filter and split without writing: two readings of the texts."""
    chosen = choose(samples, drop_duplicates, min_chars, max_chars)
    return assign_splits(chosen.apply(samples), *ratios, keys=chosen.kept.select("seq"))


def build_from_texts(
    spark: SparkSession, name: str, texts: list[str] | DataFrame, output: str, source: str = "manual",
    min_chars: int = DEFAULT_MIN_CHARS, **options,
) -> BuildResult:
    """Build from a list, or from a table with ``text`` and ``seq``."""
    if isinstance(texts, DataFrame):
        samples = from_table(texts, source=source)
    else:
        samples = from_texts(spark, texts, source)
    return build(samples, output, name, min_chars=min_chars, **{"seq_is_stored": True, **options})


def build_from_files(
    spark: SparkSession, name: str, paths: Iterable[str], output: str, min_chars: int = DEFAULT_MIN_CHARS,
    on_unreadable: str = "error", **options,
) -> BuildResult:
    """Build from text, Markdown, JSON and JSONL files; ``on_unreadable`` as in ``read_files``."""
    text_column = options.get("text_column", "text")
    return build(read_files(spark, paths, text_column, on_unreadable=on_unreadable), output, name, min_chars=min_chars, **options)


def build_from_pages(
    name: str, pages: DataFrame, output: str, selector: str | None = None, min_chars: int = DEFAULT_MIN_CHARS,
    **options,
) -> BuildResult:
    """Build from a table of stored pages ``page_id, url, html``; pages that cannot be parsed are counted."""
    failed = Observation()
    result = build(from_pages(pages, selector, failed=failed), output, name, min_chars=min_chars, **options)
    return replace(result, failed_pages=failed.get["failed_pages"])


def preview_build(
    samples: DataFrame, n: int = 5, drop_duplicates: bool = False, min_chars: int = 0, max_chars: int = 0,
    seq_is_stored: bool = False,
) -> tuple[int, DataFrame]:
    """Number of samples and the first n after the cleaning steps that are asked for.

    Dedupe reads the samples twice, so they are staged for it unless
    ``seq_is_stored``.
    """
    if drop_duplicates:
        samples = samples if seq_is_stored else stage(samples, "samples")
        samples = clean.dedupe(samples)
    samples = length_range(samples, min_chars, max_chars)
    return samples.count(), preview(samples, n)
