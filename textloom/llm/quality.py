"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

The field is trained here, in numpy, on a bounded sample of labelled documents: the lines of a document of quality 1
are content and those of quality 0 boilerplate, and neighbours in the sample are joined so that the field sees both
changes. Viterbi decoding then labels the lines of every whole text in the task that scans it; nothing is shuffled.
A document stays when it passes the base rules and content lines hold at least ``min_share`` of its word characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import bytesets as bs

# Bounds of the training sample: documents for each label, characters of one.
TRAIN_DOCS, TRAIN_CHARS = 600, 20_000
MIN_SHARE, MIN_WORDS, MAX_REPEAT_PERCENT = 0.5, 20, 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
FEATURES = 9

METRICS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, content_share double"
)


def _table(of: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(of)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(bytes(range(48, 58)))
_STOP, _LOUD = _table(b".?!"), _table(b"!")


def measure(data: np.ndarray, offsets: np.ndarray):
    """Metrics of each row, and of each line its row, word characters and features."""
    rows = len(offsets) - 1
    w_start, w_end, w_row = bs.words(data, offsets)
    w_id = bs.identities(data, w_start, w_end)
    n_words = np.bincount(w_row, minlength=rows)
    char = np.concatenate([[0], np.cumsum(((data & 0xC0) != 0x80) & ~bs.is_space(data))])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    # Words in windows that the row holds twice.
    repeat = np.zeros(rows, np.int64)
    if len(w_id) >= WINDOW:
        n = len(w_id) - WINDOW + 1
        found = bs.repeated(w_id, w_row, np.flatnonzero(w_row[:n] == w_row[WINDOW - 1:]), WINDOW)
        step = np.zeros(len(w_id) + 1, np.int64)
        np.add.at(step, found, 1)
        np.add.at(step, found + WINDOW, -1)
        repeat = np.bincount(w_row[np.cumsum(step[:-1]) > 0], minlength=rows)
    l_start, l_end, l_row = bs.lines(data, offsets)
    first, last = np.searchsorted(w_start, l_start), np.searchsorted(w_start, l_end)
    worded = np.flatnonzero(last > first)
    l_id = bs.identities(data, l_start[worded], l_end[worded]) * rows + l_row[worded]
    dup = np.bincount(l_row[worded][bs.later(l_id)], minlength=rows)
    metrics = (n_words, char[offsets[1:]] - char[offsets[:-1]], symbol[offsets[1:]] - symbol[offsets[:-1]], dup, repeat)
    # Features of the lines that hold a word.
    a, b, first, last, l_row = l_start[worded], l_end[worded], first[worded], last[worded], l_row[worded]
    chars = char[b] - char[a]
    share = lambda t: (lambda c: (c[b] - c[a]) / np.maximum(chars, 1))(np.concatenate([[0], np.cumsum(t[data])]))
    count = last - first
    same = np.zeros(len(w_id) + 1, np.int64)
    same[1:-1] = np.cumsum((w_id[1:] == w_id[:-1]) & (w_row[1:] == w_row[:-1])) if len(w_id) > 1 else 0
    if len(w_id):
        same[-1] = same[-2]
    echo = (same[last] - same[np.minimum(first + 1, last)]) / np.maximum(count - 1, 1)
    f = np.stack([
        np.ones(len(a)), np.minimum(4 * (symbol[b] - symbol[a]) / np.maximum(chars, 1), 1), share(_UPPER), share(_DIGIT),
        np.minimum(4 * share(_LOUD), 1), np.log1p(count) / 4, np.minimum(chars / np.maximum(count, 1) / 10, 3),
        _STOP[data[w_end[last - 1] - 1]].astype(float) if len(a) else np.zeros(0), echo,
    ], axis=1)
    return metrics, l_row, chars, f


def _steps(rows: np.ndarray):
    """Lines by their place in the row: for place t, the lines there; shorter rows have none."""
    new = np.ones(len(rows), bool)
    new[1:] = rows[1:] != rows[:-1]
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(rows)))
    by_length = np.argsort(-length, kind="stable")
    begin, length = begin[by_length], length[by_length]
    for t in range(length[0] if len(length) else 0):
        yield begin[: np.searchsorted(-length, -t, "left")] + t


def decode(weights: np.ndarray, moves: np.ndarray, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The most likely labels (1: content) of the lines of each row, by Viterbi."""
    best = np.zeros((len(rows), 2))
    best[:, 1] = features @ weights
    back = np.zeros((len(rows), 2), np.int8)
    steps = list(_steps(rows))
    for t, at in enumerate(steps):
        if t:
            come = best[at - 1][:, :, None] + moves  # from, to
            back[at] = come.argmax(1)
            best[at] += come.max(1)
    label = np.zeros(len(rows), np.int8)
    for t in range(len(steps) - 1, -1, -1):
        at = steps[t]
        goes_on = len(steps[t + 1]) if t + 1 < len(steps) else 0  # rows are in order of length, so these come first
        label[at[:goes_on]] = back[at[:goes_on] + 1, label[at[:goes_on] + 1]]
        label[at[goes_on:]] = best[at[goes_on:]].argmax(1)
    return label


def train(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, steps: int = 150, ridge: float = 1e-3):
    """Weights of the features and of the label changes by gradient ascent on the likelihood of the labels."""
    weights, moves = np.zeros(features.shape[1]), np.zeros((2, 2))
    if not len(rows) or labels.min() == labels.max():
        weights[0] = 1.0 if not len(rows) or labels.max() == 1 else 0.0
        return weights, moves
    order = list(_steps(rows))
    pair = np.flatnonzero(rows[1:] == rows[:-1]) + 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[pair - 1], labels[pair]), 1)
    m = [np.zeros_like(weights), np.zeros_like(moves)]
    v = [np.zeros_like(weights), np.zeros_like(moves)]
    log_sum = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for step in range(1, steps + 1):
        emit = np.zeros((len(rows), 2))
        emit[:, 1] = features @ weights
        fore, aft = emit.copy(), np.zeros_like(emit)
        for t, at in enumerate(order[1:], 1):
            fore[at] += log_sum(fore[at - 1][:, :, None] + moves, 1)
        for t in range(len(order) - 1, 0, -1):
            at = order[t]
            aft[at - 1] = log_sum(moves[None] + (emit[at] + aft[at])[:, None, :], 2)
        post = fore + aft
        norm = log_sum(post, 1)
        p1 = np.exp(post[:, 1] - norm)
        joint = np.exp(fore[pair - 1][:, :, None] + moves + (emit[pair] + aft[pair])[:, None, :] - norm[pair][:, None, None])
        grads = [features.T @ (labels - p1) / len(rows) - ridge * weights, (seen - joint.sum(0)) / len(rows) - ridge * moves]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            move = 0.2 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
            if i:
                moves += move
            else:
                weights += move
    return weights, moves


def _line_rows(batches):
    for batch in batches:
        for first, data, offsets in bs.slices(batch.column("t")):
            _, row, _, f = measure(data, offsets)
            if len(row):
                part = batch.slice(first, len(offsets) - 1).select(["k", "quality"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), FEATURES).cast(pa.list_(pa.float64()))], ["k", "quality", "f"])


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS):
    """Train on at most ``max_docs`` documents of each quality, none above ``max_chars`` characters.

    The sample is the same for the same labels: those whose id has the smallest hashes. Null qualities and ids are
    left out. Without labels everything counts as content.
    """
    order = F.xxhash64(F.lit("quality"), "doc_id")
    chosen = [
        labels.filter((F.col("quality") == q) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(order, "doc_id").limit(max_docs)
        for q in (0, 1)
    ]
    sample = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).filter(F.length("t") <= max_chars)
        .join(F.broadcast(chosen[0].union(chosen[1]).dropDuplicates(["doc_id"])), "doc_id")  # two rows a document bound at most
        .select(order.alias("k"), "quality", "t").mapInArrow(_line_rows, "k bigint, quality int, f array<double>")
    )
    lines = sample.toPandas()
    lines = lines.assign(f=[tuple(x) for x in lines["f"]], nth=range(len(lines)))
    # Lines of one document arrive together and in order.
    lines = lines.sort_values(["k", "nth"], kind="stable")
    key = lines["k"].to_numpy()
    doc = np.cumsum(np.append(0, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    f = np.array(lines["f"].tolist()).reshape(-1, FEATURES)
    return train(doc // 2, f, lines["quality"].to_numpy(np.int64))


def _labelled(weights, moves):
    def run(batches):
        for batch in batches:
            got = []
            for _, data, offsets in bs.slices(batch.column("t")):
                metrics, row, chars, f = measure(data, offsets)
                label = decode(weights, moves, row, f)
                n = len(offsets) - 1
                content = np.bincount(row, weights=chars * label, minlength=n)
                share = content / np.maximum(np.bincount(row, weights=chars, minlength=n), 1)
                got.append([*metrics, np.bincount(row, minlength=n), share])
            if got:
                cols = [pa.array(np.concatenate(x)) for x in zip(*got)]
                names = [c.split()[0] for c in METRICS.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), *cols], ["doc", *names])

    return run


def line_quality(
    docs: DataFrame, model, text: Column | None = None, min_share: float = MIN_SHARE, min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
) -> DataFrame:
    """Per row of ``docs``: doc (a struct of all its columns), the metrics, base_failed and kept.

    A null text is an empty one: it has no words and fails the base rules. Columns may have any names and nulls; rows
    may repeat; a very long text is worked on alone. No rows give no rows.
    """
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), t.alias("t"))
    schema = StructType([rows.schema["doc"], *StructType.fromDDL(METRICS).fields])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return (
        rows.mapInArrow(_labelled(*model), schema)
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= min_share))
    )

