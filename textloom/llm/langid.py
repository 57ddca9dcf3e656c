"""Language ID by a byte convolutional network.

Windows of a fixed number of bytes go through an embedding, filters of several widths, a maximum over all positions
and a softmax. The network is trained on the driver, in numpy, on windows of a bounded sample of labelled documents.
Whole texts are then cut into windows and scored in batches in the task that scans them; a document's language is the
one with the largest mean probability over its windows. For scoring, embedding and filters are folded into one table
per filter place, so a convolution is a sum of table rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesets as bs

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
# The training sample: documents for each language at most, windows of each. More languages than the last are an error.
TRAIN_DOCS, TRAIN_WINDOWS, MAX_LANGS = 500, 4, 10_000
STEPS, BATCH, RATE = 400, 64, 0.01
UNKNOWN = "und"


def windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW):
    """All bytes of each row in windows of ``size`` (the last one ends with the row; a short row is filled up with
    zero bytes): windows, their row, and how many bytes are new in each."""
    n = np.diff(offsets)
    per_row = -(-n // size)
    row = np.repeat(np.arange(len(n)), per_row)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    begin = np.minimum(nth * size, np.maximum(n[row] - size, 0))
    new = np.minimum(n[row] - nth * size, size)
    at = offsets[row][:, None] + begin[:, None] + np.arange(size)
    inside = at < offsets[row + 1][:, None]
    out = np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(row) else np.zeros((0, size), np.uint8)
    return out, row, new


class Network:
    def __init__(self, langs: list[str], seed: int = 7):
        self.langs = langs
        rng = np.random.default_rng(seed)
        f32 = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.w = {"embed": f32(256, EMBED, scale=0.5), "out": f32(len(WIDTHS) * FILTERS, len(langs), scale=0.1), "bias": np.zeros(len(langs), np.float32)}
        for k in WIDTHS:
            self.w[f"f{k}"] = f32(k * EMBED, FILTERS, scale=(2 / (k * EMBED)) ** 0.5)
            self.w[f"b{k}"] = np.zeros(FILTERS, np.float32)

    def tables(self):
        """For each width the rows that each byte adds at each place of a filter."""
        return [[self.w["embed"] @ self.w[f"f{k}"][i * EMBED:(i + 1) * EMBED] for i in range(k)] for k in WIDTHS]

    def step(self, x: np.ndarray, y: np.ndarray, pad: np.ndarray):
        """Gradients and loss of a batch of windows; ``pad`` marks windows' bytes that fill up."""
        e = self.w["embed"][x]
        pooled, where, patches = [], [], []
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            patch = np.concatenate([e[:, i:i + n] for i in range(k)], axis=2)
            act = patch @ self.w[f"f{k}"] + self.w[f"b{k}"]
            best = act.argmax(1)
            pooled.append(np.maximum(np.take_along_axis(act, best[:, None], 1)[:, 0], 0))
            where.append(best)
            patches.append(patch)
        h = np.concatenate(pooled, 1)
        logits = h @ self.w["out"] + self.w["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        loss = -np.log(p[np.arange(len(y)), y] + 1e-9).mean()
        d = p.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.w["embed"])}
        dh = (d @ self.w["out"].T) * (h > 0)
        rows = np.arange(len(x))[:, None]
        for j, k in enumerate(WIDTHS):
            part = dh[:, j * FILTERS:(j + 1) * FILTERS]
            got = patches[j][rows, where[j]]  # window, filter, patch
            g[f"f{k}"] = np.einsum("nf,nfp->pf", part, got)
            g[f"b{k}"] = part.sum(0)
            back = part[:, :, None] * self.w[f"f{k}"].T[None]
            for i in range(k):
                np.add.at(g["embed"], x[rows, where[j] + i], back[:, :, i * EMBED:(i + 1) * EMBED])
        return g, loss

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 7):
        rng = np.random.default_rng(seed)
        m = {c: np.zeros_like(v) for c, v in self.w.items()}
        v = {c: np.zeros_like(v) for c, v in self.w.items()}
        for t in range(1, steps + 1):
            pick = rng.integers(0, len(x), BATCH)
            g, _ = self.step(x[pick], y[pick], None)
            for c in self.w:
                m[c] = 0.9 * m[c] + 0.1 * g[c]
                v[c] = 0.999 * v[c] + 0.001 * g[c] ** 2
                self.w[c] -= (RATE * (m[c] / (1 - 0.9**t)) / (np.sqrt(v[c] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def probabilities(self, x: np.ndarray, tables=None) -> np.ndarray:
        out = np.zeros((len(x), len(self.langs)), np.float32)
        tables = tables or self.tables()
        for at in range(0, len(x), 64):
            b = x[at:at + 64]
            pooled = []
            for k, rows in zip(WIDTHS, tables):
                n = b.shape[1] - k + 1
                act = np.take(rows[0], b[:, :n], axis=0)
                for i in range(1, k):
                    act += np.take(rows[i], b[:, i:i + n], axis=0)
                pooled.append(np.maximum(act.max(1) + self.w[f"b{k}"], 0))
            logits = np.concatenate(pooled, 1) @ self.w["out"] + self.w["bias"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            out[at:at + 64] = p / p.sum(1, keepdims=True)
        return out


def fit(docs: DataFrame, lang: Column | None = None, text: Column | None = None, max_docs: int = TRAIN_DOCS) -> Network | None:
    """Train on at most ``max_docs`` documents of each language.

    Null languages, null ids and texts without a letter are left out; the sample is the documents whose ids have the
    smallest hashes. None if nothing is left.
    """
    order = F.xxhash64(F.lit("langid"), "doc_id")
    body = (F.col("text") if text is None else text).cast("binary")
    rows = docs.filter("doc_id is not null").select(
        (F.col("lang") if lang is None else lang).alias("lang"), order.alias("k"), body.alias("t"),
        (F.col("text") if text is None else text).alias("s")).filter("lang is not null and s is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS + 1).collect()
    if not found:
        return None
    if len(found) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: is this the right column?")
    # Of each language a share of the hash range that holds a little more than max_docs.
    share = {r["lang"]: min(1.0, (1.5 * max_docs + 50) / r["count"]) for r in found}
    limit = F.create_map(*[F.lit(x) for lg, s in share.items() for x in (lg, int((s - 0.5) * 2**64) if s < 1 else 2**63 - 1)])
    n = F.octet_length("t")
    places = [F.pmod(F.xxhash64(F.lit(i), "k"), F.greatest(n - WINDOW + 1, F.lit(1))).cast("int") for i in range(TRAIN_WINDOWS)]
    cuts = F.array(*[F.substring("t", p + 1, F.lit(WINDOW)) for p in places])
    sample = (
        rows.filter((F.col("k") <= limit[F.col("lang")]) & F.col("s").rlike(r"\p{L}")).select("lang", "k", cuts.alias("cuts"))
        .orderBy("k").limit(2 * len(found) * max_docs + 100 * len(found)).collect()
    )
    langs = sorted(share)
    xs, ys, seen = [], [], dict.fromkeys(langs, 0)
    for r in sorted(sample, key=lambda r: (r["k"], r["lang"], r["cuts"])):
        if seen[r["lang"]] < max_docs:
            seen[r["lang"]] += 1
            for cut in r["cuts"]:
                xs.append(np.frombuffer(bytes(cut).ljust(WINDOW, b"\0"), np.uint8))
                ys.append(langs.index(r["lang"]))
    if not xs:
        return None
    return Network(langs).train(np.stack(xs), np.array(ys))


def _predicting(model: Network | None):
    def run(batches):
        tables = model.tables() if model else None
        for batch in batches:
            names, scores = [], []
            lettered = batch.column("lettered").to_pylist()
            for first, data, offsets in bs.slices(batch.column("t")):
                n = len(offsets) - 1
                if model is None:
                    names += [UNKNOWN] * n
                    scores += [0.0] * n
                    continue
                total, weight = np.zeros((n, len(model.langs))), np.zeros(n)
                size = np.diff(offsets)
                # Rows are cut a few at a time, one very long row a stretch at a time.
                for lo in range(0, n, 256):
                    hi = min(n, lo + 256)
                    for at in range(0, int(size[lo:hi].max()) if hi > lo else 0, 1 << 20):
                        a = np.minimum(offsets[lo:hi] + at, offsets[lo + 1:hi + 1])
                        b = np.minimum(a + (1 << 20), offsets[lo + 1:hi + 1])
                        part = np.concatenate([data[s:e] for s, e in zip(a, b)])
                        x, row, new = windows(part, np.concatenate([[0], np.cumsum(b - a)]))
                        p = model.probabilities(x, tables) * new[:, None]
                        np.add.at(total, row + lo, p)
                        np.add.at(weight, row + lo, new)
                total /= np.maximum(weight, 1)[:, None]
                best = total.argmax(1)
                for i in range(n):
                    known = lettered[first + i]
                    names.append(model.langs[best[i]] if known else UNKNOWN)
                    scores.append(min(1.0, float(total[i, best[i]])) if known else 0.0)
            if names:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Network | None, text: Column | None = None, doc_id: Column | None = None) -> DataFrame:
    """Per row: id, lang_pred, score (mean probability of that language over the text's windows).

    A null text, an empty one or one without a letter is ``und`` with score 0, and so is everything without a model.
    Repeated rows and null ids are rows like others; a very long text is worked on a stretch at a time. Only the text
    decides. Other columns are not read.
    """
    t = F.col("text") if text is None else text
    return docs.select(
        (F.col("doc_id") if doc_id is None else doc_id).cast("bigint").alias("id"), F.coalesce(t, F.lit("")).alias("t"),
        F.coalesce(t.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    ).mapInArrow(_predicting(model), "id bigint, lang_pred string, score double")
