"""LM scoring by a hierarchical Pitman-Yor model without word contexts; ``word_contexts`` adds them.

Words come from a Pitman-Yor restaurant over all words of the training texts, whose base measure is a spelling model:
restaurants for the next byte after two bytes, whose parents are the restaurants after one byte, whose parent is the
one after none, over uniform bytes. A table of the word restaurant is a customer of the spelling restaurants for each
byte of the word; a table of a context restaurant is a customer of its parent.

Seatings are sampled by Gibbs: in each sweep all customers of a dish are seated anew given everything else. The word
restaurant is a table in Spark, one row for each distinct word; a sweep is one pass over it that sends back counts of
three-byte strings, at most 2**24 of them. The spelling restaurants are that small and sit on the driver. Seatings after
the first sweeps are averaged, and the averages give the probabilities.

A text's score adds up over its words. The most frequent words, a fixed number of bounded length, travel to the tasks
that scan the texts; counts of all other words are joined with the word table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .bytesets import mix
from .common import numbered

STRENGTH, ALPHABET, SPACE = 1.0, 256, 32
SWEEPS, BURN_IN = 4, 1
# Words that travel to the tasks: so many, none longer than so many bytes.
FREQUENT_WORDS, FREQUENT_BYTES = 150_000, 48
_FLUSH = 200_000


def uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """Numbers between 0 and 1 that depend on key and turn alone."""
    x = mix(key ^ mix(np.full(len(key), turn + 1, np.uint64)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def sample_tables(customers: np.ndarray, open_weight: np.ndarray, discount: float, key: np.ndarray) -> np.ndarray:
    """Seat the customers of each dish: its number of tables.

    The n-th customer opens a table with weight ``open_weight`` against n - 1 - discount * tables. The first sixteen
    customers are seated one by one; beyond, an eighth more at a time with one chance, their new tables drawn at once
    (Poisson, normal from a mean of thirty on). That is an approximation: the mean number of tables is within five
    percent of one-by-one seating, or 0.05 tables, in the tests.
    """
    tables = (customers > 0).astype(np.float64)
    seated = tables.copy()
    turn = 0
    while True:
        i = np.flatnonzero(seated < customers)
        if not len(i):
            return tables
        step = np.minimum(np.where(seated[i] < 16, 1, seated[i] // 8), customers[i] - seated[i])
        chance = open_weight[i] / (open_weight[i] + seated[i] - discount * tables[i])
        mean, u = step * chance, uniform(key[i], 2 * turn)
        new = (u < chance).astype(np.float64)
        many = np.flatnonzero(step > 1)
        if len(many):
            m, v = mean[many], u[many]
            got = np.zeros(len(many))
            low = m < 30  # Poisson by its distribution function, else normal
            term = np.exp(-np.where(low, m, 0))
            total, k = term.copy(), 0
            while k < 200 and (go := low & (v > total)).any():
                k += 1
                term = term * m / k
                got[go] = k
                total += term
            z = np.sqrt(-2 * np.log(v)) * np.cos(2 * np.pi * uniform(key[i][many], 2 * turn + 1))
            got = np.where(low, got, np.round(m + np.sqrt(m * (1 - chance[many])) * z))
            new[many] = np.clip(got, 0, step[many])
        tables[i] += new
        seated[i] += step
        turn += 1


def discount_of(once: float, twice: float) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


class Spelling:
    """Seatings of the byte restaurants: ``codes`` are three bytes in one number, with customers and tables."""

    def __init__(self, codes: np.ndarray, customers: np.ndarray, seed: int, before: "Spelling | None" = None):
        self.codes, self.c3 = codes, customers.astype(np.float64)
        two = codes & 0xFFFF
        key = lambda x, level: mix(x.astype(np.uint64) ^ np.uint64((seed << 8 | level) << 32))
        self.d = d = discount_of((self.c3 == 1).sum(), (self.c3 == 2).sum())
        parent = before.p2[two] if before else np.full(len(codes), 1 / ALPHABET)
        total = before.k3[codes >> 8] if before else np.bincount(codes >> 8, minlength=1 << 16)[codes >> 8]
        self.t3 = sample_tables(self.c3, (STRENGTH + d * total) * parent, d, key(codes, 3))
        self.c2 = np.bincount(two, weights=self.t3, minlength=1 << 16)
        parent = np.tile(before.p1, ALPHABET) if before else np.full(1 << 16, 1 / ALPHABET)
        total = np.repeat(before.t2.reshape(ALPHABET, -1).sum(1) if before else (self.c2 > 0).reshape(ALPHABET, -1).sum(1), ALPHABET)
        self.t2 = sample_tables(self.c2, (STRENGTH + d * total) * parent, d, key(np.arange(1 << 16), 2))
        self.c1 = self.t2.reshape(ALPHABET, ALPHABET).sum(0)
        total = before.t1.sum() if before else (self.c1 > 0).sum()
        self.t1 = sample_tables(self.c1, np.full(ALPHABET, (STRENGTH + d * total) / ALPHABET), d, key(np.arange(ALPHABET), 1))
        self.predict()

    def predict(self):
        d = self.d
        share = lambda c, t, n, k, up: (c - d * t + (STRENGTH + d * k) * up) / (STRENGTH + n)
        self.p1 = share(self.c1, self.t1, self.c1.sum(), self.t1.sum(), 1 / ALPHABET)
        c, t = self.c2.reshape(ALPHABET, -1), self.t2.reshape(ALPHABET, -1)
        self.p2 = share(c, t, c.sum(1, keepdims=True), t.sum(1, keepdims=True), self.p1[None]).ravel()
        context = self.codes >> 8
        n = np.bincount(context, weights=self.c3, minlength=1 << 16)
        self.k3 = np.bincount(context, weights=self.t3, minlength=1 << 16)
        self.back = (STRENGTH + d * self.k3) / (STRENGTH + n)
        self.seen = (self.c3 - d * self.t3) / (STRENGTH + n[context])
        return self

    def log10(self, words: list[bytes]) -> np.ndarray:
        """The log10 probability of each word's bytes and its end."""
        codes, row = codes_of(words)
        p = self.back[codes >> 8] * self.p2[codes & 0xFFFF]
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            p += np.where(self.codes[at] == codes, self.seen[at], 0)
        return np.bincount(row, weights=np.log10(p), minlength=len(words))


def average(samples: list[Spelling]) -> Spelling:
    """The mean seating."""
    out = Spelling.__new__(Spelling)
    out.codes = samples[-1].codes
    out.d = float(np.mean([s.d for s in samples]))
    for name in ("c3", "t3", "c2", "t2", "c1", "t1"):  # every sweep seats the same words, so the codes are the same
        setattr(out, name, np.mean([getattr(s, name) for s in samples], axis=0))
    return out.predict()


def codes_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Three-byte numbers of each word with a blank behind and two before, and their word."""
    flat = np.frombuffer(b"  " + b"   ".join(words) + b" ", np.uint8).astype(np.int64)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n + 3) - n - 3
    row = np.repeat(np.arange(len(words)), n + 1)
    at = np.repeat(first, n + 1) + np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
    return flat[at] << 16 | flat[at + 1] << 8 | flat[at + 2], row


def _keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def _count(batches):
    """Counts of words; the end of a text is the empty word."""
    counts: Counter = Counter()
    for batch in batches:
        for t in batch.column("t"):
            counts.update(memoryview(t.as_buffer()).tobytes().lower().split())
            counts[b""] += 1
            if len(counts) > _FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])
                counts.clear()
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "c"])


class WordSeating:
    """One sweep's state of the word restaurant: seats any word from its count."""

    def __init__(self, spelling: Spelling | None, tables: float, discount: float, sweep: int):
        self.spelling, self.tables, self.d, self.sweep = spelling, tables, discount, sweep

    def seat(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        if self.spelling is None:
            return np.ones(len(words))
        weight = (STRENGTH + self.d * self.tables) * 10.0 ** self.spelling.log10(words)
        return sample_tables(counts.astype(np.float64), weight, self.d, _keys(words) ^ mix(np.array([self.sweep], np.uint64))[0])


def _spelt(seating: WordSeating):
    """Customers of the byte restaurants, and of all tables under -1."""
    def run(batches):
        codes, sums = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            words, counts = batch.column("w").to_pylist(), np.asarray(batch.column("c"))
            for lo in range(0, len(words), 4096):
                part = words[lo:lo + 4096]
                t = seating.seat(part, counts[lo:lo + 4096])
                code, row = codes_of(part)
                all_codes, where = np.unique(np.concatenate([codes, code, [-1]]), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate([sums, t[row], [t.sum()]]))
                codes = all_codes
        if len(codes):
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "n"])

    return run


class Model:
    def __init__(self, words: DataFrame, spelling: Spelling, seatings: list[WordSeating], n: int, v: int, discount: float):
        self.n, self.v = n, v
        self.spelling, self.d = spelling, discount
        self.tables = float(np.mean([s.tables_after for s in seatings])) if seatings else 0.0
        back = np.log10((STRENGTH + discount * self.tables) / (STRENGTH + n))
        self.back = float(back)

        def scored(batches):
            for batch in batches:
                got, counts = batch.column("w").to_pylist(), np.asarray(batch.column("c"))
                p, q = np.zeros(len(got)), np.zeros(len(got))
                for lo in range(0, len(got), 4096):
                    part, c = got[lo:lo + 4096], counts[lo:lo + 4096]
                    tables = np.mean([s.seat(part, c) for s in seatings], axis=0)
                    spelt = spelling.log10(part)
                    p[lo:lo + 4096] = np.log10((c - discount * tables) / (STRENGTH + n) + 10.0 ** (back + spelt))
                    q[lo:lo + 4096] = 10.0 ** spelt
                yield batch.append_column("p", pa.array(p)).append_column("q", pa.array(q))

        self.words = stage(words.mapInArrow(scored, "w binary, c bigint, p double, q double"), "lm-words") if seatings else words.selectExpr("*", "0D as p", "0D as q")
        #: All words out of training texts together.
        self.other = self.back + float(np.log10(max(1e-300, 1 - (self.words.agg(F.sum("q")).first()[0] or 0))))

    def base(self, counts):
        return np.log10((counts + 0.1) / (self.n + 0.1 * (self.v + 1)))


def fit(docs: DataFrame, text: Column | None = None, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> Model:
    """Count the words of all rows and sample seatings. No rows give a model of uniform bytes."""
    t = F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary").alias("t")
    words = stage(docs.select(t).mapInArrow(_count, "w binary, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "lm-counts")
    n, v, once, twice = words.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    n, discount = n or 0, discount_of(once, twice)
    spelling, kept_spelling, kept_seating, tables = None, [], [], float(v)
    for sweep in range(sweeps if v else 0):
        seating = WordSeating(spelling, tables, discount, sweep)
        rows = words.mapInArrow(_spelt(seating), "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # 2**24 rows at most
        rows = rows.sort_values("code")
        codes, counts = rows["code"].to_numpy(), rows["n"].to_numpy()
        tables = seating.tables_after = float(counts[0])
        spelling = Spelling(codes[1:], counts[1:], sweep, spelling)
        if sweep >= burn_in:
            kept_spelling.append(spelling)
            kept_seating.append(seating)
    if not v:
        spelling = Spelling(np.zeros(0, np.int64), np.zeros(0), 0)
        return Model(words, spelling, [], 0, 0, discount)
    return Model(words, average(kept_spelling), kept_seating, n, v, discount)


_SCORED = "rf bigint, ri bigint, w binary, times bigint, n_tokens bigint, n_known bigint, base double, score double"


def _scan(frequent: dict):
    def batch_of(rows):
        cols = list(zip(*rows))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split()[0] for c in _SCORED.split(", ")])

    def run(batches):
        known = frequent.value
        out = []
        for batch in batches:
            for rf, ri, t in zip(batch.column("rf").to_pylist(), batch.column("ri").to_pylist(), batch.column("t")):
                counts = Counter(memoryview(t.as_buffer()).tobytes().lower().split())
                counts[b""] = 1
                n = base = score = found = 0
                for w, times in counts.items():
                    n += times
                    got = known.get(w)
                    if got is None:
                        out.append((rf, ri, w, times, 0, 0, 0.0, 0.0))
                    else:
                        found += times
                        base += times * got[0]
                        score += times * got[1]
                out.append((rf, ri, None, 0, n, found, float(base), float(score)))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        if out:
            yield batch_of(out)

    return run


def _unseen(spelling: Spelling, back: float):
    """Probabilities of words that training never saw."""
    def run(batches):
        for batch in batches:
            words = batch.column("w").to_pylist()
            p = np.concatenate([back + spelling.log10(words[lo:lo + 4096]) for lo in range(0, len(words), 4096)]) if words else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("rf", "ri", "times")] + [pa.array(p)], ["rf", "ri", "times", "p"])

    return run


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count, in steps of an eighth of an octave, that at most ``most`` short words reach."""
    short = words.filter(F.octet_length("w") <= FREQUENT_BYTES).withColumn("step", F.floor(F.log2("c") * 8).cast("int"))
    total, least = 0, 10**9
    for r in sorted(short.groupBy("step").count().collect(), reverse=True):  # some hundred rows
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return short.filter(F.col("step") >= least).drop("step")


def score(
    docs: DataFrame, model: Model, text: Column | None = None, doc_id: Column | None = None, from_files: bool = False,
    frequent_words: int = FREQUENT_WORDS, open_vocabulary: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score, perplexity.

    Tokens are words (runs without blanks, A-Z lower-cased) and one end, so a null or empty text has one token. Scores
    are log10 probabilities; base_score is that of add-0.1 counts. As there, words that training never saw are one
    event, whose probability is all that the model leaves for them; with ``open_vocabulary`` each is spelt out and has
    its own. Null ids and repeated rows are rows like others. No
    rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = numbered(docs, {
        "id": (F.col("doc_id") if doc_id is None else doc_id).cast("bigint"),
        "t": F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary"),
    }, from_files, "lm-rows")
    top = _frequent(model.words, frequent_words).toPandas()
    base = model.base(top["c"].to_numpy(np.float64))
    frequent = spark.sparkContext.broadcast({bytes(w): (b, p) for w, b, p in zip(top["w"], base.tolist(), top["p"].tolist())})
    found = stage(rows.select("rf", "ri", "t").mapInArrow(_scan(frequent), _SCORED), "lm-scan")
    rare = found.filter("w is not null").select("rf", "ri", "w", "times").join(model.words.drop("q"), "w", "left")
    constant = float(np.log10(model.n + 0.1 * (model.v + 1)))
    seen = rare.filter("c is not null").select("rf", "ri", F.lit(0).cast("bigint").alias("n_tokens"), F.col("times").alias("n_known"),
                                              (F.col("times") * (F.log10(F.col("c") + 0.1) - constant)).alias("base"), (F.col("times") * F.col("p")).alias("score"))
    unseen = rare.filter("c is null").select("rf", "ri", "times", "w")
    if open_vocabulary:
        unseen = unseen.mapInArrow(_unseen(model.spelling, model.back), "rf bigint, ri bigint, times bigint, p double")
    else:
        unseen = unseen.withColumn("p", F.lit(model.other))
    unseen = unseen.select("rf", "ri", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(0).cast("bigint").alias("n_known"),
                           (F.col("times") * (F.log10(F.lit(0.1)) - constant)).alias("base"), (F.col("times") * F.col("p")).alias("score"))
    parts = found.filter("w is null").select("rf", "ri", "n_tokens", "n_known", "base", "score").union(seen).union(unseen)
    sums = parts.groupBy("rf", "ri").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "score")])
    return rows.select("rf", "ri", "id").join(sums, ["rf", "ri"]).select(
        F.col("id").alias("doc_id"), "n_tokens", "n_known",
        F.col("base").alias("base_score"), "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
