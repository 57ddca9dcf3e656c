"""Secret scans: fixed patterns, and a battery of randomness tests on everything that looks encoded.

All of it is DataFrame expressions; no Python runs on executors, no text is shuffled and no row is joined.

Runs of 20 or more encoding characters are candidates. Each has an inferred encoding and three tests against uniform
random symbols: chi-squared over the alphabet, the number of runs of high and low symbols, and the serial correlation
of neighbours. A random string must pass all three. Short strings pass easily, so passing is no proof: the same
chi-squared value is also held against text-like symbols (a noncentral distribution whose offset grows with the
length), and the false-discovery rate of calling a candidate random is controlled within each class of encoding and
length (Benjamini-Hochberg). One pass counts scores for each class, which gives a small table of limits whatever the
input; a second pass applies them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER

# Fixed patterns. Java's and other engines' ways to ignore case differ, so both cases are spelled out.
_KEYWORDS = "password passwd secret token api_?key".split()
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _KEYWORDS)
ASSIGN = rf"""({_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")

_DIGITS = "0123456789"
# name, pattern, alphabet, whether case is ignored, sum of squared symbol shares in text-like strings
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", _DIGITS + "abcdef", True, 0.100),
    ("base32", r"^[A-Z2-7]+=*$", UPPER + "234567", False, 0.066),
    ("base36", r"^([A-Z0-9]+|[a-z0-9]+)$", _DIGITS + UPPER.lower(), True, 0.066),
    ("base64", r"^[A-Za-z0-9+/]+=*$", UPPER + UPPER.lower() + _DIGITS + "+/", False, 0.066),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", UPPER + UPPER.lower() + _DIGITS + "-_", False, 0.066),
)
UNIFORM_LIMIT, SEQUENCE_LIMIT = 2.5, 3.0
FALSE_DISCOVERIES = 0.01
BINS = 20  # score bins for each unit


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _prefix(steps: Column, start: Column) -> Column:
    first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(steps, first, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def running(steps: Column) -> Column:
    """The sum of the bigints before each, in blocks of the root of their number, so appending stays cheap."""
    def body(a: Column) -> Column:
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(a) / size).cast("int") - 1)), lambda b: F.slice(a, b * size + 1, size))
        def join(bl: Column) -> Column:
            sums = F.transform(bl, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda p, q: p + q))
            return F.flatten(F.zip_with(bl, _prefix(sums, F.lit(0).cast("bigint")), _prefix))
        return let(blocks, join)
    return let(steps, body)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches as start, kind, end (code points) and the text of ``group``, in order."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.array().cast("array<string>")).alias("v"))

    def body(p: Column) -> Column:
        length = F.transform(p["m"], lambda x: F.length(x).cast("bigint"))
        gap = F.slice(F.transform(p["g"], lambda x: F.length(x).cast("bigint")), F.lit(1), F.size(p["m"]))
        def place(q: Column) -> Column:
            before = running(F.zip_with(q["l"], q["g"], lambda a, b: a + b))
            value = p["v"] if group else p["m"]
            return F.zip_with(
                F.zip_with(before, q["g"], lambda a, b: a + b), F.zip_with(q["l"], value, lambda n, v: F.struct(n.alias("n"), v.alias("v"))),
                lambda s, x: F.struct(s.alias("start"), F.lit(kind).alias("kind"), (s + x["n"]).alias("end"), x["v"].alias("value")))
        return let(F.struct(length.alias("l"), gap.alias("g")), place)

    return F.when(text.rlike(pattern), let(parts, body)).otherwise(F.array().cast(_SPAN))


def _cube_z(value: Column, freedom: Column, offset: Column) -> Column:
    """How many deviations a (noncentral) chi-squared value lies above its mean, by the cube-root approximation."""
    mean, spread = freedom + offset, 2 * (freedom + 2 * offset) / (9 * (freedom + offset) * (freedom + offset))
    return (F.pow(value / mean, F.lit(1 / 3)) - 1 + spread) / F.sqrt(spread)


def _choose(encoding: Column, values) -> Column:
    out = F.lit(None)
    for (name, *_), v in zip(ENCODINGS, values):
        out = F.when(encoding == name, F.lit(v)).otherwise(out)
    return out


def score(token: Column) -> Column:
    """encoding, n, text_z (how unlike text: the smaller, the more random) and passed (all three tests), or null."""
    encoding = F.lit(None).cast("string")
    for name, pattern, *_ in reversed(ENCODINGS):
        encoding = F.when(token.rlike(pattern), F.lit(name)).otherwise(encoding)

    def counted(e: Column) -> Column:
        bare = F.rtrim(token, F.lit("="))
        symbols = F.when(_choose(e, [x[3] for x in ENCODINGS]), F.lower(bare)).otherwise(bare)
        alphabet = _choose(e, [x[2] for x in ENCODINGS])
        same = _choose(e, [x[4] for x in ENCODINGS])
        return let(F.struct(symbols.alias("s"), alphabet.alias("a"), same.alias("same"), e.alias("e")), tested)

    def tested(v: Column) -> Column:
        n, size = F.length(v["s"]).cast("double"), F.length(v["a"]).cast("double")
        squares = F.aggregate(
            F.split(v["a"], ""), F.lit(0.0),
            lambda t, c: t + F.pow((F.length(v["s"]) - F.length(F.replace(v["s"], c, F.lit("")))).cast("double"), F.lit(2)))
        def judged(u: Column) -> Column:
            uniform = _cube_z(u, size - 1, F.lit(0.0))
            text = _cube_z(u, size - 1, n * (size * v["same"] - 1))
            values = F.transform(F.split(v["s"], ""), lambda c: (F.instr(v["a"], c) - 1).cast("double"))
            sequence = let(values, lambda x: _sequence_passes(x, n, size))
            return F.struct(v["e"].alias("encoding"), n.cast("bigint").alias("n"), text.alias("text_z"),
                            F.when(uniform <= UNIFORM_LIMIT, sequence).otherwise(F.lit(False)).alias("passed"))
        return let(squares * size / n - n, judged)

    return F.when(token.rlike("|".join(x[1] for x in ENCODINGS)), let(encoding, counted))


def _sequence_passes(x: Column, n: Column, size: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda p, q: p + q)
    pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    high = lambda a: a >= size / 2
    changes = F.aggregate(pairs, F.lit(0.0), lambda p, q: p + (high(q["a"]) != high(q["b"])).cast("double"))
    many = total(F.transform(x, lambda a: high(a).cast("double")))
    sums = F.struct(changes.alias("c"), many.alias("h"), total(x).alias("s"), total(F.transform(x, lambda a: a * a)).alias("ss"),
                    F.aggregate(pairs, F.lit(0.0), lambda p, q: p + q["a"] * q["b"]).alias("ab"))

    def judge(t: Column) -> Column:
        low = n - t["h"]
        expected = 2 * t["h"] * low / n
        variance = (2 * t["h"] * low * (2 * t["h"] * low - n)) / (n * n * (n - 1))
        runs = F.when(variance > 0, F.abs(t["c"] - expected) / F.sqrt(variance)).otherwise(F.lit(99.0))
        spread = t["ss"] - t["s"] * t["s"] / n
        serial = F.when(spread > 0, F.abs(t["ab"] - (n - 1) * t["s"] * t["s"] / (n * n)) / spread * F.sqrt(n)).otherwise(F.lit(99.0))
        return (runs <= SEQUENCE_LIMIT) & (serial <= SEQUENCE_LIMIT)

    return let(sums, judge)


def _class(encoding: Column, n: Column) -> Column:
    return F.concat(encoding, F.lit("/"), F.floor(F.log2(n.cast("double"))).cast("string"))


def _bin(z: Column) -> Column:
    return F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z)) * BINS).cast("int")


def limits(counts: dict[str, dict[int, int]], rate: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """For each class the last score bin that counts as random: the largest one at which the candidates expected by
    chance, by the bin's upper end, are at most ``rate`` of those found."""
    out = {}
    for name, bins in counts.items():
        total, found = sum(bins.values()), 0
        for b in sorted(bins):
            found += bins[b]
            p = 0.5 * math.erfc(-((b + 1) / BINS) / math.sqrt(2))
            if p * total <= rate * found:
                out[name] = b
    return out


def _candidates(text: Column) -> Column:
    return F.transform(spans(text, CANDIDATE, 3), lambda s: F.struct(s.alias("span"), score(s["value"]).alias("score")))


def fit(docs: DataFrame, text: Column | None = None, rate: float = FALSE_DISCOVERIES) -> dict[str, int]:
    """Limits from the candidates of all rows. The driver gets counts of some score bins for each class of length."""
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    found = docs.select(F.explode(_candidates(t)).alias("c")).filter("c.score is not null").select(
        _class(F.col("c.score.encoding"), F.col("c.score.n")).alias("class"), _bin(F.col("c.score.text_z")).alias("bin"))
    counts: dict[str, dict[int, int]] = {}
    for r in found.groupBy("class", "bin").count().collect():
        counts.setdefault(r["class"], {})[r["bin"]] = r["count"]
    return limits(counts, rate)


def scan(docs: DataFrame, limit: dict[str, int], text: Column | None = None, doc_id: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans.

    Spans are code points, end exclusive. Random spans are those that no fixed pattern's span touches. A null text is
    empty and has none; null ids and repeated rows are rows like others. Other columns are not read.
    """
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    base = F.sort_array(F.concat(
        F.filter(spans(t, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST), spans(t, ACCESS, 1), spans(t, HEX, 2)))
    if limit:
        table = F.create_map(*[F.lit(x) for kv in sorted(limit.items()) for x in kv])
        random = lambda c: c["score"]["passed"] & (_bin(c["score"]["text_z"]) <= F.coalesce(table[_class(c["score"]["encoding"], c["score"]["n"])], F.lit(-10**6)))
        extra = F.transform(F.filter(_candidates(t), lambda c: F.coalesce(random(c), F.lit(False))), lambda c: c["span"])
    else:
        extra = F.array().cast(_SPAN)

    def result(b: Column) -> Column:
        own = F.filter(b["extra"], lambda x: ~F.exists(b["base"], lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
        return F.struct(b["base"].alias("base"), own.alias("extra"))

    def joined(a: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))

    count = lambda a, k: F.size(F.filter(a, lambda s: s["kind"] == k)).cast("bigint")
    packed = let(let(F.struct(base.alias("base"), extra.alias("extra")), result), lambda r: F.struct(
        count(r["base"], 0).alias("n_assign"), count(r["base"], 1).alias("n_access"), count(r["base"], 2).alias("n_hex"),
        F.size(r["extra"]).cast("bigint").alias("n_random"), F.sha2(joined(r["base"]), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(r["base"], r["extra"]))).alias("spans")))
    return docs.select((F.col("doc_id") if doc_id is None else doc_id).cast("bigint").alias("doc_id"), F.inline(F.array(packed)))
