"""LM scoring by a hierarchical Pitman-Yor model over word contexts.

Every word before a word has a restaurant of its own for the word that follows. Their common parent is the restaurant of
all words, whose base measure is the spelling model of ``pitman_yor``: a table of a context is a customer of the word
restaurant, a table of the word restaurant is a customer of the spelling restaurants for each byte of the word. The
start and the end of a text are the empty word.

Texts are cut into words once, in portions; a row of a staged table holds a portion's distinct words and the number of
each token among them. Words are dealt to parts by their hash, where they get numbers, equal just for equal words; pairs of
numbers are dealt to parts of their own by context, those of very frequent contexts by both words. A row that travels
is an array for one part: a portion's words or pairs, or the values that a part of pairs needs or has for a part of words.

Seatings are sampled by Gibbs: in each sweep the customers of every pair of words, then of every word, are seated anew
given the tables of the other levels. A pair seen once has one table whatever the draw, so only pairs seen more often
are visited. Customers and tables of the sweeps after the first are averaged, and the averages give the probabilities.

A text's score adds up over its pairs. The most frequent pairs, a fixed number, travel to the tasks that hold the
portions; the distinct others of each portion are asked for where the pairs are, and their counts come back. A pair that
training never saw has the probability that its context leaves times that of the word, which may be unseen too.
"""

from __future__ import annotations

from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.framing import flat
from ..storage import remove_staged, stage
from .bytesets import hashes, mix
from .pitman_yor import BURN_IN, STRENGTH, SWEEPS, Spelling, WordSeating, _keys, average, codes_of, discount_of, sample_tables

# Pairs that travel to the tasks.
FREQUENT_PAIRS = 500_000
# Bytes of text in a portion; a longer text is one of its own.
PORTION_BYTES = 8 << 20
# So many distinct words of portions, and tokens, for each part of words and of pairs.
PART_WORDS, PART_TOKENS = 400_000, 2_000_000
# Pairs of a context with more tokens are dealt by both words.
HEAVY = 1_000_000
_FAN = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the number of each token among them in order, and the tokens of each text.

    Words are runs without blanks, A-Z lower-cased; each text has one more token, its end. That is the empty word, the
    last of the distinct ones.
    """
    data, offsets = flat(texts)
    solid = np.concatenate([[False], ~_BLANK[data], [False]])
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside, before, after = solid[1:-1], solid[:-2], solid[2:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(lengths.astype(np.int64)), pa.py_buffer(_LOWER[data[inside]])]).dictionary_encode()
    kinds = pa.concat_arrays([words.dictionary.cast(pa.binary()), pa.array([b""], pa.binary())])
    n = np.bincount(np.searchsorted(offsets, starts, side="right") - 1, minlength=len(texts)) + 1
    tokens = np.full(len(starts) + len(texts), len(kinds) - 1, np.int64)
    word = np.ones(len(tokens), bool)
    word[np.cumsum(n) - 1] = False
    tokens[word] = words.indices.to_numpy()
    return kinds, tokens, n


def _portions(batches, name: str, most: int = PORTION_BYTES):
    """Batches in slices of at most so many bytes in a column; a longer text is a slice of its own."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column(name)).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


# Arrays travel as bytes. Those of whole numbers are compressed: the steps of rising ones, in as few bytes as hold all,
# first bytes together, then second ones and so on.


def _put(x) -> bytes:
    x = np.asarray(x)
    if x.dtype.kind != "i":
        return x.tobytes()
    steps = np.diff(x, prepend=0)
    rising = bool(len(x)) and steps.min() >= 0
    x = steps if rising else x
    width = next(w for w in (1, 2, 4, 8) if not len(x) or -(1 << 8 * w - 1) <= x.min() and x.max() < 1 << 8 * w - 1)
    return bytes([width + 16 * rising]) + _squeeze(x.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T.tobytes())


def _ints(b: bytes) -> np.ndarray:
    rising, width = divmod(b[0], 16)
    x = np.frombuffer(_expand(b[1:]), np.uint8).reshape(width, -1).T.copy().view(f"<i{width}").ravel().astype(np.int64)
    return np.cumsum(x) if rising else x


def _squeeze(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.compress(b, "zstd", asbytes=True)


def _expand(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _reals(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.float64)


def _joined(arrays, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _put_words(words: pa.Array) -> tuple[bytes, bytes]:
    data, offsets = flat(words)
    return _squeeze(data.tobytes()), _put(np.diff(offsets))


def _get_words(data: list[bytes], lengths: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(_joined(map(_ints, lengths)))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(map(_expand, data)))])


def _schema(*columns: str) -> str:
    """Columns of bytes, and those named ``to``, ``part``, ``pid`` or ``n_...`` of whole numbers."""
    return ", ".join(f"{c} {'bigint' if c in ('to', 'part', 'pid') or c.startswith('n_') else 'binary'}" for c in columns)


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = [c.split() for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types[k]) for c, k in kinds], [c for c, _ in kinds])


def _gather(key: str, schema: str, run, *frames: DataFrame) -> DataFrame:
    """``run`` gets the rows of ``frames`` that share a ``key``, as dicts in no order, and yields rows of ``schema``.

    All rows have the columns that any frame has.
    """
    def together(table):
        return pa.Table.from_batches([_batch(list(run(table.to_pylist())), schema)])

    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return union.groupBy(key).applyInArrow(together, schema)


def _map(frame: DataFrame, schema: str, run) -> DataFrame:
    """``run`` yields rows of ``schema`` for each row of ``frame``, both as dicts."""
    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for row in run(batch.slice(i, 1).to_pylist()[0]):
                    yield _batch([row], schema)

    return frame.mapInArrow(each, schema)


# Portions of texts.

_PORTION = _schema("pid", "n_kinds", "n_tokens", "n_end", "ids", "nulls", "sizes", "tokens", "words", "lengths", "counts", "slots")


def _cut(batches):
    """A row for each portion: its distinct words by ``slots``, the leading 16 bits of their hash, and its tokens."""
    pid = TaskContext.get().partitionId() << 32
    for portion in _portions(batches, "t"):
        kinds, tokens, n = tokens_of(portion.column("t"))
        data, offsets = flat(kinds)
        slots = hashes(data, offsets[:-1], offsets[1:]) >> np.uint64(48)
        order = np.argsort(slots.astype(np.uint16), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        words, lengths = _put_words(kinds.take(pa.array(order)))
        ids = portion.column("id")
        yield _batch([{
            "pid": pid, "n_kinds": len(kinds), "n_tokens": len(tokens), "n_end": int(rank[-1]),
            "ids": _put(pc.fill_null(ids, 0).to_numpy()), "nulls": _put(ids.is_null().to_numpy(zero_copy_only=False)),
            "sizes": _put(n), "tokens": _put(rank[tokens]), "words": words, "lengths": lengths,
            "counts": _put(np.bincount(rank[tokens], minlength=len(kinds))), "slots": _put(slots[order].astype(np.int64))}], _PORTION)
        pid += 1


_ASKED_WORDS = _schema("part", "pid", "words", "lengths", "counts")


def _ask_words(parts: int):
    def run(row):
        lengths, counts = _ints(row["lengths"]), _ints(row["counts"])
        cuts = np.searchsorted(_ints(row["slots"]) * parts // _FAN, np.arange(parts + 1))
        at, words = np.concatenate([[0], np.cumsum(lengths)]), _expand(row["words"])
        for j in np.flatnonzero(np.diff(cuts)).tolist():
            lo, hi = cuts[j], cuts[j + 1]
            yield {"part": j, "pid": row["pid"], "words": _squeeze(words[at[lo]:at[hi]]), "lengths": _put(lengths[lo:hi]), "counts": _put(counts[lo:hi])}

    return run


# Words get numbers in their part; row -1 of a part has its words.
_NUMBERED = _schema("pid", "part", "n_words", "ids", "heavy", "words", "lengths", "c")


def _number_words(heavy: int):
    def run(rows):
        asked = _get_words([r["words"] for r in rows], [r["lengths"] for r in rows]).dictionary_encode()
        ids = asked.indices.to_numpy().astype(np.int64)
        c = np.bincount(ids, weights=_joined(_ints(r["counts"]) for r in rows), minlength=len(asked.dictionary)).astype(np.int64)
        words, lengths = _put_words(asked.dictionary)
        part, lo = rows[0]["part"], 0
        yield {"pid": -1, "part": part, "n_words": len(c), "words": words, "lengths": lengths, "c": _put(c)}
        for r in rows:
            own = ids[lo:(lo := lo + len(_ints(r["lengths"])))]
            yield {"pid": r["pid"], "part": part, "ids": _put(own), "heavy": _put(c[own] > heavy)}

    return run


class _Numbers:
    """Where the numbers of each part of words begin, and how pairs are dealt."""

    def __init__(self, offsets: np.ndarray, parts: int, heavy: int):
        self.offsets, self.n, self.parts, self.heavy = offsets, int(offsets[-1]), parts, heavy

    def of(self, rows) -> np.ndarray:
        """Numbers of a portion's words, -1 for unknown ones, from the parts' rows in order."""
        return _joined(np.where(x < 0, -1, x + self.offsets[r["part"]]) for r in rows for x in [_ints(r["ids"])])

    def part_of(self, u, w, heavy) -> np.ndarray:
        return (mix(np.where(heavy, u * self.n + w, u).astype(np.uint64)) % np.uint64(self.parts)).astype(np.int64)

    def cuts(self, ids) -> np.ndarray:
        """Where ascending numbers pass from one part of words to the next."""
        return np.searchsorted(ids, self.offsets)


def _split(rows):
    """A portion's own row, and the rows of parts of words in order."""
    own = next(r for r in rows if r["tokens"] is not None)
    return own, sorted((r for r in rows if r["ids"] is not None and r["tokens"] is None), key=lambda r: r["part"])


def _pairs_of(own, **also) -> tuple:
    """The tokens of a portion, the distinct pairs (by the portion's words) and what ``np.unique`` tells besides."""
    tokens = _ints(own["tokens"])
    return tokens, *np.unique(np.concatenate([[own["n_end"]], tokens[:-1]]) * own["n_kinds"] + tokens, **also)


def _dealt(part: np.ndarray):
    """The parts that occur, with the places of each in order."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < _FAN else part, kind="stable")
    bounds = np.flatnonzero(np.diff(part[order], prepend=-1))
    return zip(part[order[bounds]].tolist(), np.split(order, bounds[1:])) if len(part) else ()


_COUNTED = _schema("part", "u", "w", "c")


def _count_pairs(numbers: _Numbers):
    def run(rows):
        own, replies = _split(rows)
        ids, heavy = numbers.of(replies), np.concatenate([np.frombuffer(r["heavy"], bool) for r in replies])
        _, codes, c = _pairs_of(own, return_counts=True)
        a, b = np.divmod(codes, own["n_kinds"])
        u, w = ids[a], ids[b]
        order = np.argsort(u * numbers.n + w)
        u, w, c, heavy = u[order], w[order], c[order], heavy[a[order]]
        for i, at in _dealt(numbers.part_of(u, w, heavy)):
            yield {"part": i, "u": _put(u[at]), "w": _put(w[at]), "c": _put(c[at])}

    return run


# A part of pairs has a row -1 with its pairs: those seen once, and of the others distinct contexts ``u`` and words ``w``, and
# the place of each pair's in these. Its row for each part of words has the numbers of single and other pairs of each
# context and word there, and the contexts and words of pairs seen more than once.
_PAIRS = _schema("to", "part", "n_once", "n_twice", "u1", "w1", "u", "w", "at_u", "at_w", "c", "us", "us_one", "us_more", "ws", "ws_one", "ws_more")


def _collect_pairs(numbers: _Numbers):
    def run(rows):
        keys = _joined(_ints(r["u"]) * numbers.n + _ints(r["w"]) for r in rows)
        order = np.argsort(keys, kind="stable")
        keys, c = keys[order], _joined(_ints(r["c"]) for r in rows)[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        u, w = np.divmod(keys[first], numbers.n)
        c = np.add.reduceat(c, first)
        one = c == 1
        us, at_us = np.unique(u, return_inverse=True)
        ws, at_ws = np.unique(w, return_inverse=True)
        seen = [(ids, np.bincount(at[one], minlength=len(ids)), np.bincount(at[~one], minlength=len(ids))) for ids, at in ((us, at_us), (ws, at_ws))]
        two_u, at_u = np.unique(u[~one], return_inverse=True)
        two_w, at_w = np.unique(w[~one], return_inverse=True)
        i = rows[0]["part"]
        yield {"to": -1, "part": i, "n_once": int(one.sum()), "n_twice": int((c == 2).sum()), "u1": _put(u[one]), "w1": _put(w[one]),
               "u": _put(two_u), "w": _put(two_w), "at_u": _put(at_u), "at_w": _put(at_w), "c": _put(c[~one])}
        slices = [(f"{name}{end}", x, numbers.cuts(ids)) for name, (ids, *sums) in zip(("us", "ws"), seen) for end, x in zip(("", "_one", "_more"), (ids, *sums))]
        slices += [("u", two_u, numbers.cuts(two_u)), ("w", two_w, numbers.cuts(two_w))]
        for j in range(len(numbers.offsets) - 1):
            row = {name: _put(x[cuts[j]:cuts[j + 1]]) for name, x, cuts in slices if cuts[j] < cuts[j + 1]}
            if row:
                yield {"to": j, "part": i} | {name: row.get(name, _put(np.zeros(0, np.int64))) for name, _, _ in slices}

    return run


# The state of a part of words. Numbers of customers and tables are whole.
_REALS = ("ones_u", "rooms", "all_rooms", "ones_w", "customers", "tables", "all_customers", "all_tables")
_STATE = _schema("part", "n_words", "words", "lengths", "c", *_REALS, "codes", "spelt") + ", n double, t double"


def _parts(words: pa.Array, size: int = 4096):
    """Slices of so many words, and these as bytes."""
    data, offsets = flat(words)
    for lo in range(0, len(words), size):
        bounds = offsets[lo:lo + size + 1]
        some, bounds = data[bounds[0]:bounds[-1]].tobytes(), (bounds - bounds[0]).tolist()
        yield slice(lo, lo + size), [some[a:b] for a, b in zip(bounds, bounds[1:])]


def _seat(words: pa.Array, x: dict, seating: WordSeating, kept: bool) -> dict:
    """Tables of each word from its customers, and customers of the byte restaurants."""
    x["tables"], spelt = np.zeros(len(words)), np.zeros(1 << 24)
    for at, some in _parts(words):
        x["tables"][at] = seating.seat(some, x["customers"][at])
        code, row = codes_of(some)
        np.add.at(spelt, code, x["tables"][at][row])
    codes = np.flatnonzero(spelt)
    for name, now in (("all_rooms", "rooms"), ("all_customers", "customers"), ("all_tables", "tables")):
        x[name] = x[name] + kept * x[now]
    return {n: _put(x[n].astype(np.int64)) for n in _REALS} | {"codes": _put(codes), "spelt": _put(spelt[codes]), "n": float(x["customers"].sum()), "t": float(x["tables"].sum())}


def _first_state(numbers: _Numbers, seating: WordSeating, kept: bool):
    def run(rows):
        own = next(r for r in rows if r["n_words"] is not None)
        lo, n = numbers.offsets[own["part"]], own["n_words"]
        x = {name: np.zeros(n) for name in _REALS}
        for r in rows:
            if r["us"] is not None:
                us, ws = _ints(r["us"]) - lo, _ints(r["ws"]) - lo
                x["ones_u"][us] += _ints(r["us_one"])
                x["rooms"][us] += _ints(r["us_one"]) + _ints(r["us_more"])
                x["ones_w"][ws] += _ints(r["ws_one"])
                x["customers"][ws] += _ints(r["ws_one"]) + _ints(r["ws_more"])
        words = _get_words([own["words"]], [own["lengths"]])
        yield {k: own[k] for k in ("part", "n_words", "words", "lengths", "c")} | _seat(words, x, seating, kept)

    return run


def _next_state(numbers: _Numbers, seating: WordSeating, kept: bool):
    def run(rows):
        own = next(r for r in rows if r["n_words"] is not None)
        lo = numbers.offsets[own["part"]]
        x = {name: _ints(own[name]).astype(np.float64) for name in _REALS}
        x["rooms"], x["customers"] = x["ones_u"].copy(), x["ones_w"].copy()
        for r in rows:
            if r["u"] is not None:
                x["rooms"][_ints(r["u"]) - lo] += _ints(r["tu"])
                x["customers"][_ints(r["w"]) - lo] += _ints(r["tw"])
        words = _get_words([own["words"]], [own["lengths"]])
        yield {k: own[k] for k in ("part", "n_words", "words", "lengths", "c")} | _seat(words, x, seating, kept)

    return run


def _price(words: pa.Array, customers, tables, spelling: Spelling, n: float, rooms: float, discount: float, times: int = 1):
    """The probability of each word in the word restaurant, and that of its spelling alone."""
    q = np.zeros(len(words))
    for at, some in _parts(words):
        q[at] = 10.0 ** spelling.log10(some)
    return ((customers - discount * tables) / times + (STRENGTH + discount * rooms) * q) / (STRENGTH + n), q


_PRICED = _schema("part", "pid", "rooms", "key_u", "p", "key_w")


def _send_prices(numbers: _Numbers, spelling: Spelling, n: float, rooms: float, discount: float):
    """What each part of pairs needs of a part of words, whose number is ``pid``."""
    def run(rows):
        own = next(r for r in rows if r["n_words"] is not None)
        lo = numbers.offsets[own["part"]]
        words = _get_words([own["words"]], [own["lengths"]])
        p, _ = _price(words, _ints(own["customers"]), _ints(own["tables"]), spelling, n, rooms, discount)
        open_tables, keys = _ints(own["rooms"]), np.concatenate([_keys(some) for _, some in _parts(words)])
        for r in rows:
            if r["n_words"] is None:
                u, w = _ints(r["u"]) - lo, _ints(r["w"]) - lo
                yield {"part": r["of"], "pid": own["part"], "rooms": _put(open_tables[u]), "key_u": _put(keys[u]), "p": _put(p[w]), "key_w": _put(keys[w])}

    return run


# Row -1 of a part of pairs has all tables of its pairs so far; others have the new ones of each context and word.
_SEATED = _schema("to", "part", "all_t", "u", "w", "tu", "tw")


def _seat_pairs(numbers: _Numbers, discount: float, sweep: int, kept: bool, first: int):
    """``first``: the tables that count of the first sweep, in which every pair has one."""
    def run(rows):
        own = next(r for r in rows if r["at_u"] is not None)
        before = next((r["all_t"] for r in rows if r.get("all_t") is not None), None)
        prices = sorted((r for r in rows if r["rooms"] is not None), key=lambda r: r["pid"])
        at_u, at_w, c, ids_u, ids_w = (_ints(own[k]) for k in ("at_u", "at_w", "c", "u", "w"))
        rooms, p = _joined(_ints(r["rooms"]) for r in prices), _joined((_reals(r["p"]) for r in prices), np.float64)
        key_u, key_w = (_joined((np.frombuffer(r[k], np.uint64) for r in prices), np.uint64) for k in ("key_u", "key_w"))
        key = mix(key_u[at_u] ^ mix(key_w[at_w])) ^ mix(np.array([sweep], np.uint64))[0]
        t = sample_tables(c.astype(np.float64), (STRENGTH + discount * rooms[at_u]) * p[at_w], discount, key)
        whole = t.astype(np.int64)
        yield {"to": -1, "part": own["part"], "all_t": _put((first if before is None else _ints(before)) + kept * whole)}
        tu, tw = (np.bincount(at, weights=t, minlength=len(ids)).astype(np.int64) for at, ids in ((at_u, ids_u), (at_w, ids_w)))
        cuts_u, cuts_w = numbers.cuts(ids_u), numbers.cuts(ids_w)
        for j in np.flatnonzero(np.diff(cuts_u) + np.diff(cuts_w)).tolist():
            some_u, some_w = slice(cuts_u[j], cuts_u[j + 1]), slice(cuts_w[j], cuts_w[j + 1])
            yield {"to": j, "part": own["part"], "u": _put(ids_u[some_u]), "tu": _put(tu[some_u]), "w": _put(ids_w[some_w]), "tw": _put(tw[some_w])}

    return run


_LAST = _schema("part", "n_words", "words", "lengths", "c", "rooms", "p") + ", q double"


def _last_state(spelling: Spelling, n: float, rooms: float, discount: float, times: int):
    def run(own):
        p, q = _price(_get_words([own["words"]], [own["lengths"]]), _ints(own["all_customers"]), _ints(own["all_tables"]), spelling, n, rooms, discount, times)
        yield {k: own[k] for k in ("part", "n_words", "words", "lengths", "c")} | {"rooms": own["all_rooms"], "p": _put(p), "q": float(q.sum())}

    return run


# Files of a shuffle go when its query has run, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _stage(rows: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``stage``, keeping no file of the shuffles."""
    conf = rows.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return stage(rows, f"lm-{name}", paths)
    finally:
        conf.set(_CLEANUP, before)


class _Tables:
    """Staged tables by name: a new one takes the place of the one before, which is deleted."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def put(self, rows: DataFrame, name: str) -> DataFrame:
        paths: list[str] = []
        staged = _stage(rows, name, paths)
        self.drop(name)
        self.paths[name] = paths
        return staged

    def drop(self, *names: str) -> None:
        for name in names:
            remove_staged(self.spark, self.paths.pop(name, []))


def _left(c: np.ndarray, rooms: np.ndarray, discount: float, times: int) -> np.ndarray:
    """The share that contexts seen ``c`` times leave to their parent; ``rooms`` are their tables in ``times`` sweeps."""
    return (STRENGTH + discount * rooms / times) / (c + STRENGTH)


class ContextModel:
    """The averaged seating: parts of words and of pairs, and what is common to them."""

    def __init__(self, n: int, states: DataFrame, blocks: DataFrame, seated: DataFrame, numbers: _Numbers, word_parts: int,
                 spelling: Spelling, back: float, discount: float, times: int):
        self.n, self.v, self.states, self.blocks, self.seated, self.numbers, self.word_parts = n, numbers.n, states, blocks, seated, numbers, word_parts
        self.spelling, self.back, self.discount, self.times = spelling, back, discount, times
        #: All words out of training texts together, in the word restaurant.
        self.other = back + float(np.log10(max(1e-300, 1 - (states.agg(F.sum("q")).first()[0] or 0))))

    @cached_property
    def _rows(self) -> DataFrame:
        offsets, discount, times = self.numbers.offsets, self.discount, self.times

        def words(batches):
            for batch in batches:
                for r in batch.to_pylist():
                    c = _ints(r["c"])
                    columns = [pa.array(offsets[r["part"]] + np.arange(len(c))), _get_words([r["words"]], [r["lengths"]]).cast(pa.binary()), pa.array(c),
                               pa.array(np.log10(_reals(r["p"]))), pa.array(np.log10(_left(c, _ints(r["rooms"]), discount, times)))]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "w", "c", "p", "back"])

        return self.states.mapInArrow(words, "id bigint, w binary, c bigint, p double, back double")

    @property
    def words(self) -> DataFrame:
        """w, c and the log10 probability p in the word restaurant."""
        return self._rows.select("w", "c", "p")

    @property
    def contexts(self) -> DataFrame:
        """u and the log10 share that it leaves to its parent."""
        return self._rows.select(F.col("w").alias("u"), "back")

    @property
    def pairs(self) -> DataFrame:
        """u, w, c, the word's own count and log10 probability behind u."""
        found = _gather("part", "u bigint, w bigint, c bigint, t bigint", _pair_rows(self.times), self.blocks, self.seated)
        before = self._rows.select(F.col("id").alias("u"), F.col("w").alias("first"), (F.col("c") + STRENGTH).alias("places"), F.pow(F.lit(10.0), "back").alias("left"))
        own = self._rows.select(F.col("id").alias("w"), F.col("w").alias("second"), F.col("c").alias("own"), F.pow(F.lit(10.0), "p").alias("p"))
        share = (F.col("c") - self.discount * F.col("t") / self.times) / F.col("places") + F.col("left") * F.col("p")
        return found.join(before, "u").join(own, "w").select(F.col("first").alias("u"), F.col("second").alias("w"), "c", "own", F.log10(share).alias("p"))


def _all_pairs(rows, times: int):
    """Context, word, count and tables of all pairs of a part, those seen once first."""
    own = next(r for r in rows if r["at_u"] is not None)
    all_t = next((r["all_t"] for r in rows if r["all_t"] is not None), None)
    u1, c = _ints(own["u1"]), _ints(own["c"])
    u = np.concatenate([u1, _ints(own["u"])[_ints(own["at_u"])]])
    w = np.concatenate([_ints(own["w1"]), _ints(own["w"])[_ints(own["at_w"])]])
    t = np.full(len(c), times) if all_t is None else _ints(all_t)
    return u, w, np.concatenate([np.ones(len(u1), np.int64), c]), np.concatenate([np.full(len(u1), times), t])


def _pair_rows(times: int):
    def run(rows):
        u, w, c, t = _all_pairs(rows, times)
        for row in zip(u.tolist(), w.tolist(), c.tolist(), t.tolist()):
            yield dict(zip("uwct", row))

    return run


def _portioned(docs: DataFrame, text: Column | None, doc_id: Column, tables: _Tables) -> DataFrame:
    t = F.coalesce(F.col("text") if text is None else text, F.lit("")).cast("binary").alias("t")
    return tables.put(docs.select(doc_id.cast("bigint").alias("id"), t).mapInArrow(_cut, _PORTION), "portions")


def _asked_words(portions: DataFrame, parts: int) -> DataFrame:
    return _map(portions.select("pid", "words", "lengths", "counts", "slots"), _ASKED_WORDS, _ask_words(parts))


def _some(rows: DataFrame, *names: str) -> DataFrame:
    return rows.select("pid", "n_kinds", "n_end", "tokens", *names)


def fit(docs: DataFrame, text: Column | None = None, sweeps: int = SWEEPS, burn_in: int = BURN_IN) -> ContextModel:
    """Count the pairs of all rows and sample seatings. No rows give a model of uniform bytes."""
    if not 0 <= burn_in < sweeps:
        raise ValueError("burn_in must be below sweeps")
    tables, times = _Tables(docs.sparkSession), sweeps - burn_in
    portions = _portioned(docs, text, F.lit(None), tables)
    n_kinds, n = portions.agg(F.sum("n_kinds"), F.sum("n_tokens")).first()
    if not n:
        none = docs.sparkSession.createDataFrame([], _LAST)
        empty = docs.sparkSession.createDataFrame([], _schema("part", "u1", "w1", "u", "w", "at_u", "at_w", "c", "all_t"))
        return ContextModel(0, none, empty.drop("all_t"), empty.select("part", "all_t"), _Numbers(np.zeros(2, np.int64), 1, HEAVY), 1, Spelling(np.zeros(0, np.int64), np.zeros(0), 0), 0.0, 0.5, 1)
    word_parts, pair_parts = min(_FAN, -(-n_kinds // PART_WORDS)), -(-n // PART_TOKENS)
    numbered = tables.put(_gather("part", _NUMBERED, _number_words(HEAVY), _asked_words(portions, word_parts)), "numbered")
    sizes = np.zeros(word_parts + 1, np.int64)
    words = numbered.filter("pid = -1")
    for r in words.select("part", "n_words").collect():
        sizes[r["part"] + 1] = r["n_words"]
    numbers = _Numbers(np.cumsum(sizes), pair_parts, HEAVY)
    if numbers.n > 3_000_000_000:
        raise ValueError("pairs of so many words have no numbers of eight bytes")
    replies = numbered.filter("pid >= 0").select("pid", "part", "ids", "heavy")
    counted = _gather("pid", _COUNTED, _count_pairs(numbers), _some(portions), replies)
    blocks = tables.put(_gather("part", _PAIRS, _collect_pairs(numbers), counted), "pairs")
    tables.drop("portions")
    own = blocks.filter("to = -1").select("part", "u", "w", "at_u", "at_w", "c")
    once, twice = blocks.filter("to = -1").agg(F.sum("n_once"), F.sum("n_twice")).first()
    pair_d, word_d = discount_of(once, twice), 0.5
    spelling, kept_spelling, rooms, all_n, all_rooms, seated = None, [], 0.0, 0.0, 0.0, None
    for sweep in range(sweeps):
        kept = sweep >= burn_in
        if sweep:
            lists = blocks.filter("to >= 0").select(F.col("to").alias("part"), F.col("part").alias("of"), "u", "w")
            prices = _gather("part", _PRICED, _send_prices(numbers, spelling, n_now, rooms, word_d),
                             states.select("part", "n_words", "words", "lengths", "rooms", "customers", "tables"), lists)
            so_far = [] if seated is None else [seated.filter("to = -1").select("part", "all_t")]
            seated = tables.put(_gather("part", _SEATED, _seat_pairs(numbers, pair_d, sweep, kept, int(not burn_in)), own, prices, *so_far), "seated")
            news = seated.filter("to >= 0").select(F.col("to").alias("part"), "u", "w", "tu", "tw")
            states = _gather("part", _STATE, _next_state(numbers, WordSeating(spelling, rooms, word_d, sweep), kept), states.drop("codes", "spelt", "n", "t"), news)
        else:
            seen = blocks.filter("to >= 0").select(F.col("to").alias("part"), "us", "us_one", "us_more", "ws", "ws_one", "ws_more")
            states = _gather("part", _STATE, _first_state(numbers, WordSeating(None, rooms, word_d, sweep), kept), words.select("part", "n_words", "words", "lengths", "c"), seen)
        states = tables.put(states, "states")
        if not sweep:
            tables.drop("numbered")
            word_d = discount_of(*states.select("customers").mapInArrow(_kinds, "once bigint, twice bigint").agg(F.sum("once"), F.sum("twice")).first())
        n_now, rooms = states.agg(F.sum("n"), F.sum("t")).first()
        rows = states.select("codes", "spelt").mapInArrow(_codes, "code bigint, n double").groupBy("code").agg(F.sum("n").alias("n")).toPandas()  # 2**24 rows at most
        rows = rows.sort_values("code")
        spelling = Spelling(rows["code"].to_numpy(), rows["n"].to_numpy(), sweep, spelling)
        if kept:
            kept_spelling.append(spelling)
            all_n, all_rooms = all_n + n_now, all_rooms + rooms
    spelling, n_now, rooms = average(kept_spelling), all_n / times, all_rooms / times
    back = float(np.log10((STRENGTH + word_d * rooms) / (STRENGTH + n_now)))
    states = _map(states.select("part", "n_words", "words", "lengths", "c", "all_rooms", "all_customers", "all_tables"), _LAST,
                  _last_state(spelling, n_now, rooms, word_d, times))
    states = tables.put(states, "last")
    tables.drop("states")
    blocks = blocks.filter("to = -1").select("part", "u1", "w1", "u", "w", "at_u", "at_w", "c")
    seated = blocks.select("part", F.lit(None).cast("binary").alias("all_t")) if seated is None else seated.filter("to = -1").select("part", "all_t")
    return ContextModel(n, states, blocks, seated, numbers, word_parts, spelling, back, pair_d, times)


def _kinds(batches):
    for batch in batches:
        for b in batch.column("customers").to_pylist():
            x = _ints(b)
            yield pa.RecordBatch.from_pydict({"once": [int((x == 1).sum())], "twice": [int((x == 2).sum())]})


def _codes(batches):
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_ints(r["codes"])), pa.array(_reals(r["spelt"]))], ["code", "n"])


# Scores.

_STEP = 8  # steps of counts in an octave


def _frequent(model: ContextModel, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs above the lowest count, in steps of an eighth of an octave, that at most ``most`` pairs reach: codes in
    order, counts and tables. Pairs seen once are not among them."""
    numbers, times = model.numbers, model.times
    step_of = lambda c: np.floor(np.log2(c) * _STEP).astype(np.int64)

    def steps(row):
        for step, n in zip(*np.unique(step_of(_ints(row["c"])), return_counts=True)):
            yield {"n_step": int(step), "n_pairs": int(n)}

    total, least = 0, 10**9
    counted = _map(model.blocks.select("c"), _schema("n_step", "n_pairs"), steps)
    for r in sorted(counted.groupBy("n_step").agg(F.sum("n_pairs").alias("n")).collect(), reverse=True):  # some hundred rows
        total += r["n"]
        if total > most:
            break
        least = r["n_step"]

    def above(rows):
        u, w, c, t = _all_pairs(rows, times)
        at = np.flatnonzero((c > 1) & (step_of(c) >= least))
        yield {"u": _put(u[at] * numbers.n + w[at]), "c": _put(c[at]), "t": _put(t[at])}

    rows = _gather("part", _schema("u", "c", "t"), above, model.blocks, model.seated).collect() if least < 10**9 else []
    codes, c, t = (_joined(_ints(r[k]) for r in rows) for k in "uct")
    order = np.argsort(codes)
    return codes[order], c[order], t[order]


def _found(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which codes there are, and where."""
    if not len(sorted_codes):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return sorted_codes[at] == codes, at


_MET = _schema("pid", "part", "ids", "heavy", "c", "rooms", "p")


def _meet_words(heavy: int, spelling: Spelling, back: float, other: float, open_vocabulary: bool):
    """Number, count, tables and log10 probability of the words asked for; unknown ones have number -1."""
    def run(rows):
        own = next((r for r in rows if r["pid"] is None), None)
        asking = [r for r in rows if r["pid"] is not None]
        if not asking:
            return
        asked = _get_words([r["words"] for r in asking], [r["lengths"] for r in asking])
        known = _get_words([own["words"]], [own["lengths"]]) if own else asked.slice(0, 0)
        ids = pc.fill_null(pc.index_in(asked, value_set=known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(ids < 0)
        take = lambda x: np.concatenate([x, np.zeros(1, x.dtype)])[ids]  # noqa: E731  -1 takes the zero
        c, rooms, p = (take(x) for x in ((_ints(own["c"]), _ints(own["rooms"]), np.log10(_reals(own["p"]))) if own else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)))
        p[new] = other
        if open_vocabulary:
            for at, some in _parts(asked.take(pa.array(new))):
                p[new[at]] = back + spelling.log10(some)
        lo = 0
        for r in asking:
            at = slice(lo, lo := lo + len(_ints(r["lengths"])))
            yield {"pid": r["pid"], "part": r["part"], "ids": _put(ids[at]), "heavy": _put(c[at] > heavy), "c": _put(c[at]), "rooms": _put(rooms[at]), "p": _put(p[at])}

    return run


def _wanted(own, codes: np.ndarray, met, numbers: _Numbers, frequent: np.ndarray):
    """Contexts and words of the distinct pairs of a portion, by the portion's words and by their numbers; which pairs are
    frequent, and where among these; for each part of pairs those to ask for."""
    ids, heavy = numbers.of(met), np.concatenate([np.frombuffer(r["heavy"], bool) for r in met])
    a, b = np.divmod(codes, own["n_kinds"])
    u, w = ids[a], ids[b]
    known = np.flatnonzero((u >= 0) & (w >= 0))
    numbered = u[known] * numbers.n + w[known]
    order = np.argsort(numbered)
    known = known[order]
    hit, at = _found(frequent, numbered[order])
    rest = known[~hit]
    dealt = [(i, rest[some]) for i, some in _dealt(numbers.part_of(u[rest], w[rest], heavy[a[rest]]))]
    return a, b, u, w, known[hit], at[hit], dealt


_ASKED_PAIRS = _schema("part", "pid", "u", "w")


def _ask_pairs(numbers: _Numbers, frequent):
    def run(rows):
        own, met = _split(rows)
        _, _, u, w, _, _, dealt = _wanted(own, _pairs_of(own, return_counts=True)[1], met, numbers, frequent.value[0])
        for i, at in dealt:
            yield {"part": i, "pid": own["pid"], "u": _put(u[at]), "w": _put(w[at])}

    return run


_REPLIES = _schema("pid", "part", "found", "t")


def _look_up(numbers: _Numbers, times: int):
    """Counts and tables of the pairs asked for, zero for those that training never saw."""
    def run(rows):
        asking = [r for r in rows if r["pid"] is not None]
        codes, c, t = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(asking) < len(rows):
            u, w, c, t = _all_pairs([r for r in rows if r["pid"] is None], times)
            codes = u * numbers.n + w
            order = np.argsort(codes)
            codes, c, t = codes[order], c[order], t[order]
        for r in asking:
            hit, at = _found(codes, _ints(r["u"]) * numbers.n + _ints(r["w"]))
            counts = [np.where(hit, x[at], 0) if len(x) else np.zeros(len(hit), np.int64) for x in (c, t)]
            yield {"pid": r["pid"], "part": r["part"], "found": _put(counts[0]), "t": _put(counts[1])}

    return run


_SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _add_up(numbers: _Numbers, frequent, discount: float, times: int, constant: float):
    def run(rows):
        replies = {r["part"]: r for r in rows if r["found"] is not None}
        own, met = _split(rows)
        tokens, codes, which = _pairs_of(own, return_inverse=True)
        a, b, u, _, hit, at, dealt = _wanted(own, codes, met, numbers, frequent.value[0])
        c, t = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        c[hit], t[hit] = frequent.value[1][at], frequent.value[2][at]
        for i, some in dealt:
            c[some], t[some] = _ints(replies[i]["found"]), _ints(replies[i]["t"])
        own_c, rooms = (_joined(_ints(r[k]) for r in met) for k in ("c", "rooms"))
        log_p = _joined((_reals(r["p"]) for r in met), np.float64)
        left = np.where(u >= 0, _left(own_c[a], rooms[a], discount, times), 1.0)
        p = np.log10(left) + log_p[b]
        seen = c > 0
        p[seen] = np.log10((c[seen] - discount * t[seen] / times) / (own_c[a[seen]] + STRENGTH) + left[seen] * 10.0 ** log_p[b[seen]])
        n = _ints(own["sizes"])
        row = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(row, weights=x, minlength=len(n)).tolist() for x in ((own_c > 0)[tokens], (np.log10(own_c + 0.1) - constant)[tokens], p[which])]
        for i, null, size, known, base, score in zip(_ints(own["docs"]).tolist(), np.frombuffer(own["nulls"], bool).tolist(), n.tolist(), *sums):
            yield {"doc_id": None if null else i, "n_tokens": size, "n_known": int(known), "base_score": base, "score": score}

    return run


def score(
    docs: DataFrame, model: ContextModel, text: Column | None = None, doc_id: Column | None = None,
    frequent_pairs: int = FREQUENT_PAIRS, open_vocabulary: bool = False,
) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score, perplexity.

    Tokens are words (runs without blanks, A-Z lower-cased) and one end, so a null or empty text has one token. Scores
    are log10 probabilities; base_score is that of add-0.1 counts. As there, words that training never saw are one
    event, whose probability is all that the model leaves for them; with ``open_vocabulary`` each is spelt out and has
    its own. Null ids and repeated rows are rows like others. No rows give no rows. Other columns are not read.
    """
    tables, numbers = _Tables(docs.sparkSession), model.numbers
    portions = _portioned(docs, text, F.col("doc_id") if doc_id is None else doc_id, tables)
    meet = _meet_words(numbers.heavy, model.spelling, model.back, model.other, open_vocabulary)
    known = model.states.select("part", "words", "lengths", "c", "rooms", "p")
    met = tables.put(_gather("part", _MET, meet, _asked_words(portions, model.word_parts).drop("counts"), known), "met")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(model, frequent_pairs))
    asked = _gather("pid", _ASKED_PAIRS, _ask_pairs(numbers, frequent), _some(portions), met.select("pid", "part", "ids", "heavy"))
    replies = tables.put(_gather("part", _REPLIES, _look_up(numbers, model.times), asked, model.blocks, model.seated), "replies")
    add = _add_up(numbers, frequent, model.discount, model.times, float(np.log10(model.n + 0.1 * (model.v + 1))))
    scores = _stage(_gather("pid", _SCORES, add, _some(portions, "sizes", "nulls", F.col("ids").alias("docs")), met, replies), "scores")
    tables.drop("portions", "met", "replies")
    return scores.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
