"""The trie of conversation prefixes, from adaptive radix trees over fixed-width big-endian turn ids.

A turn's id is 16 bytes of the SHA-256 of its role and text and 4 bytes with the number of its words, so turns are
equal when their ids are (but for collisions of 128-bit digests). A conversation is the bytes of its turns' ids in a
row. Equal conversations are counted first, with their ids as text for blocks of 4096 consecutive numbers, so a group
of copies costs few rows. The keys are dealt by range, and each task builds the radix tree of its range; only byte
depths that are whole turns give nodes.

A prefix that belongs to several ranges is one of the first or of the last key of its range. Those two chains of
nodes go to the next round with what their task knows of them: members, smallest member, finished children, leaves and
savings below. All other nodes are finished. Rounds go on until the chains fit in one task; each round has a small
fraction of the rows of the one before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stage
from .common import MAX_BROADCAST_ROWS, shuffle_parts
from .radix_tree import RadixTree

TURN_BYTES, COUNT_BYTES = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
# Rows of keys that one task holds as a tree, and rows that are worth a task of their own.
TASK_ROWS, LEAST_ROWS = 50_000, 2_000
BLOCK_BITS = 12
NOBODY = np.iinfo(np.int64).max

CHAIN = (
    "struct<key:binary,n:array<bigint>,first:array<bigint>,kids:array<bigint>,leaves:array<bigint>,saved:array<bigint>,"
    "ends:array<string>>"
)
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    f"saved_tokens bigint, ends_sha256 string, turn string, node binary, parent binary, chain {CHAIN}"
)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """Hexadecimal id of a turn; null role or text counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    words = F.regexp_count(text, F.lit(WORD))
    return F.concat(F.substring(digest, 1, 32), F.lower(F.lpad(F.hex(words.cast("bigint")), 8, "0")))


def turn_ids(turns: DataFrame, conversation="conv_id", order="turn", role="role", text="text", within: Column | None = None) -> DataFrame:
    """conv_id and ids (turn ids in order) of every conversation.

    Turns go by ``order``, null first, ties by id; repeated rows are turns of their own. Rows without a conversation
    belong to none and are left out. Other columns may have any names. With ``within``, a function of the conversation,
    conversations of one value of it are in one partition, and the value is kept as ``within``.
    """
    col = lambda c: turns[f"`{c}`"]
    place = F.struct(col(order).isNotNull().alias("numbered"), col(order).alias("turn"), turn_id(col(role), col(text)).alias("id"))
    rows = turns.filter(col(conversation).isNotNull()).select(
        col(conversation).cast("bigint").alias("conv_id"), place.alias("place"), *([within.alias("within")] if within is not None else []))
    keys = ["conv_id"]
    if within is not None:
        rows, keys = rows.repartition("within"), ["within", "conv_id"]
    return rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("place")), lambda p: p["id"]).alias("ids"))


def _entry(key: bytes, n: int, first: int, ends: str):
    """A key with the same members at every depth, which end at the last."""
    depth = len(key) // TURN_BYTES
    sums = np.zeros((4, depth + 1), np.int64)
    sums[0] = n
    return key, sums, np.full(depth + 1, first, np.int64), {depth: ends}


def _first_entries(batches):
    """Entries of sorted rows (key, block, n, first, ids): the blocks of a key follow one another."""
    key = None
    for batch in batches:
        for k, n, first, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "first", "ids"))):
            if k != key:
                if key is not None:
                    yield _entry(key, total, least, sha.hexdigest())
                key, total, least, sha = k, n, first, hashlib.sha256(ids.encode())
            else:
                total += n
                least = min(least, first)
                sha.update(b"," + ids.encode())
    if key is not None:
        yield _entry(key, total, least, sha.hexdigest())


def _chain_entries(batches):
    for batch in batches:
        for r in batch.to_pylist():
            sums = np.array([r["n"], r["kids"], r["leaves"], r["saved"]], np.int64)
            yield r["key"], sums, np.array(r["first"], np.int64), {d: e for d, e in enumerate(r["ends"]) if e is not None}


def _prefix_id(key: bytes, depth: int) -> bytes:
    return hashlib.sha256(key[:depth * TURN_BYTES]).digest()[:16]


class _Chain:
    """What a task knows of the prefixes of one key."""

    def __init__(self, key: bytes):
        depth = len(key) // TURN_BYTES
        self.key, self.sums, self.first = key, np.zeros((4, depth + 1), np.int64), np.full(depth + 1, NOBODY, np.int64)
        self.ends = [None] * (depth + 1)

    def row(self):
        n, kids, leaves, saved = self.sums.tolist()
        return {"key": self.key, "n": n, "first": self.first.tolist(), "kids": kids, "leaves": leaves, "saved": saved, "ends": self.ends}


def tree_nodes(entries, last: bool, named: bool):
    """Finished nodes and the chains of the first and last key of sorted ``entries``.

    With ``last`` everything is finished and there are no chains; with ``named`` nodes carry the id of their prefix.
    """
    tree, first_key, last_key = RadixTree(), None, None
    for entry in entries:
        tree.insert(entry[0], entry)
        first_key = entry[0] if first_key is None else first_key
        last_key = entry[0]
    if first_key is None:
        return [], []
    chains, open_nodes = [], {}
    if not last:
        for key in sorted({first_key, last_key}):
            chains.append(_Chain(key))
            for node in tree.route(key):
                open_nodes.setdefault(id(node), chains[-1])  # a prefix of both keys goes with the first
    placed = tree.nodes()
    # Of each tree node: its entries' sums by depth, smallest members, ends, one key; finished turn nodes right below.
    held = [None] * len(placed)
    out = []
    for at in range(len(placed) - 1, -1, -1):
        node, above, parent = placed[at]
        if node.entry is not None:
            _join(held, at, *node.entry, 0, 0, 0, [])
        key, sums, least, ends, kids, leaves, saved, orphans = held[at]
        held[at] = None
        chain = open_nodes.get(id(node))
        top = above // TURN_BYTES + 1
        for depth in range((max(above, 0) + len(node.path)) // TURN_BYTES, top - 1, -1):
            n, more_kids, more_leaves, more_saved = sums[:, depth].tolist()
            kids, leaves, saved = kids + more_kids, leaves + more_leaves, saved + more_saved
            conv, end = int(least[depth]), ends.pop(depth, None)
            if chain is not None:
                chain.sums[:, depth], chain.first[depth], chain.ends[depth] = (n, kids, leaves, saved), conv, end
                if orphans:
                    name = _prefix_id(key, depth)
                    for o in orphans:
                        out[o]["parent"] = name
                kids, leaves, saved, orphans = 0, 0, 0, []
                continue
            turn = key[(depth - 1) * TURN_BYTES:depth * TURN_BYTES] if depth else b""
            leaves = leaves if kids else 1
            saved += (n - 1) * int.from_bytes(turn[-COUNT_BYTES:], "big")
            for o in orphans:
                out[o]["parent_conv_id"] = conv
            out.append({
                "conv_id": conv, "depth": depth, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved_tokens": saved,
                "ends_sha256": end or EMPTY_SHA256, "turn": turn.hex(), "node": _prefix_id(key, depth) if named else None})
            kids, orphans = 1, [len(out) - 1]
        if parent >= 0:
            _join(held, parent, key, sums[:, :top], least[:top], ends, kids, leaves, saved, orphans)
    return out, [c.row() for c in chains]


def _join(held, at, key, sums, least, ends, kids, leaves, saved, orphans):
    if held[at] is None:
        held[at] = (key, sums, least, dict(ends), kids, leaves, saved, list(orphans))
        return
    k, s, m, e, a, b, c, o = held[at]
    e.update(ends)
    o.extend(orphans)
    held[at] = (k, s + sums, np.minimum(m, least), e, a + kids, b + leaves, c + saved, o)


def _grown(schema: pa.Schema, chained: bool, last: bool):
    def run(batches):
        nodes, chains = tree_nodes((_chain_entries if chained else _first_entries)(batches), last, chained)
        rows = nodes + [{"chain": c} for c in chains]
        for k in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[k:k + 10_000], schema=schema)

    return run


def _arrow_schema() -> pa.Schema:
    longs = pa.list_(pa.int64())
    chain = pa.struct([("key", pa.binary()), *[(c, longs) for c in ("n", "first", "kids", "leaves", "saved")], ("ends", pa.list_(pa.string()))])
    kind = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    plain = [x.split() for x in NODES.split(", chain ")[0].split(", ")]
    return pa.schema([*[(n, kind[t]) for n, t in plain], ("chain", chain)])


def prefix_trie(conversations: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The nodes of the trie of ``conversations``: conv_id (distinct, not null) and ids (turn ids in order, maybe none).

    A node is a distinct sequence of the first turns of some conversations, its members; one per depth, from the root
    of depth 0. Per node: conv_id, its smallest member; depth; parent_conv_id, its parent's conv_id (null for the
    root); n_convs, its members; n_children; n_leaves, the childless nodes of its subtree, itself included;
    saved_tokens, the words of last turns that all but one member of each node of the subtree need not repeat;
    ends_sha256, of the members that end here, in numeric order and parted by commas; turn, the id of its last turn.

    Null ids count as none. Repeated conversations are members of the same nodes. No conversations give no nodes, not
    even a root. A conversation's key must fit in a row (20 bytes a turn). The digest of a group's members is made by
    one task, which reads the group as a stream of blocks of 4096 numbers.
    """
    if task_rows < 4:
        raise ValueError("a task must hold four rows at least")
    spark = conversations.sparkSession
    keys = conversations.select(
        "conv_id", F.unhex(F.array_join(F.coalesce("ids", F.array().cast("array<string>")), "")).alias("key"))
    counted = keys.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("convs"))
    todo = stage(counted.select(
        "key", "block", F.size("convs").cast("bigint").alias("n"), F.get("convs", F.lit(0)).alias("first"),
        F.array_join(F.col("convs").cast("array<string>"), ",").alias("ids")), "trie-keys")
    order, finished, schema = ["key", "block"], [], _arrow_schema()
    while True:
        rows = todo.count()
        parts = -(-rows // task_rows)
        if not finished:
            parts = max(parts, min(shuffle_parts(spark), -(-rows // min(LEAST_ROWS, task_rows))))
        last = parts <= 1
        dealt = todo.coalesce(1) if last else todo.repartitionByRange(parts, "key")
        grown = stage(dealt.sortWithinPartitions(*order).mapInArrow(_grown(schema, bool(finished), last), NODES), "trie-nodes")
        finished.append(grown.filter("depth is not null"))
        if last:
            break
        todo, order = grown.filter("chain is not null").select("chain.*"), ["key"]
    nodes = finished[0]
    for more in finished[1:]:
        nodes = nodes.union(more)
    if len(finished) > 1:
        # Parents that were finished in a later round than their children.
        known = finished[1]
        for more in finished[2:]:
            known = known.union(more)
        known = known.select(F.col("node").alias("parent"), F.col("conv_id").alias("late"))
        known = F.broadcast(known) if known.count() <= MAX_BROADCAST_ROWS else known
        nodes = nodes.join(known, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "late"))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn")
