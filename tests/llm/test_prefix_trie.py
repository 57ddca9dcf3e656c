import hashlib
import random
import re
import zlib

import pytest

from textloom.llm import prefix_trie as pt
from textloom.llm.queries import QUERIES
from textloom.llm.radix_tree import RadixTree

SCHEMA = "conv_id bigint, turn int, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """Nodes of {conv_id: [(role, text), ...]} by looking at every prefix."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, out = {}, []
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = {}, {}
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(m) - 1) * words
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(conversations[c]) == len(p))))
        out.append((
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
            hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select(COLUMNS).collect()), key=repr)


def some(rnd, n, kinds):
    """Conversations that share prefixes, some of them copies, some without turns."""
    out, made = {}, []
    for _ in range(n):
        old = rnd.choice(made) if made and rnd.random() < 0.8 else []
        turns = old[:rnd.randint(0, len(old))] + [
            (rnd.choice(["user", "assistant", ""]), f"t{rnd.randrange(kinds)} x y"[:rnd.randint(0, 8)]) for _ in range(rnd.randint(0, 4))]
        made.append(turns)
        out[rnd.randrange(-5000, 10**9) if rnd.random() < 0.5 else len(made)] = turns
    return out


def frame(spark, conversations):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(conversations.items()), "conv_id bigint, turns array<struct<r:string,t:string>>")
    return df.select("conv_id", F.transform("turns", lambda t: pt.turn_id(t["r"], t["t"])).alias("ids"))


@pytest.mark.parametrize("task_rows", [4, 9, 1000])
def test_nodes_equal_brute_force(spark, task_rows):
    rnd = random.Random(task_rows)
    conversations = some(rnd, 90, 5)
    assert rows_of(pt.prefix_trie(frame(spark, conversations), task_rows)) == brute(conversations)


def test_rounds_give_the_same_nodes_without_spark():
    """Many small ranges, many rounds, keys of very different length."""
    for seed in range(60):
        rnd = random.Random(seed)
        conversations = some(rnd, rnd.choice([1, 2, 30, 200]), rnd.choice([1, 2, 300]))
        if rnd.random() < 0.3:
            conversations[77] = [("user", "again and again")] * 300
        ids, groups = {}, {}
        for c, turns in conversations.items():
            key = b""
            for t in turns:
                words = len(re.findall(r"[^\x20\x09-\x0D]+", t[1]))
                key += ids.setdefault(t, hashlib.sha256(repr(t).encode()).digest()[:16] + words.to_bytes(4, "big"))
            groups.setdefault(key, []).append(c)
        sha = lambda m: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()
        entries = [pt._entry(k, len(m), min(m), sha(m)) for k, m in sorted(groups.items())]
        nodes, named = [], False
        while True:
            size = rnd.choice([1, 4, 7])
            parts = [entries[i:i + size] for i in range(0, len(entries), size)] if len(entries) > 4 else [entries]
            chains = []
            for p in parts:
                done, left = pt.tree_nodes(p, len(parts) == 1, named)
                nodes += done
                chains += left
            if len(parts) == 1:
                break
            if size == 1:  # a chain for each key: no fewer rows than before
                chains = pt.tree_nodes(pt._chain_entries([_Rows(chains)]), False, True)
                nodes, chains = nodes + chains[0], chains[1]
            entries, named = list(pt._chain_entries([_Rows(chains)])), True
        late = {n["node"]: n["conv_id"] for n in nodes if n["node"]}
        got = []
        for n in nodes:
            up = n.get("parent_conv_id", late.get(n.get("parent")))
            got.append((n["conv_id"], n["depth"], up, *(n[c] for c in COLUMNS[3:])))
        assert sorted(got, key=repr) == brute(conversations)


class _Rows:
    def __init__(self, rows):
        self.rows = rows

    def to_pylist(self):
        return self.rows


def test_radix_tree_layouts():
    rnd = random.Random(1)
    for spread in (3, 10, 40, 200, 256):
        keys = {bytes(rnd.randrange(spread) for _ in range(rnd.randint(0, 5))) for _ in range(3000)}
        tree = RadixTree()
        for k in rnd.sample(sorted(keys), len(keys)):
            tree.insert(k, k)
        assert {n.entry for n, _, _ in tree.nodes() if n.entry is not None} == keys
        assert all(tree.route(k)[-1].entry == k for k in keys)
        layouts = {type(n.layout).__name__ + str(getattr(n.layout, "room", "")) for n, _, _ in tree.nodes()}
        assert {3: "Few4", 10: "Few16", 40: "Indexed", 200: "Full", 256: "Full"}[spread] in layouts
        assert all(n.layout is not None or n.entry is not None for n, above, _ in tree.nodes() if above >= 0)


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    ids = lambda p: hashlib.sha256(f"{len(p[2])}:{p[2]}{p[3]}".encode()).hexdigest()[:32]
    own = {c: [p[2:] for p in sorted(v, key=lambda p: (p[0], p[1], ids(p)))] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for c in [*range(100), 1000, 1001, 1007, 2003, *range(2020, 2100)]:
        for t in range(rnd.randint(1, 7)):
            t = None if rnd.random() < 0.05 else t if rnd.random() < 0.9 else 0
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice([None, "", "a b", "hi", "one\ttwo three", "é\x0bü"])))
    rows += [(None, 0, "user", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    conversations = rebuilt(rows)
    assert any(not t for t in conversations.values())  # turnless ones
    assert rows_of(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == brute(conversations)


def test_copies_over_many_blocks(spark):
    conversations = {c: [("user", "same words")] for c in range(-9000, 9000, 2)}
    assert rows_of(pt.prefix_trie(frame(spark, conversations))) == brute(conversations)


def test_empty_table_nulls_and_clashing_names(spark):
    none = spark.createDataFrame([], "conv_id bigint, ids array<string>")
    assert pt.prefix_trie(none).collect() == []
    assert [tuple(r)[:4] for r in pt.prefix_trie(spark.createDataFrame([(5, None)], none.schema)).collect()] == [(5, 0, None, 1)]
    odd = spark.createDataFrame([(1, 0, "user", "a", 9, 9)], "`c.x` bigint, n int, r string, t string, ids int, place int")
    ids = pt.turn_ids(odd, "c.x", "n", "r", "t").first()
    assert ids["conv_id"] == 1 and len(ids["ids"]) == 1 and ids["ids"][0].endswith("00000001")
    with pytest.raises(ValueError):
        pt.prefix_trie(none, task_rows=3)
