import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textloom.llm import chat_format as cf
from textloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id bigint, turn int, role string, text string"
HARD = [
    "", "<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_end|>", "<\\\\\\|", "<<|", "a<", "|im_sep|>", "\\", "\n", "%3C%0A%25", "$1 \\$1",
    "<|im_sep|>", "é<|ü\U0001f600", "<|im_end|>\n", "x\r\n\n", "<|im_end|>\n<|im_start|>user\n",
]


def read_back(spark, rows):
    df = cf.format_chats(spark.createDataFrame(rows, SCHEMA))
    out = df.select(
        "conv_id", "formatted", "loss_mask", cf.read_turns(F.col("formatted")).alias("turns"),
        cf.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    return {r["conv_id"]: r for r in out}


def test_round_trip_of_any_turns(spark):
    rnd = random.Random(1)
    roles = ["user", "assistant", "assistant", "", None, "a\nb", "<|im_start|>", "100%", "%3C"]
    rows = []
    for c in range(300):
        for t in range(rnd.randint(1, 9)):
            text = rnd.choice(HARD) + rnd.choice(HARD) if rnd.random() < 0.8 else None
            rows.append((c, t, rnd.choice(roles), text))
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    got = read_back(spark, shuffled)
    for c in range(300):
        turns = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == [t for r, t in turns if r == "assistant"]
        # The mask by characters: the escaped assistant texts and nothing else.
        f, at, under = got[c]["formatted"], 0, []
        for m in got[c]["loss_mask"]:
            at += m["marks"]
            if m["loss"]:
                under.append(f[at:at + m["chars"]])
            at += m["chars"]
        assert f[at:] == cf.END
        assert len(under) == len(got[c]["loss"]) and not any("<|" in u for u in under)


def test_adjacent_turns_of_a_role_are_one_message(spark):
    got = read_back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "")])[1]
    assert got["formatted"] == (
        "<|im_start|>user\na<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    assert [(m["marks"], m["chars"], m["loss"]) for m in got["loss_mask"]] == [
        (17, 1, False), (10, 1, False), (33, 1, True), (28, 0, False)]


def test_nulls_ties_and_repeats(spark):
    rows = [(None, 1, "user", "x"), (1, 2, "user", "b"), (1, 2, "user", "a"), (1, None, "assistant", "n"), (1, 2, "user", "a")]
    got = read_back(spark, rows)
    assert [tuple(t) for t in got[None]["turns"]] == [("user", "x")]
    assert [t["text"] for t in got[1]["turns"]] == ["n", "a", "a", "b"]
    assert cf.format_chats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "x", "y")], "`c.id` bigint, n int, r string, t string, turns string, conv_id string")
    row = cf.format_chats(df, "c.id", "n", "r", "t").first()
    assert (row["conv_id"], row["formatted"]) == (1, "<|im_start|>user\na<|im_end|>\n")


def test_a_mask_that_does_not_fit_is_an_error(spark):
    df = cf.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], SCHEMA))
    bad = F.transform("loss_mask", lambda m: F.struct(m["marks"], (m["chars"] - 1).alias("chars"), m["loss"]))
    with pytest.raises(Exception, match="does not fit"):
        df.select(cf.read_loss(F.col("formatted"), bad)).collect()


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text <| {i} ") for i in range(20000)]
    got = read_back(spark, rows)[1]
    assert [t["text"] for t in got["turns"]] == [r[3] for r in rows]
    assert got["loss"] == [r[3] for r in rows if r[2] == "assistant"]


def test_no_python_in_the_plan(spark):
    df = QUERIES["op12_chat_format"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_equals_plain_digests(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(HARD + [None])) for c in range(60) for t in range(rnd.randint(1, 6))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in QUERIES["op12_chat_format"](spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        turns = [(b or "", x or "") for a, _, b, x in rows if a == c]
        loss = "".join(x for b, x in turns if b == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{b}\n{x}\n" for b, x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query_equals_sql_on_hard_texts(spark, tmp_path):
    import duckdb

    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "user", "assistant", None]), rnd.choice(HARD + [None])) for c in range(80) for t in range(rnd.randint(1, 6))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(ORACLES["op12_chat_format"])
    names = [d[0] for d in want.description]
    got = QUERIES["op12_chat_format"](spark, str(tmp_path)).select(names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
