r"""Chat formatting with expressions only: collected turns are sorted, merged by role and joined to one string.

A conversation becomes a row of messages. Adjacent turns of one role are one message, whose texts are parted by a mark
of their own, so that the turns can be told apart again:

    <|im_start|>role\ntext<|im_sep|>text<|im_end|>\n

Control strings begin with ``<|``. In a text, ``<`` followed by n backslashes and ``|`` gets one backslash more, so no
text holds a control string and taking one backslash away gives the text back. In a role, ``%``, line feeds and ``<``
become ``%25``, ``%0A`` and ``%3C``.

The loss mask is a run-length code of the formatted string: for each turn the characters (code points) of marks before
its text, those of its text, and whether the text counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secrets import let

# The marks of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"

_HEADER = r"<\|im_start\|>[^\n]*\n"
# What lies between two texts, before the first and behind the last.
_BETWEEN = rf"(?:<\|im_end\|>\n)?{_HEADER}|<\|im_sep\|>|<\|im_end\|>\n\z"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    out = F.replace(role, F.lit("%"), F.lit("%25"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def _unescape_role(role: Column) -> Column:
    out = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(out, F.lit("%25"), F.lit("%"))


def _messages(turns: Column) -> Column:
    """Role and the turns' texts of each message: the turns from one change of role to the next."""
    def cut(t: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(t) - 1)
        starts = F.filter(numbers, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))
        def gather(s: Column) -> Column:
            ends = F.concat(F.slice(s["at"], F.lit(2), F.size(s["at"])), F.array(F.size(s["turns"])))
            bounds = F.arrays_zip(s["at"].alias("first"), ends.alias("end"))
            def one(x: Column) -> Column:
                part = F.slice(s["turns"], x["first"] + 1, x["end"] - x["first"])
                return F.struct(
                    F.get(s["turns"], x["first"])["role"].alias("role"), F.transform(part, lambda v: v["text"]).alias("texts"))
            return let(bounds, lambda b: F.transform(b, one))
        return let(F.struct(starts.alias("at"), t.alias("turns")), gather)
    return let(turns, cut)


def _formatted(messages: Column, loss_role: str) -> Column:
    """The string of the messages and its loss mask."""
    def one(m: Column, i: Column) -> Column:
        head = F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"))
        def lay(x: Column) -> Column:
            before = F.length(x["head"]) + F.when(i > 0, len(END)).otherwise(0)
            mask = F.transform(x["texts"], lambda t, k: F.struct(
                F.when(k == 0, before).otherwise(len(SEPARATOR)).alias("marks"), F.length(t).alias("chars"),
                (m["role"] == loss_role).alias("loss")))
            return F.struct(F.concat(x["head"], F.array_join(x["texts"], SEPARATOR), F.lit(END)).alias("s"), mask.alias("mask"))
        return let(F.struct(head.alias("head"), F.transform(m["texts"], escape).alias("texts")), lay)

    def join(parts: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("formatted"),
            F.flatten(F.transform(parts, lambda p: p["mask"])).alias("loss_mask"))

    return let(F.transform(messages, one), join)


def format_chats(
    turns: DataFrame, conversation="conv_id", order="turn", role="role", text="text", loss_role: str = LOSS_ROLE,
) -> DataFrame:
    """One row per conversation: conv_id, formatted and loss_mask.

    Turns go by ``order``, null first, ties by role and text; repeated rows stay repeated. A null role or text counts
    as empty; a null conversation is one conversation. Other columns may have any names; no rows give no rows. The
    strings of one conversation are collected, as they make up its result row: it must stay below Spark's 2 GB.
    """
    col = lambda c: turns[f"`{c}`"]
    place = col(order)
    turn = F.struct(
        place.isNotNull().alias("numbered"), place.alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"))
    rows = turns.select(col(conversation).alias("conv_id"), turn.alias("turn"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return rows.select("conv_id", let(_messages(F.col("turns")), lambda m: _formatted(m, loss_role)).alias("f")).select("conv_id", "f.*")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    def block(b: Column) -> Column:
        line = F.instr(b, "\n")
        body = F.substring(b, line + 1, F.length(b) - line - len(END))
        named = F.struct(_unescape_role(F.substring(b, F.lit(1), line - 1)).alias("role"), F.split(body, r"<\|im_sep\|>", -1).alias("texts"))
        return let(named, lambda x: F.transform(x["texts"], lambda t: F.struct(x["role"].alias("role"), unescape(t).alias("text"))))

    blocks = F.split(formatted, r"<\|im_start\|>", -1)
    return F.flatten(F.transform(let(blocks, lambda x: F.slice(x, F.lit(2), F.size(x))), block))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order.

    The string is cut at its marks and the pieces are chosen by the mask; a mask that does not cover the string piece
    by piece, to its last character, is an error.
    """
    def choose(x: Column) -> Column:
        def fit(p: Column, m: Column) -> Column:
            fits = p.isNotNull() & m.isNotNull() & (F.length(p) == m["chars"])
            return F.when(fits, F.when(m["loss"], unescape(p))).otherwise(F.raise_error("the loss mask does not fit"))
        covered = F.aggregate(x["mask"], F.lit(len(END)), lambda n, m: n + m["marks"] + m["chars"])
        texts = F.filter(F.zip_with(x["texts"], x["mask"], fit), lambda t: t.isNotNull())
        return F.when(covered == F.length(x["f"]), texts).otherwise(F.raise_error("the loss mask does not fit"))

    texts = let(F.split(formatted, _BETWEEN, -1), lambda p: F.slice(p, F.lit(2), F.size(p) - 2))
    return let(F.struct(texts.alias("texts"), mask.alias("mask"), formatted.alias("f")), choose)
