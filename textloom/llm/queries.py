"""The dealt operators as queries over the supplied tables, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stage, work_path
from . import chat_format, langid, periodic_runs, prefix_trie, quality, secrets, warc, word_contexts
from .exact_dedup import exact_dedup
from .mixing import mix
from .packing import pack
from .secrets import let
from .simhash import simhash_components
from .suffix_dedup import remove_repeats

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


@query(f"""
with t as (select doc_id, translate(coalesce(text, ''), {_AZ}) as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(norm) as text_sha256
from t window w as (partition by norm)""")
def op1_exact_dedup(spark, sf_dir):
    rows = exact_dedup(_table(spark, sf_dir, "documents"), keep="largest", from_files=True)
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op10_quality_rules(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    rows = quality.line_quality(docs.select("doc_id", "text"), quality.fit(docs, _table(spark, sf_dir, "labels")))
    return rows.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "content_share")


SHINGLE, MAX_BITS = 3, 3


@query()
def op9_simhash_dedup(spark, sf_dir):
    rows = simhash_components(_table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS, from_files=True)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op6_packing(spark, sf_dir):
    return pack(_table(spark, sf_dir, "documents"), from_files=True)


@query(r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as words, row_number() over (order by source nulls last) - 1 as nth from d group by source),
w as (select *, [3, 1, 2][nth % 3 + 1] as weight, (select sum(words) from s)::bigint as everything from s),
l as (select *, coalesce(sum(2 * words) over before, 0)::bigint as used, (sum(weight) over () - coalesce(sum(weight) over before, 0))::bigint as rest
      from w window before as (order by words / weight, nth rows between unbounded preceding and 1 preceding)),
full_ as (select *, (3 * everything - 2 * used) * weight > 4 * words * rest as capped from l),
r as (select coalesce(sum(2 * words) filter (where capped), 0) as used, sum(weight) filter (where not capped) as rest from full_),
t as (select source, words, case when capped then (2 * words)::double
      else (1.5::double * everything - r.used) * weight / r.rest end as target from full_, r),
o as (select d.*, t.words, t.target, floor(t.target)::bigint as flow, coalesce(sum(size) over (partition by d.source
      order by md5(concat('mix:', doc_id)) rows between unbounded preceding and 1 preceding), 0)::bigint as place
      from d join t on d.source is not distinct from t.source)
select doc_id, size, words as source_size, target, size * ((size > 0 and 2 * place + size <= 2 * flow)::bigint
       + (size > 0 and 2 * (words + place) + size <= 2 * flow)::bigint) as taken from o""")
def op8_mixing(spark, sf_dir):
    rows = mix(_table(spark, sf_dir, "documents"), from_files=True)
    return rows.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


MIN_REVISIT_BYTES = 0


@query()
def op2_warc(spark, sf_dir):
    path = work_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, min_revisit_bytes=MIN_REVISIT_BYTES, from_files=True)
    rows = warc.read_archives(spark, path, with_payload=False).filter("record_type in ('response', 'revisit') or error is not null")
    return rows.select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of("refers_to_id").alias("refers_to"), "error")


def _remainder(divisor: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % divisor, F.lit(-1))


@query()
def op3_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(_remainder(4) != 2))
    rows = langid.identify(docs, model).withColumnRenamed("id", "doc_id")
    return rows.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op4_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


REPEAT_BYTES = 400


@query()
def op5_suffix_dedup(spark, sf_dir):
    rows = remove_repeats(_table(spark, sf_dir, "documents"), REPEAT_BYTES, from_files=True)
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query()
def op7_lm_score(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    model = word_contexts.fit(docs.filter(_remainder(10) != 0))
    return word_contexts.score(docs, model).select(
        "doc_id", (_remainder(10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"),
        "base_score", "score")


_WORD = r"[^\x20\x09-\x0D]+"


def _repeated_tail(text, code):
    """The words of a text, those from the one numbered a on repeating with period p; ``code`` chooses a and p."""
    def choose(x):
        a = x["g"] % F.size(x["w"])
        return let(F.struct(x["w"].alias("w"), x["g"].alias("g"), a.alias("a")), lay)
    def lay(x):
        rest = F.size(x["w"]) - x["a"]
        p = F.lit(1) + F.floor(rest / (3 + x["g"] % 8))
        return let(F.struct(x["w"].alias("w"), x["a"].alias("a"), p.alias("p")), words)
    def words(x):
        place = lambda i: F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"])
        numbers = F.sequence(F.lit(0).cast("bigint"), F.size(x["w"]).cast("bigint") - 1)
        return F.array_join(F.transform(numbers, lambda i: F.get(x["w"], place(i).cast("int"))), " ")
    found = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    some = lambda w: F.when(F.size(w) > 0, let(F.struct(w.alias("w"), code.alias("g")), choose)).otherwise("")
    return let(found, some)


@query()
def op13_periodic_runs(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.when(h % 10 == 0, _repeated_tail(F.coalesce("text", F.lit("")), F.floor(h / 10))).otherwise(F.col("text"))
    rows = periodic_runs.find_runs(docs, text, keep=["doc_id"])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    rows = rows.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return rows.select(
        "doc.doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# Length of a formatted conversation: texts with a backslash for each broken control string, roles with three
# characters for each of three, 13 for the head and 11 for the end of a message, 10 between turns of one message.
@query(r"""
with a as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o as (select *, row_number() over w as nth, lag(role) over w as before from a
      window w as (partition by conv_id order by turn nulls first, role, text)),
t as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by nth) as turns,
        coalesce(string_agg(text, '' order by nth) filter (where role = 'assistant'), '') as loss,
        sum(length(text) + len(regexp_extract_all(text, '<\\*\|')) + case when role is distinct from before
          then 24 + length(role) + 2 * (length(role) - length(translate(role, '%<' || chr(10), ''))) else 10 end)::bigint as formatted_chars
      from o group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from t""")
def op12_chat_format(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("bigint"), F.col("id").cast(rows.schema["turn"].dataType),
        F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    chats = chat_format.format_chats(rows.union(more))
    chats = chats.select(
        "conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
        chat_format.read_turns(F.col("formatted")).alias("turns"),
        F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


# Checksum of the decimal conv_id bit by bit, as the engine has no such function.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(
  range(1, length(conv_id::varchar) + 1), lambda i: [ord(substr(conv_id::varchar, i, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, s: case when s >= 0 then xor(c, s) else xor(c >> 1, 3988292384 * (c & 1)) end))"""


@query(rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
i as (select conv_id, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words,
        substr(sha256(length(role) || ':' || role || text), 1, 32) || format('{{:08x}}', words) as id from t),
c as (select conv_id, list({{'id': id, 'words': words}} order by turn nulls first, id) as own, {_CRC} % 4 as h from i group by conv_id),
r as (select c.conv_id, list_concat(coalesce(b.own, [])[1:c.h], c.own[c.h + 1:]) as seq
      from c left join c b on b.conv_id = c.conv_id - c.conv_id % 20),
p as (select conv_id, seq, unnest(range(0, len(seq) + 1)) as depth from r),
n as (select list_transform(seq[1:depth], lambda x: x.id) as key, depth, min(conv_id) as conv_id, count(*) as n_convs,
        any_value(case when depth > 0 then seq[depth].words else 0 end) as words,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(seq) = depth), '')) as ends_sha256
      from p group by key, depth),
k as (select key[1:depth - 1] as key, count(*) as n_children from n where depth > 0 group by 1),
m as (select n.*, coalesce(k.n_children, 0) as n_children from n left join k on n.key = k.key),
u as (select key[1:up] as key, sum((n_children = 0)::bigint) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
      from (select *, unnest(range(0, depth + 1)) as up from m) group by 1)
select m.conv_id, m.depth, q.conv_id as parent_conv_id, m.n_convs, m.n_children, u.n_leaves::bigint as n_leaves,
       u.saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join u on m.key = u.key left join m q on m.depth > 0 and q.key = m.key[1:m.depth - 1]""")
def op11_prefix_trie(spark, sf_dir):
    """Conversations are rebuilt first: their first h turns become those of the first conversation of their twenty."""
    base = F.col("conv_id") - F.col("conv_id") % 20
    own = prefix_trie.turn_ids(_table(spark, sf_dir, "conversations"), within=base)
    head = F.max(F.when(F.col("conv_id") == F.col("within"), F.slice("ids", 1, 3))).over(Window.partitionBy("within"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    rows = own.withColumn("head", F.coalesce(head, F.array().cast("array<string>"))).withColumn("h", h)
    rows = rows.select("conv_id", F.concat(F.slice("head", F.lit(1), F.col("h")), F.slice("ids", F.col("h") + 1, F.size("ids"))).alias("ids"))
    return prefix_trie.prefix_trie(rows).drop("turn")
