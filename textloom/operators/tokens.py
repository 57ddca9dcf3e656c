"""Token ids per text, and batches padded to their own longest row."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import position_in_file
from ..storage import stage
from .split import BUCKET_ROWS, SEED, bucket_digits, bucket_starts, order_key
from .subwords import MAX_VOCABULARY, PIECES, subword_ids, word_ids

# Fixed value: label of a position that the loss leaves out.
IGNORED_LABEL = -100


def byte_tokens(
    texts: DataFrame, seq_len: int | None = None, text: str = "text", keep: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """UTF-8 bytes as token ids (vocabulary 256); ``seq_len`` cuts the rest of each text off, by default nothing.

    With a length only that many bytes are expanded. Latin-1 maps each byte to the
    character of the same number, so the ids are the characters' codes.
    """
    data = F.col(text).cast("binary")
    data = data if seq_len is None else F.substring(data, 1, seq_len)
    ids = F.transform(F.split(F.decode(data, "ISO-8859-1"), ""), F.ascii)
    ids = F.when(F.col(text) != "", ids).otherwise(F.array().cast("array<int>"))
    return _produced(texts.select(*keep, ids.alias("input_ids")), keep)


def token_chunks(
    texts: DataFrame, seq_len: int, text: str = "text", keep: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """Byte tokens in windows of ``seq_len``, numbered by ``chunk``; no token is lost. An empty text has no window.

    Windows are cut from the bytes before they are expanded.
    """
    data = F.col(text).cast("binary")
    last = F.floor((F.octet_length(text) - 1) / seq_len).cast("int")
    places = F.when(F.octet_length(text) > 0, F.sequence(F.lit(0), last))
    parts = texts.select(*keep, data.alias("_data"), F.explode(places).alias("chunk"))
    part = F.decode(F.substring(F.col("_data"), F.col("chunk") * seq_len + 1, F.lit(seq_len)), "ISO-8859-1")
    return _produced(parts.select(*keep, "chunk", F.transform(F.split(part, ""), F.ascii).alias("input_ids")), (*keep, "chunk"))


# A vocabulary up to this size is looked up in an expression.
LITERAL_WORDS = 1000


def word_tokens(
    texts: DataFrame, vocabulary: list[str], seq_len: int | None = None, text: str = "text",
    keep: tuple[str, ...] = ("seq",),
) -> DataFrame:
    """Words between whitespace as token ids: 1, 2, ... in order of ``vocabulary``, 0 for every other word.

    A small vocabulary is a literal, so a text is split and looked up inside the scan. A larger one is joined with the
    distinct words of the texts, whose ids go back to the texts; ``keep`` then has to tell the texts apart.
    """
    found = F.filter(F.split(F.col(text), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    if seq_len is not None:
        found = F.slice(found, 1, seq_len)
    if len(vocabulary) > LITERAL_WORDS:
        first = {word: i + 1 for i, word in reversed(list(enumerate(vocabulary)))}
        table = pa.table({"word": pa.array(first, pa.string()), "id": pa.array(first.values(), pa.int32())})
        return _produced(word_ids(texts, texts.sparkSession.createDataFrame(table), len(first), found, keep=keep), keep)
    words = F.array(*[F.lit(w) for w in vocabulary]) if vocabulary else F.array().cast("array<string>")
    ids = F.transform(found, lambda w: F.array_position(words, w).cast("int"))
    return _produced(texts.select(*keep, ids.alias("input_ids")), keep)


def read_vocabulary(spark: SparkSession, path: str) -> list[str]:
    """The words of a file, one a line, in the order of the lines; blank lines are words that no text holds."""
    rows = stage(spark.read.text(path).select("value", position_in_file().alias("pos")), "vocabulary")
    if rows.count() > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY} words")
    return [r["value"] for r in rows.orderBy("pos").collect()]


def subword_tokens(
    texts: DataFrame, vocabulary: DataFrame, seq_len: int | None = None, text: str = "text",
    keep: tuple[str, ...] = ("seq",), pieces: str = PIECES,
) -> DataFrame:
    """Byte-pair tokens of every text by a vocabulary (``token``, ``id``) of any size; see ``subwords.subword_ids``."""
    return _produced(subword_ids(texts, vocabulary, seq_len, text, keep, pieces), keep)


def _produced(rows: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Only the produced columns go on: ids, mask and labels."""
    ids = F.col("input_ids")
    return rows.select(*keep, ids, F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), ids.alias("labels"))


def byte_lengths(texts: DataFrame, seq_len: int | None = None, text: str = "text", seq: str = "seq") -> DataFrame:
    """Number of byte tokens per row, without making the tokens."""
    n = F.octet_length(text)
    return texts.select(seq, (n if seq_len is None else F.least(n, F.lit(seq_len))).alias("n"))


def padded_batches(
    tokens: DataFrame, batch_size: int, pad_id: int | None = None, seq: str = "seq", seed: int = SEED,
    lengths: DataFrame | None = None, end_id: int = 0, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Shuffled batches of ``batch_size`` rows, each padded to its longest row.

    Rows are ordered by their pseudo-random key; row r belongs to batch
    r // batch_size. Rank and width come from a narrow pass over ``seq`` and the
    length ``n`` of every row: buckets of the key, as deep as the number of rows
    asks for, hold some ``bucket_rows`` rows each. The token rows then move once, by
    ``seq``, and find batch, slot and width there by hash; they are neither sorted
    nor held in a window.

    Without a ``pad_id`` the end token pads. The lengths come
    from ``lengths`` or else from ``tokens``; pass stored tokens or ``lengths``
    where tokenizing twice would cost much. ``seq`` is unique.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    pad_id = end_id if pad_id is None else pad_id
    rows = tokens.select(seq, "input_ids")
    if lengths is None:
        lengths = rows.select(seq, F.size("input_ids").alias("n"))
    lengths = stage(lengths.select(seq, "n", order_key(seq, seed).alias("key")), "lengths")
    digits = bucket_digits(lengths.count(), bucket_rows)
    wide = rows.join(_places(lengths, digits, batch_size, seq).hint("shuffle_hash"), seq)
    missing = F.col("width") - F.size("input_ids")

    def padded(values, fill: int):
        return F.concat(values, F.array_repeat(F.lit(fill), missing))

    ids = F.col("input_ids")
    return wide.select(
        seq, "batch", "slot", "width",
        padded(ids, pad_id).alias("input_ids"),
        padded(F.array_repeat(F.lit(1), F.size(ids)), 0).alias("attention_mask"),
        padded(ids, IGNORED_LABEL).alias("labels"),
    )


def _places(lengths: DataFrame, digits: int, batch_size: int, seq: str) -> DataFrame:
    """Batch, slot and width of every row; no window holds more than a bucket or a batch."""
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("key", seq)) - 1
    ranked = lengths.withColumn("bucket", F.substring("key", 1, digits)).withColumn("inside", inside)
    rank = F.col("start") + F.col("inside")
    return ranked.join(bucket_starts(lengths, digits), "bucket").select(
        seq, F.floor(rank / batch_size).cast("bigint").alias("batch"), (rank % batch_size).cast("int").alias("slot"), "n",
    ).withColumn("width", F.max("n").over(Window.partitionBy("batch"))).drop("n")
