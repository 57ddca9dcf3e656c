"""WARC archives: one gzip member per record, written and read by Spark's own text files.

Archives are written through Spark's text writer, so any store that Spark writes to will do: a task cuts the bytes of
its archive at zero bytes and the writer puts them back as line ends. Archives end in a zero byte, since the last
record is short and a gzip member ends with its length. Part files hold the archives' bytes and nothing else.

They are read as lines that end where the three bytes of a gzip member's head stand, so large archives are split over
tasks and a line is a record. The reader goes through a task's lines in order: it inflates each member step by step,
frames the block by Content-Length and verifies its digests. The three bytes may also turn up inside a member; then the
member is not complete at the end of its line and goes on in the next one. Where such a member runs over the end of a
split, its pieces are put together in a second pass over these pieces alone.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered

MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 16
LEVEL = 4
SALTS = 64


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def gzip_member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, block: bytes, headers: dict[str, str], level: int = LEVEL) -> bytes:
    head = {
        "WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Block-Digest": "sha1:" + b32(hashlib.sha1(block).digest()), **headers, "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip_member(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", level)


def _urn(page, rf, ri) -> str:
    return f"<urn:page:{'' if page is None else page}:{rf}:{ri}>"


def _page_of(urn: str | None):
    part = (urn or "").split(":")
    return int(part[2]) if len(part) > 2 and part[2] else None


def _archive(level: int):
    def pages(batches):
        for batch in batches:
            for r in batch.to_pylist():
                payload = r["payload"]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                url = (r["url"] or "").encode("ascii", "replace").decode().replace("\r", "%0D").replace("\n", "%0A")
                head = {
                    "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response",
                    "WARC-Payload-Digest": "sha1:" + b32(hashlib.sha1(payload).digest()),
                }
                urn = _urn(r["page_id"], r["rf"], r["ri"])
                if r["w_rf"] is None:
                    yield record("response", urn, http + payload, head, level)
                else:
                    head["WARC-Refers-To"] = _urn(r["w_id"], r["w_rf"], r["w_ri"])
                    head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                    yield record("revisit", urn, http, head, level)

    def run(batches):
        rest, rows, size = b"", [], 0
        empty = True
        for member in pages(batches):
            empty = False
            *whole, rest = (rest + member).split(b"\0")
            rows += whole
            size += len(member)
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                rows, size = [], 0
        if not empty:
            *whole, rest = (rest + record("metadata", "<urn:end>", b"", {}, level)).split(b"\0")
            assert not rest
            yield pa.RecordBatch.from_arrays([pa.array(rows + whole, pa.binary())], ["value"])

    return run


def write_archives(
    pages: DataFrame, path: str, payload: Column | None = None, min_revisit_bytes: int = 0, level: int = LEVEL,
    from_files: bool = False,
) -> None:
    """Write the rows of ``pages`` (page_id, url, html) as WARC records below ``path``; no rows write empty files.

    A null payload is empty. Of records with equal payloads (SHA-1 and length) of at least ``min_revisit_bytes``, the
    one with the largest page_id is the response and others revisit it; null ids are the smallest and equal ids are
    told apart by their place. Blanks and non-ASCII in addresses are kept as far as a header line allows. Other
    columns are not read.
    """
    body = F.coalesce((F.col("html") if payload is None else payload).cast("binary"), F.lit(b""))
    rows = numbered(pages, {"page_id": F.col("page_id").cast("bigint"), "url": F.col("url").cast("string"), "payload": body}, from_files, "warc-pages")
    rows = rows.select(
        "*", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").cast("bigint").alias("n"),
        F.pmod(F.xxhash64("rf", "ri"), F.lit(SALTS)).cast("int").alias("salt"))
    # A payload meets itself once for each salt, however many pages share it.
    key = F.struct("page_id", "rf", "ri")
    first = rows.filter(F.col("n") >= min_revisit_bytes).groupBy("sha", "n", "salt").agg(F.max(key).alias("best"), F.count("*").alias("c"))
    top = first.groupBy("sha", "n").agg(F.max("best").alias("w"), F.sum("c").alias("c")).filter("c > 1")
    winners = first.select("sha", "n", "salt").join(top, ["sha", "n"]).select(
        "sha", "n", "salt", F.col("w.page_id").alias("w_id"), F.col("w.rf").alias("w_rf"), F.col("w.ri").alias("w_ri"))
    own = (F.col("rf") == F.col("w_rf")) & (F.col("ri") == F.col("w_ri"))
    decided = rows.join(winners, ["sha", "n", "salt"], "left").select(
        "page_id", "rf", "ri", "url", "payload",
        *[F.when(~own, F.col(c)).alias(c) for c in ("w_id", "w_rf", "w_ri")])
    decided.mapInArrow(_archive(level), "value binary").select(_as_text("value")).write.option("lineSep", "\0").text(path)


def _as_text(name: str) -> Column:
    """The same bytes as a string; nothing is decoded."""
    return F.col(name).cast("string").alias(name)


class Reader:
    """Reads members from lines that lack their first three bytes."""

    def __init__(self):
        self.parts: list[bytes] = []  # of the member that is not complete

    def inflate(self):
        """(record or None if incomplete, error)."""
        z = zlib.decompressobj(31)
        frame = Frame()
        try:
            for i, part in enumerate(self.parts):
                for piece in (MAGIC, part):
                    for at in range(0, len(piece), STEP):
                        if z.eof:
                            return None, "bytes after the end of a member"
                        frame.feed(z.decompress(piece[at:at + STEP]))
            if not z.eof:
                return None, None
            if z.unused_data:
                return None, "bytes after the end of a member"
        except zlib.error as e:
            return None, f"not a member: {e}"
        return frame.end(), None


class Frame:
    """A record from its inflated bytes: head, a block of Content-Length bytes, two line ends."""

    def __init__(self):
        self.buffer, self.head, self.want = bytearray(), None, 0
        self.block = bytearray()
        self.error = None

    def feed(self, data: bytes):
        self.buffer += data
        if self.head is None:
            at = self.buffer.find(b"\r\n\r\n")
            if at < 0:
                return
            version, *lines = bytes(self.buffer[:at]).decode("utf-8", "replace").split("\r\n")
            self.head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            del self.buffer[:at + 4]
            length = self.head.get("content-length", "")
            if not version.startswith("WARC/") or not length.isdigit():
                self.error = "no WARC head"
            self.want = int(length) if length.isdigit() else 0
        if self.want:
            taken = self.buffer[:self.want]
            self.block += taken
            del self.buffer[:len(taken)]
            self.want -= len(taken)

    def end(self) -> dict:
        head = self.head or {}
        error = self.error or ("no WARC head" if self.head is None else None)
        if not error and (self.want or bytes(self.buffer) != b"\r\n\r\n"):
            error = "block and Content-Length differ"
        block, payload = bytes(self.block), bytes(self.block)
        http = head.get("content-type", "").startswith("application/http")
        length = len(payload)
        if http:
            top, _, payload = block.partition(b"\r\n\r\n")
            length = len(payload)
            for line in top.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                if name.strip().lower() == b"content-length" and value.strip().isdigit():
                    length = int(value)
        check = [("warc-block-digest", block)]
        if head.get("warc-type") == "response":
            check.append(("warc-payload-digest", payload))
            if not error and http and length != len(payload):
                error = "payload and its length differ"
        for name, data in check:
            stated = head.get(name, "").rpartition(":")[2]
            if not error and stated and stated != b32(hashlib.sha1(data).digest()):
                error = f"{name} differs"
        return {
            "record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "url": head.get("warc-target-uri"),
            "payload_bytes": length, "payload_digest": head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            "refers_to_id": head.get("warc-refers-to"), "payload": payload, "error": error,
        }


_FIELDS = {
    "record_type": pa.string(), "record_id": pa.string(), "url": pa.string(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "refers_to_id": pa.string(), "payload": pa.binary(), "error": pa.string(),
}
_PLACE = {"file": pa.string(), "block": pa.int64(), "nth": pa.int64(), "line": pa.binary()}
_SCHEMA = (
    "record_type string, record_id string, url string, payload_bytes bigint, payload_digest string, refers_to_id string, "
    "payload binary, error string, file string, block bigint, nth bigint, line binary"
)


def _batch(rows: list[dict]):
    kinds = _FIELDS | _PLACE
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], list(kinds))


def _read(last_pass: bool, with_payload: bool):
    """Records of lines in the order of files and blocks; pieces at a block's ends are given back unless it is the last pass."""

    def run(batches):
        reader, place, nth, started = Reader(), None, 0, False
        out, size = [], 0

        def close():
            """What is open when a block ends."""
            for i, part in enumerate(reader.parts):
                if last_pass:
                    out.append({"error": "not a complete member", "file": place[0], "block": place[1]}) if i == 0 else None
                else:
                    out.append({"file": place[0], "block": place[1], "nth": nth - len(reader.parts) + i, "line": part})
            reader.parts = []

        for batch in batches:
            for file, block, line in zip(batch.column("file"), batch.column("block"), batch.column("value")):
                here = (file.as_py(), None if last_pass else block.as_py())
                if here != place:
                    close()
                    place, nth, started = here, 0, False
                line = line.as_py()
                nth += 1
                if not line and not reader.parts and (nth == 1 or last_pass):
                    continue  # before the first member
                reader.parts.append(line)
                found, error = reader.inflate()
                if found:
                    reader.parts, started = [], True
                    if not with_payload:
                        found["payload"] = None
                    out.append(found | {"file": place[0], "block": place[1]})
                    size += found["payload_bytes"] or 0
                elif error:
                    if started or last_pass or (block.as_py() == 0):
                        out.append({"error": error, "file": place[0], "block": place[1]})
                    else:
                        out.append({"file": place[0], "block": place[1], "nth": nth, "line": line})
                    reader.parts = []
                if len(out) >= 1000 or size > 1 << 23:
                    yield _batch(out)
                    out, size = [], 0
        close()
        if out:
            yield _batch(out)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records below ``path``: record_type, record_id, url, payload_bytes, payload_digest, refers_to_id, payload, error.

    Files must not be named .gz, or Spark would inflate them itself. payload_bytes of a revisit is that of the payload
    it stands for. A damaged record or digest gives a row with ``error`` set; nothing else is dropped.
    """
    raw = spark.read.option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    meta = raw.metadataColumn("_metadata")
    lines = raw.select(raw["value"].cast("binary").alias("value"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"))
    found = lines.mapInArrow(_read(False, with_payload), _SCHEMA)
    # Members that run over the end of a split are rare: three given bytes inside one, and that at the split's end.
    pieces = found.filter("line is not null").select(F.col("line").alias("value"), "file", "block", "nth")
    mended = (
        pieces.repartition("file").sortWithinPartitions("file", "block", "nth").select("value", "file", "block")
        .mapInArrow(_read(True, with_payload), _SCHEMA)
    )
    return found.filter("line is null").union(mended).drop("file", "block", "nth", "line")


def page_of(column: str) -> Column:
    """The page id in a record id of write_archives; null if it had none."""
    return F.element_at(F.split(column, ":"), 3).try_cast("bigint")
