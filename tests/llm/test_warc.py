import base64
import gzip
import hashlib
import os
import zlib

from textloom.llm import warc
from textloom.llm.queries import QUERIES


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows, least=0):
    """rows: (page_id, payload)."""
    best = {}
    for p, data in rows:
        best[data] = max(best.get(data, -1), -1 if p is None else p)
    out = []
    for p, data in rows:
        same = [q for q, d in rows if d == data]
        response = len(data) < least or len(same) == 1 or p == best[data]
        out.append((p, len(data), b32(data), "response" if response else "revisit", None if response else best[data]))
    return sorted(out, key=str)


def files(path):
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-"))


def test_round_trip_of_odd_pages(spark, tmp_path):
    payloads = [None, "", "a", "<p>\0zero\0</p>", "é" * 1000, "x" * 20_000_000, "same", "same", "same", "\r\n\r\n", None]
    rows = [(i * 3, f"http://x/{i}\n\r ü", p, "n", "v") for i, p in enumerate(payloads)] + [(None, None, "no id", "n", "v")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n string, value string")
    path = str(tmp_path / "a")
    warc.write_archives(pages, path)
    got = warc.read_archives(spark, path).filter("record_type <> 'metadata' or error is not null")
    assert got.filter("error is not null").count() == 0
    table = got.select(warc.page_of("record_id").alias("p"), "payload_bytes", "payload_digest", "record_type", warc.page_of("refers_to_id").alias("r"))
    assert sorted((tuple(r) for r in table.collect()), key=str) == brute([(p, (h or "").encode()) for p, _, h, *_ in rows])
    whole = {r.p: bytes(r.payload) for r in got.filter("record_type = 'response'").select(warc.page_of("record_id").alias("p"), "payload").collect()}
    assert all(whole[p] == (h or "").encode() for p, _, h, *_ in rows if p in whole)
    # The files are plain gzip, one member a record.
    records = 0
    for f in files(path):
        with gzip.open(f) as g:
            records += g.read().count(b"WARC/1.1\r\n")
    assert records == len(rows) + sum(os.path.getsize(f) > 0 for f in files(path))


def test_small_payloads_and_ties(spark, tmp_path):
    rows = [(5, "u", "ab"), (5, "u", "abcd"), (5, "u", "abcd"), (9, "u", "ab"), (None, "u", "abcd")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "a"), min_revisit_bytes=3)
    got = warc.read_archives(spark, str(tmp_path / "a")).filter("record_type <> 'metadata'")
    kinds = sorted((r.payload_bytes, r.record_type) for r in got.collect())
    assert kinds == [(2, "response"), (2, "response"), (4, "response"), (4, "revisit"), (4, "revisit")]
    warc.write_archives(pages.limit(0), str(tmp_path / "b"))
    assert warc.read_archives(spark, str(tmp_path / "b")).count() == 0


def test_damage_is_told_and_heads_inside_members_are_read(spark, tmp_path):
    inner = b"before" + warc.MAGIC + b"middle" * 3000 + warc.MAGIC + b"after"
    good = [warc.record("resource", f"<urn:page:{i}:0:0>", inner + b"%d" % i, {}, level=0) for i in range(40)]
    bad = bytearray(warc.record("resource", "<urn:page:77:0:0>", b"y" * 100, {}, level=0))
    bad[bad.find(b"yyy")] = 120
    lying = warc.gzip_member(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabcdef\r\n\r\n")
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "x.warc").write_bytes(b"".join(good) + bytes(bad) + lying + good[0])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1g", "20000", "7000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1000")
        rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
        fine = [r for r in rows if r.error is None]
        assert sorted(bytes(r.payload) for r in fine) == sorted([inner + b"%d" % i for i in range(40)] + [inner + b"0"]), size
        assert len(rows) - len(fine) == 2, [r.error for r in rows if r.error]
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    rows = QUERIES["op2_warc"](spark, sf).collect()
    assert all(r.error is None for r in rows)
    assert sorted((tuple(r)[:5] for r in rows), key=str) == brute(pages)
