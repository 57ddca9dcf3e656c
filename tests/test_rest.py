import json

import pytest
from pyspark.sql import functions as F

from textloom.functions.sizing import config_code, range_violations, tokens_per_step, training_steps, vram_mb
from textloom.operators import catalog, tokens
from textloom.plans.run_plan import run_plan
from textloom.sinks.files import csv_to_parquet
from textloom.sources import csv, datasets, samples
from textloom.streaming import build as streams


# ── CSV ──

def test_csv_types_and_null_words(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "i,f,b,d,t,s,z,m\n"
        "1,1.5,true,2024-01-02,2024-01-02 03:04:05,x,,2024-01-02\n"
        "NaN,NULL,NA,n/a,#N/A,null,nan,2024-01-02T01:00\n"
        '-7,2,FALSE,2024-02-29,2024-01-02T03:04,"q ""x"", y",NA,2024-01-03 00:00:00.25\n'
        ',inf,"",,,"",,\n')
    rows = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in rows.dtypes] == [
        "bigint", "double", "boolean", "date", "timestamp_ntz", "string", "string", "timestamp_ntz"]
    got = rows.select("i", "f", "b", F.col("d").cast("string"), F.col("t").cast("string"), "s", "z").collect()
    assert [tuple(r) for r in got] == [
        (1, 1.5, True, "2024-01-02", "2024-01-02 03:04:05", "x", None), (None,) * 7,
        (-7, 2.0, False, "2024-02-29", "2024-01-02 03:04:00", 'q "x", y', None),
        (None, float("inf"), None, None, None, None, None)]


def test_csv_widths(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n9223372036854775807,99999999999999999999,2024-13-01\n1,2,2024-01-01\n")
    assert [t for _, t in csv.read_csv(spark, str(tmp_path / "a.csv")).dtypes] == ["bigint", "double", "string"]


@pytest.mark.parametrize("cells, kind, values", [
    (["+5"], "double", [5.0]), ([" 5", "\t6 "], "bigint", [5, 6]), (["0x1F", "7"], "bigint", [31, 7]),
    (["007", "-0"], "bigint", [7, 0]), ([".5", "5.", "1e5"], "double", [0.5, 5.0, 1e5]), (["Infinity", "-inf"], "double", [float("inf"), -float("inf")]),
    (["0", "true", "FALSE"], "boolean", [False, True, False]), (["tRuE"], "string", ["tRuE"]), ([" true"], "string", [" true"]),
    (["1d"], "string", ["1d"]), (["1_000"], "string", ["1_000"]), (["2024-1-2"], "string", ["2024-1-2"]), (["1e400"], "double", [float("inf")]),
    (["2024-01-02 03:04", "2024-01-02 03:04Z"], "string", None), (["2024-01-02 03:04Z", "2024-01-02T03:04:05+01:00"], "timestamp", None),
    (["true", "0.5"], "string", None), (["12:30"], "string", None), (["2024-01-02 03:04:05.123456789"], "timestamp_ntz", None),
])
def test_csv_inference(spark, tmp_path, cells, kind, values):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f"{c},x\n" for c in cells))
    rows = csv.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.dtypes[0][1] == kind
    assert values is None or [r.a for r in rows.collect()] == values


def test_csv_short_row_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match="MALFORMED"):
        csv.read_csv(spark, str(tmp_path / "a.csv")).collect()


def test_csv_cells_over_line_ends(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert csv.has_quoted_newlines(spark, path)
    assert [tuple(r) for r in csv.read_csv(spark, path).collect()] == [(1, "x\ny"), (2, "z")]
    (tmp_path / "b.csv").write_text('a,b\n1,"x ""q"""\n')
    assert not csv.has_quoted_newlines(spark, str(tmp_path / "b.csv"))


def test_csv_value_that_does_not_fit_the_given_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\ny,z\n")
    with pytest.raises(Exception, match="column a"):
        csv.read_csv(spark, str(tmp_path / "a.csv"), "a bigint, b string").collect()


@pytest.mark.parametrize("codec", ["zstd", "snappy", "gzip", "none"])
def test_csv_to_parquet(spark, tmp_path, codec):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,NA\n")
    result = csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"), codec)
    assert (result["rows"], result["batches"], result["compression"]) == (2, 1, codec)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == [(1, "x"), (2, None)]


def test_csv_to_parquet_errors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    for kwargs in ({}, {"schema": "a bigint, b string"}, {"compression": "lz9"}, {"compression": "brotli"}):
        with pytest.raises(ValueError):
            csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "o"), **kwargs)


# ── catalogue ──

def entries(spark):
    tags = [f"t{i}" for i in range(10)] + ["language:en", "task_categories:qa"]
    rows = [("o/d", None, 10, 1, tags, "Some Words", [("train/a",), ("test/b",), ("README",)]),
            ("solo", None, 5, None, None, None, [("README",)]),
            ("x/y", "someone", 10, 7, ["fr"], "d" * 300, None)]
    return spark.createDataFrame(
        rows, "id string, author string, downloads bigint, likes bigint, tags array<string>, description string, "
        "siblings array<struct<rfilename:string>>")


def test_search(spark):
    rows = catalog.search_catalog(entries(spark)).collect()
    assert [(r.id, r.author, r.likes, len(r.tags)) for r in rows] == [("o/d", "o", 1, 8), ("x/y", "someone", 7, 1), ("solo", "", 0, 0)]
    assert rows[2].description == "" and rows[2].url.endswith("/solo")

    def ids(**args):
        return [r.id for r in catalog.search_catalog(entries(spark), **args).collect()]

    assert ids(query="some w") == ["o/d"] and ids(query="SOLO") == ["solo"]
    assert ids(language="en", task="qa") == ["o/d"] and ids(language="fr") == ["x/y"] and ids(author="o") == ["o/d"]
    assert ids(sort="downloads", direction=1) == ["solo", "o/d", "x/y"] and ids(limit=1) == ["o/d"]
    for args in ({"sort": "name"}, {"direction": 0}):
        with pytest.raises(ValueError):
            ids(**args)
    many = spark.range(300).selectExpr("concat('a/', id) id", "cast(null as string) author", "id downloads", "id likes",
                                       "array('x') tags", "'' description")
    assert catalog.search_catalog(many, limit=500).count() == 300
    assert catalog.search_catalog(many, limit=500, max_results=100).count() == 100
    for limit in (None, 10**9):
        assert [r.downloads for r in catalog.search_catalog(many, limit=limit).collect()] == list(range(299, -1, -1))
    bare = catalog.search_catalog(many.select("id"), query="a/7", sort="trending").collect()
    assert [(r.author, r.downloads, r.tags) for r in bare[:1]] == [("a", 0, [])] and len(bare) == 11
    assert catalog.dataset_details(many.select("id")).first().siblings_count == 0
    assert catalog.list_splits(many.select("id").limit(1)).first().splits == ["train"]


def test_detail_splits_and_summary(spark):
    detail = catalog.dataset_detail(entries(spark), "o/d").first()
    assert (detail.author, detail.siblings_count, len(detail.tags)) == ("", 3, 12)
    assert catalog.dataset_detail(entries(spark), "x/y").first().siblings_count == 0
    assert {r.id: r.splits for r in catalog.list_splits(entries(spark)).collect()} == {
        "o/d": ["test", "train"], "solo": ["train"], "x/y": ["train"]}
    flat = entries(spark).select("id", F.explode("siblings.rfilename").alias("rfilename"))
    assert sorted(map(tuple, catalog.list_splits_of_files(flat).collect())) == [
        ("o/d", "test"), ("o/d", "train"), ("solo", "train")]
    lines = {r.id: r.summary for r in catalog.summaries(catalog.search_catalog(
        entries(spark).withColumn("downloads", F.lit(1234567)))).collect()}
    assert lines["o/d"] == "o/d\n  ↓ 1,234,567  ❤ 1  Tags: t0, t1, t2, t3, t4\n  Some Words"
    assert lines["x/y"].endswith("Tags: fr\n  " + "d" * 120 + "…")
    assert "Tags: —" in lines["solo"]
    short = catalog.compact_results(catalog.search_catalog(entries(spark))).collect()
    assert [(len(r.tags), len(r.description)) for r in short] == [(5, 10), (1, 200), (0, 0)]


# ── sizing ──

def configs(spark, *rows):
    names = "seq_len hidden_size layers batch_size grad_accum vocab_size".split()
    return spark.createDataFrame(list(rows), ", ".join(f"{n} bigint" for n in names))


def test_config_codes(spark):
    good = (1024, 768, 12, 2, 8, 32000)
    cases = [good, (1024, 768, 12, 0, 8, 32000), (1000, 768, 12, 2, 8, 32000), (1024, 770, 12, 2, 8, 32000),
             (1024, 768, 12, 2, 0, 32000), (1024, 768, 12, 2, 8, 255), (1000, 770, 0, 2, 0, 0)]
    assert [r[0] for r in configs(spark, *cases).select(config_code()).collect()] == [0, 1, 2, 3, 4, 5, 1]
    bad = configs(spark, good, (64, 8, 1, 2000, 5000, 1)).select(range_violations(["seq_len", "batch_size", "grad_accum", "layers"]))
    assert [r[0] for r in bad.collect()] == [[], ["seq_len", "batch_size", "grad_accum"]]


def test_sizing_values(spark):
    big = 4294967295
    rows = configs(spark, (1024, 768, 12, 2, 8, 32000), (big, 8, 1, big, big, 256), (1024, 768, 12, 2, 0, 1))
    assert [int(r[0]) for r in rows.select(tokens_per_step()).collect()] == [16384, 18446744073709551615, 0]
    steps = configs(spark, (1024, 768, 12, 2, 8, 1), (1024, 768, 12, 0, 8, 1)).select(
        *[training_steps(F.lit(n), epochs=F.lit(e)) for n, e in ((1000, 1), (1000, 3), (0, 1), (2**63 - 1, 2**40))])
    assert [[int(v) for v in r] for r in steps.collect()] == [[63, 189, 0, 2**64 - 1], [0, 0, 0, 0]]
    memory = configs(spark, (2048, 4096, 32, 1, 8, 1), (2048, 0, 32, 1, 8, 1)).select(
        vram_mb(F.lit(False)), vram_mb(F.lit(True)))
    assert [[int(v) for v in r] for r in memory.collect()] == [[111616, 25600], [0, 0]]


def test_run_plan(spark, samples):
    rows = samples([(1, "a" * 100, "x"), (2, "é" * 100, "x"), (3, "b", "y")])
    plan = run_plan(rows, [{"seq_len": 128, "batch_size": 2, "grad_accum": 1, "epochs": 2}, {"seq_len": 100}], by="source")
    got = {(r.source, r.config_id): r for r in plan.collect()}
    first = got["x", 0]
    assert (first.rows, first.corpus_tokens, first.used_tokens, int(first.steps)) == (2, 300, 228, 2)
    assert got["x", 1].used_tokens == 200 and got["x", 1].code == 2 and got["x", 1].out_of_range == ["seq_len"]
    assert run_plan(rows, [{}]).first().rows == 3
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text


# ── tokens ──

def test_byte_tokens(spark, samples):
    got = tokens.byte_tokens(samples([(1, "aé", "s"), (2, "\x00😀b", "s"), (3, "", "s")]), 4).orderBy("seq").collect()
    assert [list(r.input_ids) for r in got] == [[97, 195, 169], [0, 240, 159, 152], []]
    assert [list(r.labels) for r in got] == [list(r.input_ids) for r in got]
    assert [list(r.attention_mask) for r in got] == [[1] * 3, [1] * 4, []]
    assert tokens.byte_tokens(samples([(1, "a", "s")]), 4, keep=()).columns == ["input_ids", "attention_mask", "labels"]


def test_full_and_chunked_tokens(spark, samples):
    rows = samples([(1, "aé" * 5, "s"), (2, "", "s"), (3, "abcd", "s")])
    full = {r.seq: list(r.input_ids) for r in tokens.byte_tokens(rows).collect()}
    assert full == {1: list(("aé" * 5).encode()), 2: [], 3: list(b"abcd")}
    joined = {}
    for r in tokens.token_chunks(rows, 4).orderBy("seq", "chunk").collect():
        assert len(r.input_ids) <= 4 and r.chunk == len(joined.get(r.seq, [])) // 4
        joined.setdefault(r.seq, []).extend(r.input_ids)
    assert joined == {k: v for k, v in full.items() if v}


def test_word_tokens(spark, samples):
    rows = samples([(1, "a b c a", "s"), (2, "", "s"), (3, " b\u2003a\n", "s")])
    got = tokens.word_tokens(rows, ["a", "b"]).orderBy("seq").collect()
    assert [list(r.input_ids) for r in got] == [[1, 2, 0, 1], [], [2, 1]]
    assert list(tokens.word_tokens(rows, ["a", "b"], 3).orderBy("seq").first().labels) == [1, 2, 0]


@pytest.mark.parametrize("n, batch", [(3, 2), (1, 4), (200, 7), (200, 1000)])
def test_padded_batches(spark, n, batch):
    import hashlib

    rows = spark.createDataFrame([(i, [1] * (i * 37 % 11)) for i in range(n)], "seq bigint, input_ids array<int>")
    order = sorted(range(n), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
    widths = [max(i * 37 % 11 for i in order[b:b + batch]) for b in range(0, n, batch)]
    got = {r.seq: r for r in tokens.padded_batches(rows, batch, pad_id=9).collect()}
    assert len(got) == n
    for rank, i in enumerate(order):
        r, real, width = got[i], i * 37 % 11, widths[rank // batch]
        assert (r.batch, r.slot, r.width) == (rank // batch, rank % batch, width)
        assert list(r.input_ids) == [1] * real + [9] * (width - real)
        assert list(r.attention_mask) == [1] * real + [0] * (width - real)
        assert list(r.labels) == [1] * real + [-100] * (width - real)
    with pytest.raises(ValueError):
        tokens.padded_batches(rows, 0)


@pytest.mark.parametrize("bucket_rows", [1, 5, 1000])
def test_padded_batches_of_any_bucket_depth(spark, bucket_rows):
    import hashlib

    rows = spark.range(90).select(F.col("id").alias("seq"), F.array_repeat(F.lit(1), (F.col("id") % 7).cast("int")).alias("input_ids"))
    df = tokens.padded_batches(rows, 4, pad_id=9, bucket_rows=bucket_rows)
    got = {r.seq: (r.batch, r.slot, r.width, len(r.labels)) for r in df.collect()}
    order_ = sorted(range(90), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
    for k, i in enumerate(order_):
        width = max(j % 7 for j in order_[k // 4 * 4:k // 4 * 4 + 4])
        assert got[i] == (k // 4, k % 4, width, width)


def test_token_rows_move_once_and_are_not_sorted(spark, plan_nodes):
    rows = spark.range(50).select(F.col("id").alias("seq"), F.array(F.lit(1), F.col("id").cast("int")).alias("input_ids"))
    wide = [name for name, columns in plan_nodes(tokens.padded_batches(rows, 4)) if "input_ids" in columns]
    assert [n for n in wide if n.startswith("Exchange")] == ["Exchange"]
    assert not [n for n in wide if n.startswith(("Sort", "Window"))]



# ── streams ──

def test_stream_equals_batch_over_micro_batches(spark, tmp_path):
    for i in range(3):
        part = [{"seq": j, "text": f" text {j % 40:02d} " + "x" * (j % 40), "source": "s"} for j in range(i * 30, i * 30 + 30)]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, part)))
    schema = "seq bigint, text string, source string"
    arriving = datasets.stream_dataset(spark, str(tmp_path / "in"), "json", schema, maxFilesPerTrigger=1)
    rows = samples.from_table(arriving, source=F.col("source"))
    query = streams.stream_build(rows, str(tmp_path / "out"), str(tmp_path / "cp"), min_chars=10, max_chars=40)
    query.awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == streams.ROCKSDB
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    out = spark.read.parquet(str(tmp_path / "out"))
    batch = {f"text {j:02d} " + "x" * j for j in range(40)}
    batch = {t.strip() for t in batch if 10 <= len(t.strip()) <= 40}
    assert sorted(r.text for r in out.collect()) == sorted(batch)
    again = streams.split_by_hash(out.drop("split"))
    assert {tuple(r) for r in out.select("text", "split").collect()} == {tuple(r) for r in again.select("text", "split").collect()}


def test_stream_split_shares(spark):
    rows = streams.split_by_hash(spark.range(20_000).selectExpr("cast(id as string) text"), (0.5, 0.3, 0.2))
    share = {r.split: r["count"] / 20_000 for r in rows.groupBy("split").count().collect()}
    assert all(abs(share[k] - v) < 0.02 for k, v in (("train", 0.5), ("validation", 0.3), ("test", 0.2)))


def test_watermark_dedupe(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(
        {"text": t, "ts": f"2024-01-01T00:00:0{i}"}) for i, t in enumerate(["a", "b", "a"])))
    rows = datasets.stream_dataset(spark, str(tmp_path / "in"), "json", "text string, ts timestamp")
    out = streams.clean_stream(rows, event_time="ts", delay="1 minute")
    streams.start(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stream_csv(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("a,b\n1,x\n2,NA\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    streams.stream_csv_to_parquet(*args, schema="a bigint, b string").awaitTermination()
    (tmp_path / "in" / "b.csv").write_text("a,b\n3,y\n")
    streams.stream_csv_to_parquet(*args, schema="a bigint, b string").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, "x"), (2, None), (3, "y")]
    (tmp_path / "in" / "c.csv").write_text("a,b\nno,y\n")
    with pytest.raises(Exception):
        streams.stream_csv_to_parquet(*args, schema="a bigint, b string").awaitTermination()


def test_stream_tokens(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab\n\ncd e\n")
    rows = datasets.stream_dataset(spark, str(tmp_path / "in"), "text", None).withColumnRenamed("value", "text")
    streams.start(streams.stream_tokens(rows, 3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(list(r.input_ids) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [[97, 98], [99, 100, 32]]
    with pytest.raises(ValueError):
        datasets.stream_dataset(spark, "x", "orc", "a int")


def test_one_entry_loads_from_any_provider(spark, tmp_path):
    source = datasets.StoredDataset
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "b.jsonl").write_text('{"t": "x", "n": 1}\n{"t": "y", "n": 2}\n')
    (tmp_path / "f" / "c.csv").write_text("t,n\nno,3\n")
    spark.createDataFrame([("p", "train"), ("q", "test")], "t string, split string").write.partitionBy("split").parquet(str(tmp_path / "s"))
    load = lambda p, path, **o: [r.text for r in datasets.load_any(spark, source(p, str(tmp_path / path), "test", "t"), **o).collect()]
    assert load("local", "f/c.csv") == ["no"] and sorted(load("folder", "f")) == ["x", "y"] and load("splits", "s") == ["q"]
    assert load("folder", "f", max_samples=1) == ["x"]
    for k, (p, path) in enumerate((("folder", "f"), ("splits", "s"), ("local", "f/c.csv"))):
        rows = datasets.load_any(spark, source(p, str(tmp_path / path), "test", "t"), streaming=True, checkpoint=str(tmp_path / f"cp{k}"))
        assert rows.isStreaming and "text" in rows.columns
    with pytest.raises(ValueError):
        load("web", "f")
    with pytest.raises(ValueError, match="no column"):
        datasets.load_any(spark, source("folder", str(tmp_path / "f")))
    with pytest.raises(ValueError, match="checkpoint"):
        load("folder", "f", streaming=True)


def test_batches_of_a_conversion(spark, tmp_path):
    from textloom.sinks import files as sinks

    (tmp_path / "x.csv").write_text("a\n" + "\n".join(map(str, range(95))) + "\n")
    done = sinks.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"), batch_size=10)
    assert (done["rows"], done["batches"]) == (95, 10)
    assert sinks.csv_to_parquet(spark, str(tmp_path / "x.csv"), str(tmp_path / "out"))["batches"] == 1


def test_pages_that_fail_are_counted_by_the_build(spark, tmp_path):
    from textloom.plans import build as bld

    text = "<p>a text of more than forty characters, number {}</p>"
    table = spark.createDataFrame(
        [(1, "http://a", text.format(1)), (2, "http://b", "<![foo[" + text.format(2)), (3, "http://c", text.format(3))],
        "page_id bigint, url string, html string")
    result = bld.build_from_pages("pages", table, str(tmp_path / "out"))
    assert (result.samples, result.failed_pages) == (2, 1)
