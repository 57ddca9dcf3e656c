import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import clean
from textloom.sinks import files as sinks
from textloom.sources import datasets, files, samples


def found(df):
    return [r.text for r in df.orderBy("seq").collect()]


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_text_files_in_list_order(spark, tmp_path):
    para = "y" * 3000
    b = write(tmp_path / "b é+%41.TXT", " one\r\ntwo \n")
    a = write(tmp_path / "a.md", f"{para}\r\n\r\n \n\n{para}")
    bad = write(tmp_path / "c.markdown", b"ok\xff\xfe!")
    other = write(tmp_path / "d.rst", "no")
    blank = write(tmp_path / "e.txt", " \n ")
    rows = files.read_files(spark, [b, str(tmp_path / "missing.txt"), a, bad, other, blank], split="train")
    assert found(rows) == ["one\ntwo", para, para, "ok!"]
    first = rows.orderBy("seq").first()
    assert (first.source, first.split) == (b, "train")


def test_large_text_files_are_split_over_tasks(spark, tmp_path, monkeypatch):
    """The same samples as from whole files, for every kind of blank line and broken byte."""
    import random

    rng = random.Random(5)
    bits = [b"word ", "é😀".encode(), b"\n", b"\n\n", b"\r\n\r\n", b"\n\r\n", b"\r\n\n", b"\n\xff\n", b"\n \n", b"\xc3", b"\r\r"]
    names = [write(tmp_path / f"{i}.txt", b"x" * 6000 + b"".join(rng.choices(bits, k=4000))) for i in range(3)]
    names.insert(1, write(tmp_path / "small.txt", "one\n\ntwo"))
    plain = [b"word ", "é😀".encode(), b"\n", b"\n\n", b"\n\n\n", b" \n", b"a" * 300]
    names += [write(tmp_path / f"plain{i}.txt", b"".join(rng.choices(plain, k=2000))) for i in range(4)]
    names += [
        write(tmp_path / "blank.md", b"\n" * 6000 + b"one\n\ntwo" + b" " * 200),
        write(tmp_path / "gap.md", b"one" + b"\n" * 7000 + b"two"),
        write(tmp_path / "mark.md", b"\xef\xbb\xbf" + b"z" * 6000 + b"\n\nend\n"),
        write(tmp_path / "mark2.md", b"\xef\xbb\xbf\n\n" + b"z " * 6000 + b"\nend"),
        write(tmp_path / "marked.md", b"\xef\xbb\xbfone\n\ntwo" + b" " * 6000),
        write(tmp_path / "line.md", b"q" * 20_000),
    ]
    whole = [tuple(r) for r in files.read_files(spark, names).orderBy("seq").select("text", "source").collect()]
    monkeypatch.setattr(files, "LARGE_FILE_BYTES", 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_files(spark, names)
        assert [tuple(r) for r in rows.orderBy("seq").select("text", "source").collect()] == whole
        assert "ArrowPython" not in rows._jdf.queryExecution().toString()
        assert rows.select("seq").distinct().count() == len(whole) > 1000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = []
    for name in names:
        text = open(name, encoding="utf-8", errors="ignore").read().strip()
        want += [p.strip() for p in text.split("\n\n") if p.strip()] if len(text) > 5000 else [text]
    assert [t for t, _ in whole] == want


def test_size_filter_prunes_the_file_list(spark, tmp_path):
    for i in range(4):
        write(tmp_path / f"{i}.txt", "x" * 10 ** (i + 1))
    scan = spark.read.text(str(tmp_path), wholetext=True).filter("_metadata.file_size > 500")
    assert scan.rdd.getNumPartitions() >= 1 and scan.count() == 2
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "file_size" in plan


def test_no_files(spark, tmp_path):
    rows = files.read_files(spark, [str(tmp_path / "none.txt")])
    assert rows.count() == 0 and rows.columns == ["text", "source", "split", "seq"]


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text":"ok"}\n\nnot json\n"bare"\n{"other":1}\n{"text":"r"}\n')
    assert found(files.read_files(spark, [path])) == ["ok", "bare", "r"]


@pytest.mark.parametrize("line, want", [
    ('{"text":"a"}, junk', None),
    ('{"text":"a"} {"text":"b"}', None),
    ('{"text":"a"}] , [', None),
    ('{"text":"a"},"#textloom-end#"],[', None),
    ('{"text":"say #textloom-end#"}', "say #textloom-end#"),
    ('{"text":"a","text":"b"}', "b"),
    ('{"text":"a","n":NaN}', "a"),
    ('{"text":"\\ud83d\\ude00"}', "😀"),
    ('{"text":"\\ud83d"}', None),
    ('{"text":" \\u0041\\n"}', "A"),
    ('{"text":7}', None),
    ('{"text":null}', None),
    ('{"text":["a"]}', None),
    ('7', "7"), ('1e5', "100000.0"), ('1.0', "1.0"), ('null', "None"), ('true', "True"), ('[1, "a"]', "[1, 'a']"),
    ("\u00a0\"x\"\u00a0", "x"),
    ('{"a":{"text":"in"},"text":"out"}', "out"),
    ('{"text":"a",}', None),
    ("{'text':'a'}", None),
])
def test_json_lines_equal_python(spark, tmp_path, line, want):
    path = write(tmp_path / "a.jsonl", line + "\n")
    assert found(files.read_files(spark, [path])) == ([] if want is None else [want])


def test_bad_record_rules(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"text":"ok"}\n{"text":5}\n{"text":"r"}\n')
    other = write(tmp_path / "b.jsonl", b'{"text":"x"}\n{"text":"\xff"}\n')
    doc = write(tmp_path / "c.json", '[{"text":"d"},{"text":null},"e"]')
    assert found(files.read_files(spark, [path, other, doc])) == ["ok", "r", "x", "d", "e"]
    assert found(files.read_files(spark, [path, other, doc], on_bad="stop_file")) == ["ok", "d"]
    with pytest.raises(ValueError):
        files.read_files(spark, [path], on_bad="?")


def test_json_documents(spark, tmp_path):
    a = write(tmp_path / "a.json", '[{"text":"a"},"bare",5,null,true]')
    b = write(tmp_path / "b.JSON", '{"text": " one "}')
    c = write(tmp_path / "c.json", '{"other": 1}')
    d = write(tmp_path / "d.json", '[{"text":"x"}] junk')
    e = write(tmp_path / "e.json", "7")
    assert found(files.read_files(spark, [b, a, c, d, e])) == ["one", "a", "bare", "5", "None", "True"]


def test_other_text_column(spark, tmp_path):
    for name in ("body", "the text", "it's"):
        path = write(tmp_path / "a.jsonl", json.dumps({name: "v", "text": "no"}) + "\n")
        assert found(files.read_files(spark, [path], text_column=name)) == ["v"]


def test_large_jsonl_keeps_order_over_blocks(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", "".join(json.dumps({"text": f"line {i}"}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        rows = files.read_files(spark, [path])
        assert rows.rdd.getNumPartitions() > 3
        assert found(rows) == [f"line {i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_mixed_folder(spark, tmp_path):
    write(tmp_path / "x" / "b[1] {c}.txt", "two")
    write(tmp_path / "x" / "a.jsonl", '{"text":"one"}')
    write(tmp_path / "x" / "sub" / "c.json", '["three"]')
    last = write(tmp_path / "0.txt", "four")
    assert found(files.read_files(spark, [str(tmp_path / "x"), last])) == ["one", "two", "three", "four"]


@pytest.mark.parametrize("fmt", ["jsonl", "json", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(f"é \u2028 {i}", None if i % 2 else "s") for i in range(50)], "text string, source string")
    out = sinks.write_samples(rows.repartition(3), str(tmp_path / "v1.5"), fmt)
    assert out == str(tmp_path / f"v1.{fmt}")
    back = datasets.load_dataset(spark, out).select("text", "source")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)


def test_json_parts_are_arrays(spark, tmp_path):
    sinks.write_json_arrays(spark.range(1000).repartition(3), str(tmp_path / "a"))
    parts = list((tmp_path / "a").glob("part-*"))
    assert len(parts) == 3 and sum(len(json.loads(p.read_text())) for p in parts) == 1000
    sinks.write_json_arrays(spark.range(0, 3, 1, 1).filter("id * 2 > 50"), str(tmp_path / "b"))
    assert [json.loads(p.read_text()) for p in (tmp_path / "b").glob("part-*")] == [[]]


def test_output_paths():
    assert sinks.output_path("/a/v1.5", "jsonl") == "/a/v1.jsonl"
    assert sinks.output_path("s3a://b/c.d/name", "parquet") == "s3a://b/c.d/name.parquet"
    assert sinks.output_path("name.json", "json") == "name.json"
    assert sinks.metadata_path("/a/x.jsonl") == "/a/x.meta.json"
    with pytest.raises(ValueError):
        sinks.output_path("a", "xml")


def test_split_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a", ""), ("b", "test"), ("c", None)], "text string, split string")
    root = sinks.write_splits(rows, str(tmp_path / "d"))
    assert sorted(r.text for r in datasets.load_split(spark, root).collect()) == ["a", "c"]
    assert [r.text for r in datasets.load_split(spark, root, "test").collect()] == ["b"]
    plan = datasets.load_split(spark, root, "test")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_load_folder(spark, tmp_path):
    write(tmp_path / "b" / "x.csv", "text\nno\n")
    write(tmp_path / "a" / "z.JSON", '[{"text":"one"},\n{"text":"two"}]')
    write(tmp_path / "a" / "y.txt", "no")
    assert sorted(r.text for r in datasets.load_folder(spark, str(tmp_path)).collect()) == ["one", "two"]
    with pytest.raises(FileNotFoundError):
        datasets.load_folder(spark, write(tmp_path / "c" / "x.txt", "no").rsplit("/", 1)[0])


def test_max_samples_over_files(spark, tmp_path):
    for i in range(7):
        write(tmp_path / "d.jsonl" / f"{i}.jsonl", "".join(json.dumps({"n": i * 10 + j}) + "\n" for j in range(10)))
    for n in (3, 10, 25, 69, 500):
        rows = datasets.load_dataset(spark, str(tmp_path / "d.jsonl"), n)
        assert sorted(r.n for r in rows.collect()) == list(range(min(n, 70)))
        assert rows.columns == ["n"]
    assert datasets.load_dataset(spark, str(tmp_path / "d.jsonl")).count() == 70


def test_max_samples_of_split(spark, tmp_path):
    spark.range(100).selectExpr("id", "if(id % 2 = 0, 'train', 'test') split").coalesce(1).write.partitionBy(
        "split").parquet(str(tmp_path / "p"))
    got = datasets.load_split(spark, str(tmp_path / "p"), "test", 3)
    assert sorted(r.id for r in got.collect()) == [1, 3, 5]


def test_ingest_order_and_lines(spark):
    a = samples.from_texts(spark, ["x", " ", "y"])
    talk = spark.createDataFrame([(5, "l1\n\n l2 ")], "seq bigint, text string")
    rows = samples.ingest([("texts", a), ("lines", samples.from_lines(talk))])
    assert [(r.text, r.source, r.input_kind) for r in rows.orderBy("seq").collect()] == [
        ("x", "manual", "texts"), ("y", "manual", "texts"), ("l1", "text-input", "lines"), ("l2", "text-input", "lines")]
    assert {r.input_kind: r.accepted for r in samples.ingest_counts(rows).collect()} == {"texts": 2, "lines": 2}


def test_missing_text_column_gives_nothing(spark):
    assert samples.from_table(spark.range(3).withColumnRenamed("id", "seq"), "nope").count() == 0


def test_ingest_keeps_numbers_apart(spark):
    one = spark.createDataFrame([(-5, "a"), (10**17, "b")], "seq bigint, text string")
    one = samples.from_table(one)
    inner = samples.ingest([("x", one), ("y", one), ("none", one.limit(0))])
    outer = samples.ingest([("i", inner), ("j", inner.drop("input_kind")), ("k", one)])
    got = outer.orderBy("seq").collect()
    assert [r.text for r in got] == ["a", "b"] * 5 and len({r.seq for r in got}) == 10
    assert sorted(r.text for r in clean.dedupe(outer).collect()) == ["a", "b"]
    many = samples.ingest([(str(i), one) for i in range(120)])
    assert many.select("seq").distinct().count() == 240


def test_positions_that_do_not_fit_are_an_error(spark):
    with pytest.raises(Exception, match="exceeds"):
        spark.range(1).select(samples.packed_seq(F.lit(1), F.lit(10**10))).collect()


def test_first_rows_of_files_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "d.jsonl")
    spark.range(0, 20_000, 1, 3).selectExpr("id as n", "repeat('x', 50) as t").write.json(path)
    rows = datasets.load_dataset(spark, path, 7000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert rows.count() == 7000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_each_json_file_decides_for_itself(spark, tmp_path):
    write(tmp_path / "a.json", '{"n": 1}\n\n{"n": 2}\n')
    write(tmp_path / "b.json", '[{"n": 3},\n {"n": 4, "m": "x"}]')
    write(tmp_path / "c.json", '\n{\n "n": 5\n}')
    write(tmp_path / "d.json", " \n")
    rows = datasets.load_folder(spark, str(tmp_path))
    assert sorted((r.n, r.m) for r in rows.collect()) == [(1, None), (2, None), (3, None), (4, "x"), (5, None)]
    assert sorted(r.n for r in datasets.load_folder(spark, str(tmp_path), schema="n bigint").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.n for r in datasets.load_folder(spark, str(tmp_path), all_files=False).collect()) == [1, 2]


def test_ingest_of_tables_equals_ingest_of_frames(spark, tmp_path):
    paths = []
    for k, name in enumerate(["b c", "a", "a%20x", "none"]):
        path = str(tmp_path / f"{name}.parquet")
        n = 0 if name == "none" else 5 + k
        spark.range(n).select((F.col("id") * 3 - 4).alias("seq"), F.concat(F.lit(f"{name} "), "id").alias("text"), F.lit(1).alias("file")).repartition(2).write.parquet(path)
        paths.append(path)
    inputs = [("k1", paths[1]), ("k0", paths[0]), ("k1", paths[1]), ("e", paths[3]), ("k2", paths[2])]
    frames = samples.ingest([(k, samples.from_table(spark.read.parquet(p))) for k, p in inputs])
    tables = samples.ingest_tables(spark, inputs)
    want = [(r.input_kind, r.text) for r in frames.orderBy("seq").collect()]
    got = tables.orderBy("seq").collect()
    assert [(r.input_kind, r.text) for r in got] == want and len(want) == 6 + 5 + 6 + 7
    assert len({r.seq for r in got}) == len(got)


def test_first_lines_come_from_first_blocks(spark, tmp_path, plan_nodes):
    from textloom.sources import datasets

    (tmp_path / "a.json").write_text("\n \n" + '{"x": 1}\n{"x": 2}\n')
    (tmp_path / "b.json").write_text('[{"x": 3},\n{"x": 4}]')
    assert sorted(r.x for r in datasets.load_folder(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]
    (tmp_path / "c.json").write_text(" \n" * 300 + '{"x": 5}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        first = datasets._line_files(spark, [str(tmp_path)], F.col("_metadata.file_block_start") == 0)
        assert sorted(f.rpartition("/")[2] for f, _ in first) == ["a.json", "b.json"]
        assert sorted(r.x for r in datasets.load_folder(spark, str(tmp_path), schema="x int").collect()) == [1, 2, 3, 4, 5]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_unreadable_files_are_errors_or_skipped(spark, tmp_path):
    import gzip

    folder = tmp_path / "x.jsonl"
    folder.mkdir()
    (folder / "a.json").write_text('{"text": "good"}\n')
    whole = gzip.compress("".join(f'{{"text": "line {i} {i * i}"}}\n' for i in range(5000)).encode())
    (folder / "b.json.gz").write_bytes(whole[:len(whole) // 2])
    (tmp_path / "c.txt").write_text("also good")
    paths = [str(folder), str(tmp_path / "c.txt")]
    with pytest.raises(Exception):
        files.read_files(spark, paths).collect()
    got = {r.text for r in files.read_files(spark, paths, on_unreadable="skip").collect()}
    assert {"good", "also good"} <= got
    with pytest.raises(ValueError):
        files.read_files(spark, paths, on_unreadable="maybe")
