"""Inputs that queries build are written by many tasks."""

import os

import pytest

from textloom import queries
from textloom.queries import QUERIES
from textloom.sources import csv, datasets


@pytest.mark.parametrize("name, suffix", [("csv_quoted_newlines", ".csv"), ("json_array_large", ".txt"), ("fetch_datasets", ".csv")])
def test_no_task_writes_the_whole_input(spark, tmp_path, monkeypatch, name, suffix):
    texts = ['one "quoted"\n\nline, with a comma', "[two]\r\n{", "three", None, " four\n"]
    rows = [(10 * i + k, t, "en", len(t or "")) for i in range(3) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars int").selectExpr("*", "'web' as source")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    places = []

    def place(session, kind):
        places.append(f"{tmp_path}/work/{kind}-{len(places)}")
        return places[-1]

    monkeypatch.setattr(queries, "work_path", place)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a task for each file
    try:
        got = QUERIES[name](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    written = [f for d, _, names in os.walk(f"{tmp_path}/work") for f in names if f.startswith("part-") and f.endswith(suffix)]
    assert len(written) == 3
    if name == "json_array_large":
        assert sorted(r.text for r in got) == sorted(t.strip() for _, t, *_ in rows if t)
    else:
        want = [(i, t) for i, t, *_ in rows] * (3 if name == "fetch_datasets" else 1)
        assert sorted((r.doc_id, (r.text or "").strip()) for r in got) == sorted((i, (t or "").strip()) for i, t in want)


def test_blocks_of_framed_files_do_not_depend_on_other_files(spark, tmp_path):
    """Spark cuts a file at other places when it reads other files beside it."""
    rows = spark.range(4000).selectExpr("id as n", "concat('a\n', repeat('x', 40), id) as t")
    rows.coalesce(1).write.csv(f"{tmp_path}/f/a", header=True, quoteAll=True)
    spark.range(4000, 12000).selectExpr("id as n", "concat(repeat('y', 40), id) as t").coalesce(1).write.csv(f"{tmp_path}/f/b", header=True)
    (tmp_path / "f" / "c.csv").write_text("n,t\n")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        paths = [f"{tmp_path}/f/{x}" for x in ("a", "b", "c.csv")]
        got = csv.read_csv(spark, paths, large_bytes=0).collect()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert sorted(r.n for r in got) == list(range(12000)) and all(r.t.endswith(str(r.n)) for r in got)


def test_a_dataset_in_parts_counts_as_the_first_of_a_folder(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as n", "concat('a\n', id) as t")
    rows.repartition(4).write.csv(f"{tmp_path}/f/b.csv", header=True, quoteAll=True)
    rows.limit(3).coalesce(1).write.csv(f"{tmp_path}/f/c.csv", header=True, quoteAll=True)
    source = datasets.StoredDataset("folder", f"{tmp_path}/f", text_column="t")
    assert sorted(r.n for r in datasets.load_any(spark, source).collect()) == list(range(40))
    assert datasets.load_any(spark, source, max_samples=7).count() == 7
    assert sorted(r.n for r in datasets.load_folder(spark, f"{tmp_path}/f", all_files=False).collect()) == list(range(40))
    stream = datasets.load_any(spark, source, streaming=True, checkpoint=f"{tmp_path}/cp")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 40
