import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textloom import storage
from textloom.operators import clean
from textloom.plans import build as bld


def docs(spark, rows):
    return spark.createDataFrame(rows, "seq bigint, text string, source string, split string")


def read(spark, result):
    path, fmt = result.output, "parquet" if result.format == "parquet" else "json"
    return spark.read.schema("text string, source string, split string").option(
        "multiLine", result.format == "json").format(fmt).load(path)


@pytest.fixture
def corpus(spark):
    rows = [(i, f"text number {i % 35:03d} " + "x" * (i % 70), f"s{i % 3}", "") for i in range(200)]
    return docs(spark, rows), rows


@pytest.fixture
def no_broadcasts(spark, monkeypatch):
    """As if nothing were small enough to broadcast."""
    for name in ("MAX_BROADCAST_ROWS", "MAX_BROADCAST_BITS"):
        monkeypatch.setattr(storage, name, 0)
    monkeypatch.setattr(storage, "BUCKETED_TASKS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_position_sets_hold_rows_that_the_filters_drop(spark, no_broadcasts):
    rows = [(i, "x" * (5 if 100 <= i < 400 else 30) + str(i % 450), "s", "") for i in range(1000)]
    staged = storage.stage_rows(docs(spark, rows).coalesce(1), "samples")
    kept, _ = expected(rows, True, 20, 60)
    assert sorted(r.seq for r in bld.choose(staged, True, 20, 60).apply(staged).collect()) == [r[0] for r in kept]


def expected(rows, dedupe, low, high):
    """Plain Python: first wins, then the length filters."""
    seen, kept, removed = set(), [], {"duplicates": 0} if dedupe else {}
    for row in rows:
        if dedupe and row[1] in seen:
            removed["duplicates"] += 1
            continue
        seen.add(row[1])
        kept.append(row)
    if low > 0:
        removed["too_short"] = sum(len(r[1]) < low for r in kept)
        kept = [r for r in kept if len(r[1]) >= low]
    if high > 0:
        removed["too_long"] = sum(len(r[1]) > high for r in kept)
        kept = [r for r in kept if len(r[1]) <= high]
    return kept, removed


@pytest.mark.parametrize("bound", [4_000_000, 40, 0])
@pytest.mark.parametrize("fmt, dedupe, low, high", [
    ("jsonl", True, 20, 60), ("json", True, 0, 0), ("parquet", False, 20, 60), ("jsonl", False, 0, 0)])
def test_build(spark, corpus, tmp_path, monkeypatch, bound, fmt, dedupe, low, high):
    """All three ways to drop copies (both broadcasts, position sets) give the same rows."""
    monkeypatch.setattr(storage, "MAX_BROADCAST_ROWS", bound)
    monkeypatch.setattr(storage, "BUCKETED_TASKS", 1)
    samples, rows = corpus
    result = bld.build(samples, str(tmp_path / "out.x"), "n", fmt, dedupe=dedupe, min_chars=low, max_chars=high,
                       seq_is_stored=True)
    kept, removed = expected(rows, dedupe, low, high)
    got = read(spark, result).collect()
    assert sorted((r.text, r.source) for r in got) == sorted((r[1], r[2]) for r in kept)
    assert result.samples == len(kept) and result.removed == removed
    sizes = {"train": int(len(kept) * 0.9), "validation": int(len(kept) * 0.05)}
    sizes["test"] = len(kept) - sum(sizes.values())
    assert result.splits == {k: v for k, v in sizes.items() if v}
    meta = json.loads(next((tmp_path / "out.meta.json").glob("part-*")).read_text())
    assert meta["sample_count"] == len(kept) and meta["splits"] == result.splits and meta["removed"] == removed
    assert meta["split_ratios"] == [0.9, 0.05, 0.05] and meta["name"] == "n" and meta["created"]


def test_few_survivors_use_the_smaller_side(spark, tmp_path, monkeypatch):
    hints = []
    monkeypatch.setattr(bld, "F", SimpleNamespace(**{**vars(F), "broadcast": lambda d: hints.append(d.columns) or F.broadcast(d)}))
    rows = [(i, "same text", "s", "") for i in range(50)] + [(99, "other", "s", "")]
    result = bld.build(docs(spark, rows), str(tmp_path / "o"), "n", seq_is_stored=True)
    assert result.samples == 2 and result.removed == {"duplicates": 49} and hints == [["seq"]]


@pytest.mark.parametrize("stored", [True, False])
def test_no_text_moves_without_broadcasts(spark, corpus, no_broadcasts, plan_nodes, stored):
    samples, rows = corpus
    samples = samples.repartition(6)
    if not stored:
        samples = storage.stage_rows(samples, "samples")
    for out in (bld.choose(samples, True, 20, 60).apply(samples), clean.dedupe(samples)):
        nodes = plan_nodes(out)
        assert any(name.startswith("ShuffledHashJoin") or name.startswith("SortMergeJoin") for name, _ in nodes)
        assert not [n for n, columns in nodes if "Exchange" in n and "text" in columns]
    kept, _ = expected(rows, True, 20, 60)
    out = bld.choose(samples, True, 20, 60).apply(samples)
    assert sorted(r.seq for r in out.select("seq").collect()) == [r[0] for r in kept]
    firsts, _ = expected(rows, True, 0, 0)
    assert sorted(r.seq for r in clean.dedupe(samples).collect()) == [r[0] for r in firsts]


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_rows_of_a_task_stay_in_its_bucket(spark, monkeypatch, tasks):
    monkeypatch.setattr(storage, "BUCKETED_TASKS", 2)
    df = spark.range(0, 2000, 1, tasks).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("text"))
    staged = storage.stage_rows(df, "rows")
    assert staged.select("_shard").distinct().count() == tasks and len(staged.inputFiles()) == tasks
    assert sorted(r.seq for r in staged.collect()) == list(range(2000))
    for kept in ([], [0], [1999], list(range(0, 2000, 7)), list(range(2000))):
        wanted = spark.createDataFrame([(k,) for k in kept + kept[:1]], "seq bigint")  # one position twice
        out = storage.keep_rows(staged, wanted)
        assert out.columns == ["seq", "text"]
        assert sorted(r.seq for r in out.collect()) == kept
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("textloom_")]
    assert not tables


def test_a_task_beyond_the_counted_ones_keeps_its_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "BUCKETED_TASKS", 1)
    numbers = storage._shard_numbers
    monkeypatch.setattr(storage, "_shard_numbers", lambda s, n: numbers(s, n).filter("_task < 3"))
    staged = storage.stage_rows(spark.range(0, 100, 1, 5).withColumnRenamed("id", "seq"), "rows")
    out = storage.keep_rows(staged, spark.range(50).withColumnRenamed("id", "seq"))
    assert staged.count() == 100 and sorted(r.seq for r in out.collect()) == list(range(50))


def test_staging_gives_the_same_result(spark, corpus, tmp_path):
    samples, _ = corpus
    a = bld.build(samples, str(tmp_path / "a"), "n", min_chars=20)
    b = bld.build(samples, str(tmp_path / "b"), "n", min_chars=20, seq_is_stored=True)
    assert sorted(map(tuple, read(spark, a).collect())) == sorted(map(tuple, read(spark, b).collect()))


def test_ordered_output(spark, corpus, tmp_path):
    samples, rows = corpus
    result = bld.build(samples.repartition(4), str(tmp_path / "a"), "n", "parquet", dedupe=False, ordered=True)
    files = sorted((tmp_path / "a.parquet").glob("part-*"))
    got = [r.text for f in files for r in spark.read.parquet(str(f)).collect()]
    assert got == [r[1] for r in rows] and result.samples == 200


def test_zero_ratios_keep_the_splits(spark, tmp_path):
    rows = [(1, "a", "s", "mine"), (2, "b", "s", ""), (3, "a", "s", "late")]
    for name, dedupe, want in (("d", True, {"mine": 1, "": 1}), ("k", False, {"mine": 1, "": 1, "late": 1})):
        result = bld.build(docs(spark, rows), str(tmp_path / name), "n", split_ratios=(0, 0, 0), dedupe=dedupe)
        assert result.splits == want


def test_empty_input_and_empty_result(spark, tmp_path):
    with pytest.raises(ValueError):
        bld.build(docs(spark, []), str(tmp_path / "a"), "n")
    result = bld.build(docs(spark, [(1, "a", "s", "")]), str(tmp_path / "b"), "n", "parquet", min_chars=40)
    back = spark.read.parquet(result.output)
    assert result.samples == 0 and result.splits == {} and back.count() == 0 and back.columns == ["text", "source", "split"]


def test_arguments_are_checked_first(spark, tmp_path):
    rows = docs(spark, [(1, "a", "s", "")])
    for args in (dict(name="n", format="xml"), dict(name=""), dict(name="n", split_ratios=(-1, 0, 0))):
        with pytest.raises(ValueError):
            bld.build(rows, str(tmp_path / "x"), **args)
    assert not list(tmp_path.iterdir())


def test_column_names(spark, tmp_path):
    result = bld.build(docs(spark, [(1, "a", "s", "")]), str(tmp_path / "x"), "n", text_column="body", source_column="origin")
    assert spark.read.json(result.output).columns == ["body", "origin", "split"]


def test_builds_from_lists_files_and_pages(spark, tmp_path):
    long = "a text that is longer than forty characters, surely"
    result = bld.build_from_texts(spark, "n", [long, "short", long, long + "!"], str(tmp_path / "t"), max_chars=51)
    assert (result.samples, result.removed) == (1, {"duplicates": 1, "too_short": 1, "too_long": 1})
    (tmp_path / "a.txt").write_text(long)
    (tmp_path / "b.jsonl").write_text(json.dumps({"text": long}) + "\n" + json.dumps({"text": "b" * 40}))
    result = bld.build_from_files(spark, "n", [str(tmp_path / "b.jsonl"), str(tmp_path / "a.txt")], str(tmp_path / "f"))
    assert {(r.text, r.source) for r in read(spark, result).collect()} == {
        (long, str(tmp_path / "b.jsonl")), ("b" * 40, str(tmp_path / "b.jsonl"))}
    pages = spark.createDataFrame([(1, "http://a/b", f"<p>{long}<p>no</p>"), (2, "ftp://a", f"<p>{long}x</p>")],
                                  "page_id bigint, url string, html string")
    result = bld.build_from_pages("n", pages, str(tmp_path / "p"))
    assert [(r.text, r.source) for r in read(spark, result).collect()] == [(long + " no", "http://a/b")]


def test_preview(spark):
    rows = docs(spark, [(i, "xy"[i % 2] * (i + 1 - i % 2), "s", "") for i in range(20)] + [(30, "x", "s", "")])
    count, head = bld.preview_build(rows, 3, drop_duplicates=True, min_chars=2)
    assert count == 18 and [r.seq for r in head.collect()] == [2, 3, 4]


def test_broadcast_bound(spark):
    staged = storage.stage(spark.range(10), "t")
    assert "ResolvedHint" in storage.broadcast_if_small(staged)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in storage.broadcast_if_small(staged, 5)._jdf.queryExecution().analyzed().toString()


def test_work_path_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    path = storage.work_path(spark, "x")
    assert before is None or path.startswith(before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_wide_row_moves_while_the_copies_are_few(spark, corpus, tmp_path):
    """Copies are broadcast, the split is a projection; beyond the bound each row looks up its bit."""
    samples, _ = corpus
    samples.write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    chosen = bld.choose(stored, True, 20, 60)
    few = bld.Choice(chosen.rows, chosen.first, chosen.kept, {**chosen.counts, "duplicates": 5}, 20, 60)
    plan = plan_of(few.apply(stored))
    assert "BroadcastHashJoin" in plan and "LeftAnti" in plan and "Exchange hashpartitioning" not in plan
    many = {**chosen.counts, "duplicates": 10**10, "kept": 10**10}
    plan = plan_of(bld.Choice(chosen.rows, chosen.first, chosen.kept, many, 20, 60).apply(stored))
    assert "_shard" in plan and "LeftSemi" in plan
    copies = bld.Choice(chosen.rows, chosen.first, chosen.kept, {**chosen.counts, "duplicates": 0}, 20, 60)
    assert "Join" not in plan_of(copies.apply(stored))


def test_only_needed_columns_are_read(spark, tmp_path):
    from textloom.sources.samples import from_table

    spark.range(5).selectExpr("id", "'a' body", "'b' other", "id more").write.parquet(str(tmp_path / "in"))
    rows = from_table(spark.read.parquet(str(tmp_path / "in")), "body", seq="id")
    assert "ReadSchema: struct<id:bigint,body:string>" in plan_of(rows)
    assert "ReadSchema: struct<body:string>" in plan_of(rows.select("text"))


def test_one_text_and_one_source_in_a_third_of_all_rows(spark, tmp_path):
    rows = spark.range(3000).selectExpr(
        "id seq", "if(id % 3 = 0, 'the hot text', concat('text ', id)) text", "if(id % 3 = 0, 'hot', 'cold') source", "'' split")
    result = bld.build(rows, str(tmp_path / "o"), "n", seq_is_stored=True)
    assert result.samples == 2001 and result.removed == {"duplicates": 999}
    assert result.splits == {"train": 1800, "validation": 100, "test": 101}
