import random

from pyspark.sql import functions as F

from textloom.operators import catalog_index as index
from textloom.operators.catalog import search_catalog


def a_catalog(spark, n=300):
    rnd = random.Random(1)
    words = ["red", "Blue", "dataset", "größe", "ab", "x", "😀😀😀", "red-blue", "", "long " * 30]
    rows = [(f"own{i % 7}/" + rnd.choice(words) + str(i), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6))) if i % 9 else None, i) for i in range(n)]
    return spark.createDataFrame(rows, "id string, description string, downloads bigint")


def test_indexed_search_equals_scan(spark, tmp_path, monkeypatch):
    catalog = a_catalog(spark)
    path = index.write_index(catalog, str(tmp_path / "i"), files=3)
    for listed in (1000, 2):
        monkeypatch.setattr(index, "LISTED_ROWS", listed)
        for query in ("red", "RED-b", "Größe", "😀😀", "ab", "", "no such words", "own3/", "set x", "long long long", "ed da"):
            want = search_catalog(catalog, query=query, limit=None).collect()
            assert index.search_indexed(spark, path, query, limit=None).collect() == want, query
    some = index.search_indexed(spark, path, "red", limit=5, author="own2").collect()
    assert some == search_catalog(catalog, query="red", limit=5, author="own2").collect()


def test_index_rows_are_the_distinct_pieces(spark, tmp_path):
    catalog = a_catalog(spark, 40)
    path = index.write_index(catalog, str(tmp_path / "i"))
    want = 0
    for r in catalog.collect():
        texts = [r.id.lower(), (r.description or "").lower()]
        want += len({t[i:i + 3] for t in texts for i in range(len(t) - 2)})
    assert spark.read.parquet(f"{path}/postings").count() == want
    assert spark.read.parquet(f"{path}/counts").agg(F.sum("rows")).first()[0] == want


def test_few_candidates_are_pruned_in_the_scan(spark, tmp_path):
    path = index.write_index(a_catalog(spark), str(tmp_path / "i"))
    plan = index.search_indexed(spark, path, "own3/red")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "row" in plan.split("PushedFilters")[1]


def test_empty_catalog(spark, tmp_path):
    path = index.write_index(a_catalog(spark).filter("id is null"), str(tmp_path / "i"))
    assert index.search_indexed(spark, path, "red").collect() == []


def test_a_catalogue_of_one_file_is_shared_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_ROWS", 50)
    a_catalog(spark).coalesce(1).write.parquet(str(tmp_path / "c"))
    catalog = spark.read.parquet(str(tmp_path / "c"))
    path = index.write_index(catalog, str(tmp_path / "i"))
    assert len(spark.read.parquet(f"{path}/rows").inputFiles()) == 6
    assert index.search_indexed(spark, path, "red", limit=None).collect() == search_catalog(catalog, query="red", limit=None).collect()
