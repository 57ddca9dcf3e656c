import csv as pycsv
import io
import json
import random

import pytest

from textloom.sources import csv, files, framing


@pytest.fixture
def small_blocks(spark):
    """Many blocks in each file, several of them in one task."""
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def cells_of(rows, names):
    words = set(csv.NULL_WORDS)
    return sorted((tuple(None if c in words else c for c in r) for r in rows), key=repr)


def some_cells(rnd, end):
    piece = lambda: rnd.choice(["a", "b,c", 'say "x"', f"two{end}lines", "", "é", "x" * rnd.randint(0, 60), '"', f"{end}{end}", ",", "12"])
    return [[str(i), piece() + piece(), piece()] for i in range(rnd.randint(1, 60))]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_framed_csv_equals_python(spark, tmp_path, small_blocks, end):
    rnd = random.Random(len(end))
    for trial in range(2):
        rows = []
        for k in range(2):
            part = some_cells(rnd, end)
            if k == 1:
                part.append(["big", f"line{end}" * 300, "z"])
            out = io.StringIO(newline="")
            pycsv.writer(out, lineterminator=end, quoting=rnd.choice([pycsv.QUOTE_MINIMAL, pycsv.QUOTE_ALL])).writerows([["id", "one, or", "t\nwo"]] + part)
            folder = tmp_path / f"{len(end)}-{trial}"
            folder.mkdir(exist_ok=True)
            (folder / f"{k}.csv").write_bytes(out.getvalue().encode())
            rows += part
        got = csv.read_strings(spark, str(folder), large_bytes=0)
        assert got.columns == ["id", "one, or", "t\nwo"]
        assert sorted(map(tuple, got.collect()), key=repr) == cells_of(rows, got.columns)


def test_one_file_many_tasks(spark, tmp_path, small_blocks):
    text = "id,text\n" + "".join(f'{i},"a\nb{i}"\n' for i in range(400))
    (tmp_path / "x.csv").write_text(text)
    scan = framing.scan_blocks(spark, [str(tmp_path / "x.csv")], "\n")
    assert scan.rdd.getNumPartitions() >= 8
    got = csv.read_csv(spark, str(tmp_path / "x.csv"), large_bytes=0)
    assert sorted(map(tuple, got.collect())) == [(i, f"a\nb{i}") for i in range(400)]


@pytest.mark.parametrize("body", ['a"b,"x\ny"\n', ' "q",1\n"x\ny",2\n', 'a\rb,1\n"x\ny",2\n', '"a"b,1\n"c\nd",2\n'])
def test_loose_quotes_go_to_one_parser(spark, tmp_path, small_blocks, body):
    (tmp_path / "x.csv").write_bytes(("h,k\n" + body).encode())

    def read(**options):
        try:
            return sorted(map(tuple, csv.read_strings(spark, str(tmp_path / "x.csv"), **options).collect()), key=repr)
        except Exception as e:
            return type(e)

    assert read(large_bytes=0) == read(multi_line=True)


def test_files_of_both_kinds_and_other_columns(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text('h,k\n"x\ny",1\n\n   \n')
    (tmp_path / "b.csv").write_text("h,k\nplain,2\n")
    got = sorted(map(tuple, csv.read_strings(spark, str(tmp_path), large_bytes=0).collect()))
    assert got == [("plain", "2"), ("x\ny", "1")]
    (tmp_path / "c.csv").write_text('h,other\n"x\ny",1\n')
    with pytest.raises(Exception):
        csv.read_strings(spark, str(tmp_path), large_bytes=0).collect()
    (tmp_path / "c.csv").write_text('h,k\n"x\ny"\n')
    with pytest.raises(Exception):
        csv.read_strings(spark, str(tmp_path), large_bytes=0).collect()


def some_items(rnd):
    word = lambda: rnd.choice(["a", "],[", "{", 'q"', "\\", "\\\"", "é", "x" * rnd.randint(0, 50), "\n\n", "  ", ",,,", "😀"])
    item = lambda: rnd.choice([
        {"text": word() + word(), "n": [1, {"a": [2, "]"]}]}, {"text": word()}, word(), 5, None, True, [1, [2, word()]], {"other": word()}, {"text": 7}, {"text": "dup"},
        1.5e300, {"text": word(), "x": {}}])
    return [item() for _ in range(rnd.randint(0, 50))]


@pytest.mark.parametrize("on_bad", ["skip", "stop_file"])
def test_elements_of_arrays_equal_whole_documents(spark, tmp_path, small_blocks, on_bad):
    rnd = random.Random(5)
    for k in range(4):
        dump = json.dumps(some_items(rnd), indent=rnd.choice([None, 2]), ensure_ascii=rnd.random() < 0.5)
        (tmp_path / f"{k}.json").write_text(rnd.choice(["", " \n"]) + dump + rnd.choice(["", "\n \n"]), encoding="utf-8")
    (tmp_path / "long.json").write_text(json.dumps([{"text": "y, " * 2000}, {"text": "z"}]))

    def read(large):
        rows = files.read_files(spark, [str(tmp_path)], on_bad=on_bad, large_json_bytes=large).orderBy("seq").collect()
        return [(r.text, r.source) for r in rows]

    assert read(0) == read(1 << 30) and len(read(0)) > 20


DOCUMENTS = [
    '[{"text": "a"},, {"text": "b"}]', '[{"text": "a"}', '[{"text": "a"},]', '[{"text": "a"}] x', '{"text": "one, object"}', "[]", " [ ] ", "[,]", '"a,b"', "",
    '[{"text": "a"}],[{"text": "b"}]', '[{"text": "a"} {"text": "b"}]', '[{"text": "a\\"}, {"text": "b"}]', '[NaN, {"text": "a"}]', "[1, 2}", '[\u00a01, "b"]',
    '\ufeff[{"text": "a"}, {"text": "b"}]', '["a", \\"b"]', '[["x, y"], {"text": "k", "text": "l"}]']


def test_odd_documents_equal_the_whole_form(spark, tmp_path):
    for k, document in enumerate(DOCUMENTS):
        (tmp_path / f"{k:02d}.json").write_text(document, encoding="utf-8")
    (tmp_path / "y.json").write_bytes(b'[{"text": "\xff"}, {"text": "b"}]')

    def read(large):
        rows = files.read_files(spark, [str(tmp_path)], large_json_bytes=large).orderBy("seq").collect()
        return [(r.source.rpartition("/")[2], r.text) for r in rows]

    assert read(0) == read(1 << 30)
