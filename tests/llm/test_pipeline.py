"""Each stage of the pipeline against brute force on what the stage before it kept."""

import hashlib

import corpus_pipeline as cp
from test_packing import check
from test_quality import brute as metrics
from test_simhash import brute_components, brute_fingerprint

from textloom.llm.mixing import targets
from textloom.storage import work_path

SF = "/root/testdata/sf0.01"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def mixed(rows):
    """(doc_id, copies) by the seeded order of each source."""
    sizes, own = {}, {}
    for r in rows:
        own.setdefault(r.source, []).append((hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest(), r.doc_id, metrics(r.text)[0]))
    for s, docs in own.items():
        sizes[s] = sum(n for _, _, n in docs)
    out = []
    for s, want in targets(sizes).items():
        at = 0
        for _, d, n in sorted(own[s]):
            copies = sum(n > 0 and 2 * (k * sizes[s] + at) + n <= 2 * int(want) for k in range(2))
            out += [d] * copies
            at += n
    return sorted(out)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, []
    for name, f in cp.STAGES:
        out = f(spark, docs, SF)
        path = work_path(spark, "pipeline-test")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        results.append(docs.collect())
        if name != "packing":
            assert docs.columns == columns
    start = spark.read.parquet(f"{SF}/documents.parquet").collect()
    quality, exact, near, mix, packed = results
    ids = lambda rows: sorted(r.doc_id for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    base_failed = {r.doc_id for r in start if (m := metrics(r.text))[0] < 20 or 100 * m[4] > 30 * m[0]}
    gone = set(ids(start)) - set(ids(quality))
    assert base_failed <= gone
    assert all(labels.get(d, 0) == 0 for d in gone - base_failed)
    last = {}
    for r in quality:
        last[lower(r.text)] = max(last.get(lower(r.text), -1), r.doc_id)
    assert ids(exact) == sorted(last.values())
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in exact]
    assert ids(near) == sorted(set(brute_components(fps)))
    assert ids(mix) == mixed(near)
    # A document taken twice is two documents for the last stage.
    assert check(packed, [(r.doc_id, r.text) for r in mix]) < 0.02


def test_odd_documents_pass_through(spark, tmp_path):
    rows = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (None, "word " * 30 + "one two three four five.", "en", None, 1),
        (None, "word " * 30 + "one two three four five.", "en", None, 1),
        (7, " ".join(f"w{i}" for i in range(60)) + ".", "en", "a", 5), (7, " ".join(f"w{i}" for i in range(60)) + ".", "en", "a", 5),
        (8, " ".join(f"v{i}" for i in range(200_000)) + ".", "en", "b", 5), (None, " ".join(f"u{i}" for i in range(60)) + ".", None, "b", 5),
    ]
    for name, data in (("some", rows), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame([(*r, "x", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long, kept string, rf long").write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        got = cp.run(spark, sf).collect()
        if name == "none":
            assert got == []
        else:
            assert {7, 8, None} == {r.doc_id for r in got}
            assert len({r.sequence_id for r in got if r.doc_id == 7}) <= 2
