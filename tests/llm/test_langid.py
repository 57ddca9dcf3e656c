import re
import zlib

import numpy as np

from textloom.llm import langid
from textloom.llm.queries import QUERIES


def test_windows_hold_every_byte():
    rng = np.random.default_rng(0)
    n = np.array([0, 1, 256, 257, 0, 1000, 511, 512])
    data = rng.integers(1, 256, n.sum()).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum(n)])
    x, row, new = langid.windows(data, offsets)
    for i in range(len(n)):
        mine = data[offsets[i]:offsets[i + 1]]
        w = x[row == i]
        assert len(w) == -(-len(mine) // 256) and new[row == i].sum() == len(mine)
        got = b"".join(bytes(v[-k:] if len(mine) > 256 and j == len(w) - 1 else v[:k]) for j, (v, k) in enumerate(zip(w, new[row == i].tolist())))
        assert got == bytes(mine)


def test_gradients_and_folded_tables():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(0, 256, (5, 40)), np.array([0, 1, 2, 1, 0])
    g, loss = net.step(x, y, None)
    for name in net.w:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        net.w[name][at] += 1e-5
        up = net.step(x, y, None)[1]
        net.w[name][at] -= 2e-5
        down = net.step(x, y, None)[1]
        net.w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-3 * max(1, abs(g[name][at])), name
    p = net.probabilities(x)
    assert abs(-np.log(p[np.arange(5), y]).mean() - loss) < 1e-4


def test_odd_rows(spark):
    model = langid.Network(["x", "y"]).train(np.array([[120] * 256, [121] * 256] * 20, np.uint8), np.array([0, 1] * 20), steps=60)
    texts = [None, "", "123 !!", "x" * 300, "y" * 3, "y" * 3_000_000, "é", "\n"]
    docs = spark.createDataFrame([(None if i == 4 else i, t, "z", 1.0) for i, t in enumerate(texts * 2)], "doc_id long, text string, lettered string, score double")
    got = langid.identify(docs, model).collect()
    assert len(got) == 16 and all(0 <= r.score <= 1 for r in got)
    pred = [r.lang_pred for r in got][:8]
    assert pred[:3] == ["und"] * 3 and pred[3] == "x" and pred[5] == "y" and pred[6] in "xy" and pred[7] == "und"
    assert langid.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.fit(docs.selectExpr("*", "cast(null as string) as lang")) is None


def test_query_is_right_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    right = n = 0
    for r in rows:
        d = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not re.search(r"[^\W\d_]", d.text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and d.lang:
            n += 1
            right += r.lang_pred == d.lang
    assert right >= 0.97 * n, (right, n)
