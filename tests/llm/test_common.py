import random

import pytest

from textloom.llm.common import running_before


@pytest.mark.parametrize("fan", [1, 7, 1 << 14])
def test_running_sums_equal_brute_force(spark, fan):
    rng = random.Random(fan)
    rows = [(k, o, rng.choice([None, 0, 1, 5, 10**12])) for k in (["a"], ["a", None], []) for o in sorted(rng.sample(range(300), 90))]
    df = spark.createDataFrame(rows, "k array<string>, o int, v bigint")
    got = {(tuple(r.k), r.o): (r.v, r.before) for r in running_before(df, ["k"], "o", "v", "before", fan).collect()}
    assert got == {(tuple(k), o): (v, sum(w or 0 for q, p, w in rows if q == k and p < o)) for k, o, v in rows}


def test_running_sums_without_key_and_without_rows(spark):
    df = spark.createDataFrame([(i, 2) for i in range(50)], "o bigint, v bigint")
    assert all(r.before == 2 * r.o for r in running_before(df, [], "o", "v", "before", 8).collect())
    assert running_before(df.limit(0), [], "o", "v", "before", 8).count() == 0
