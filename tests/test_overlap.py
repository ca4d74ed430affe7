import random

import pytest

from barloom.operators.folds import _test_blocks, purged_rows
from barloom.operators.overlap import overlap_join


def _plain(left, right):
    return sorted((i, j) for i, k, a, b in left for j, m, c, d in right if None not in (k, m, a, b, c, d) and k == m and a <= b and c <= d and a <= d and c <= b)


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_overlaps_equal_all_pairs(spark, width):
    draw = random.Random(width)

    def spans(n, longest):
        return [(i, draw.choice("AAAB"), a := draw.randint(-50, 200), a + draw.randint(-1, longest)) for i in range(n)]

    left = [*spans(120, 6), (900, None, 1, 2), (901, "A", None, 2), (902, "A", 3, None), (903, "A", 5, 5), (904, "A", 5, 5)]
    right = [*spans(40, 90), (900, None, 1, 2), (901, "A", 0, None)]
    a = spark.createDataFrame(left, "i int, k string, a bigint, b bigint")
    b = spark.createDataFrame(right, "j int, k string, c bigint, d bigint")
    found = overlap_join(a, b, ["k"], ("a", "b"), ("c", "d"), width).select("i", "j").collect()
    assert sorted(map(tuple, found)) == _plain(left, right)
    assert overlap_join(a.limit(0), b, ["k"], ("a", "b"), ("c", "d"), width).count() == 0


def test_names_of_both_sides_are_refused(spark):
    a = spark.createDataFrame([(1, 2, 3)], "k int, a int, b int")
    with pytest.raises(ValueError, match="both sides"):
        overlap_join(a, a, ["k"], ("a", "b"), ("a", "b"))


def test_purged_rows_meet_by_bin(spark):
    rows = [("A", r, 2000, r, min(r + 4, 1999)) for r in range(2000)] + [("B", r, 3, r, r + 1) for r in range(3)]
    numbered = spark.createDataFrame(rows, "symbol string, row bigint, n_rows bigint, event_start bigint, event_end bigint")
    found = purged_rows(numbered, 50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert any("_bin" in line and "symbol" in line for line in plan.splitlines() if "Join Inner" in line)
    want = []
    for b in _test_blocks(numbered, 50).collect():
        for symbol, r, _, start, end in rows:
            if symbol == b["symbol"] and r < b["_first"] and start <= b["_test_to"] and end >= b["_test_from"]:
                want.append((symbol, r, b["fold"]))
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 190
