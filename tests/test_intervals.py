from __future__ import annotations

import random
from collections import Counter

import pytest

from assetlake.operators.intervals import interval_join

LEFT, RIGHT = "k string, a int, b int, l int", "k string, c int, d int, r int"


def overlaps(left: list, right: list, keyed: bool) -> Counter:
    out = Counter()
    for k, a, b, n in left:
        for j, c, d, m in right:
            if None in (a, b, c, d) or a >= b or c >= d or (keyed and (k is None or k != j)):
                continue
            if a < d and c < b:
                out[n, m] += 1
    return out


def spans(pick: random.Random, n: int, most: int) -> list:
    rows = []
    for i in range(n):
        start = pick.choice([None, *range(60)])
        end = None if start is None or pick.random() < 0.03 else start + pick.randrange(-1, most)
        rows.append((pick.choice(["x", "x", "x", "y", None]), start, end, i // 2))
    return rows


@pytest.mark.parametrize("keyed", [True, False])
def test_pairs_by_brute_force(spark, keyed):
    pick = random.Random(4)
    left, right = spans(pick, 150, 25), spans(pick, 130, 4)
    left += [("x", 0, 60, 900), ("x", 10, 11, 901), ("x", 10, 11, 901)]
    right += [("x", 10, 11, 800 + i) for i in range(80)]  # one short stretch with very many
    frames = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    if not keyed:
        frames = frames[0].drop("k"), frames[1].drop("k")
    got = interval_join(*frames, ("a", "b"), ("c", "d"), ["k"] if keyed else [], parts=7)
    assert Counter((r["l"], r["r"]) for r in got.select("l", "r").collect()) == overlaps(left, right, keyed)


def test_empty_sides_and_clashing_columns(spark):
    some, none = spark.createDataFrame([("x", 1, 5, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert interval_join(some, none, ("a", "b"), ("c", "d"), ["k"]).count() == 0
    assert interval_join(none, some, ("c", "d"), ("a", "b"), ["k"]).columns == ["k", "c", "d", "r", "a", "b", "l"]
    with pytest.raises(ValueError, match="both sides"):
        interval_join(some, some, ("a", "b"), ("a", "b"), ["k"])


def test_one_hot_key_meets_no_nested_loop(spark):
    left = spark.range(20_000).selectExpr("'hot' as k", "int(id) as a", "int(id + 2) as b", "id as l")
    right = spark.range(20_000).selectExpr("'hot' as k", "int(id) as c", "int(id + 1) as d", "id as r")
    joined = interval_join(left, right, ("a", "b"), ("c", "d"), ["k"], parts=8)
    assert joined.count() == 2 * 20_000 - 1
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text
