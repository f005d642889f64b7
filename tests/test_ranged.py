from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assetlake.operators.ranged import differing_ranges, range_of, ranged_diff, read_ranged, write_ranged
from assetlake.operators.versions import table_diff


def rows_of(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_opened(df) -> int:
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles"))


def test_one_changed_row_opens_one_range_of_each_state(spark, tmp_path):
    before = spark.range(5_000).selectExpr("id as k", "id % 7 as v", "cast(null as string) as t")
    after = before.withColumn("v", F.when(F.col("k") == 1234, -1).otherwise(F.col("v")))
    write_ranged(before, f"{tmp_path}/a", "k", ranges=40)
    write_ranged(after, f"{tmp_path}/b", "k", like=f"{tmp_path}/a")
    assert len(differing_ranges(spark, f"{tmp_path}/a", f"{tmp_path}/b")) == 1
    diff = ranged_diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", "k")
    assert [tuple(r) for r in diff.collect()] == [(1234, "changed")]
    [number] = differing_ranges(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    assert files_opened(read_ranged(spark, f"{tmp_path}/a", [number])) < files_opened(read_ranged(spark, f"{tmp_path}/a")) / 20
    assert differing_ranges(spark, f"{tmp_path}/a", f"{tmp_path}/a") == []
    assert ranged_diff(spark, f"{tmp_path}/a", f"{tmp_path}/a", "k").count() == 0


@pytest.mark.parametrize("key", ["k", ["k", "j"]])
def test_equals_table_diff(spark, tmp_path, key):
    pick = random.Random(2)
    schema = "k string, j int, v double, w int"
    rows = {(pick.choice([None, "a", "b", "é", "zz"]), pick.choice([None, *range(200)])): (pick.random(), pick.choice([None, 1])) for _ in range(500)}
    if key == "k":
        rows = {(f"k{i}" if i else None, 0): v for i, v in enumerate(rows.values())}
    later = {k: (v if pick.random() > 0.1 else (v[0], 2 if v[1] is None else None)) for k, v in rows.items() if pick.random() > 0.05}
    later |= {("new", i) if key != "k" else (f"new{i}", i): (0.5, i) for i in range(9)}
    a, b = [spark.createDataFrame([(*k, *v) for k, v in state.items()], schema) for state in (rows, later)]
    if key == "k":
        a, b = a.drop("j"), b.drop("j")
    write_ranged(a, f"{tmp_path}/a", key, ranges=30)
    write_ranged(b, f"{tmp_path}/b", key, like=f"{tmp_path}/a")
    assert rows_of(read_ranged(spark, f"{tmp_path}/b").select(*b.columns)) == rows_of(b)
    assert rows_of(ranged_diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", key)) == rows_of(table_diff(a, b, key))


def test_nulls_that_change_places_are_seen(spark, tmp_path):
    a = spark.createDataFrame([(1, None, 5)], "k int, x int, y int")
    b = spark.createDataFrame([(1, 5, None)], "k int, x int, y int")
    write_ranged(a, f"{tmp_path}/a", "k", ranges=3)
    write_ranged(b, f"{tmp_path}/b", "k", like=f"{tmp_path}/a")
    assert ranged_diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", "k").first()["change"] == "changed"
    write_ranged(b, f"{tmp_path}/c", "k", ranges=1)
    write_ranged(spark.range(99).selectExpr("int(id) as k", "1 as x", "2 as y"), f"{tmp_path}/d", "k", ranges=5)
    with pytest.raises(ValueError, match="different bounds"):
        differing_ranges(spark, f"{tmp_path}/c", f"{tmp_path}/d")


def test_empty_states(spark, tmp_path):
    empty = spark.createDataFrame([], "k int, v int")
    write_ranged(empty, f"{tmp_path}/a", "k", ranges=4)
    write_ranged(spark.createDataFrame([(1, 2)], "k int, v int"), f"{tmp_path}/b", "k", like=f"{tmp_path}/a")
    assert [tuple(r) for r in ranged_diff(spark, f"{tmp_path}/a", f"{tmp_path}/b", "k").collect()] == [(1, "added")]


def test_binary_search(spark):
    keys = spark.range(-3, 40).select("id", *[range_of(F.struct("id"), [(b,) for b in range(0, 3 * n, 3)], "struct<id:bigint>").alias(f"n{n}") for n in (1, 2, 7, 8)])
    for r in keys.collect():
        assert all(r[f"n{n}"] == min(n, max(0, r["id"] // 3 + 1)) for n in (1, 2, 7, 8))
