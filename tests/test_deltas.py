from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assetlake.plans.assets import RUN_LOG, materialize, source
from assetlake.plans.deltas import Rollup, materialize_delta, only_groups, rollup_table, row_changes
from assetlake.plans.runlog import read_runs

SCHEMA = "k int, g string, x decimal(10,2), d date"
ROLLUP = Rollup(
    by={"g": "g", "year": "year(d)"}, sums={"total": "x", "double": "2 * x"}, counts={"n": "x"}, mins={"low": "x", "first": "d"},
    maxs={"high": "x"}, where="k <> 13",
)


def rows_of(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def random_rows(pick: random.Random, n: int) -> list[tuple]:
    import datetime as dt
    from decimal import Decimal

    return [
        (pick.randrange(40), pick.choice(["a", "b", None, "c d"]), pick.choice([None, Decimal(pick.randrange(12)) / 4]),
         pick.choice([None, dt.date(2020 + pick.randrange(3), 1 + pick.randrange(12), 5)])) for _ in range(n)
    ]


@pytest.mark.parametrize("partition_by", [[], ["year"]])
def test_any_changes_give_what_a_full_run_gives(spark, tmp_path, partition_by):
    pick, state = random.Random(9), random_rows(random.Random(8), 200)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    output = "g string, year int, rows bigint, total decimal(20,2), total_values bigint, double decimal(31,2), double_values bigint, n bigint, low decimal(10,2), first date, high decimal(10,2)"
    now = {"rows": state}
    asset = rollup_table("sales", source("lines", load=lambda s: frame(now["rows"])), ROLLUP, partition_by, output)
    materialize(spark, str(tmp_path), [asset])
    for step in range(3):
        before = now["rows"]
        kept = [r for r in before if pick.random() > 0.2]
        fresh = random_rows(pick, 25)
        if step == 2:  # whole groups and a partition go
            kept, fresh = [[r for r in rows if r[1] != "a" and (r[3] is None or r[3].year != 2021)] for rows in (kept, fresh)]
        now["rows"] = kept + fresh + kept[:3]
        changes = row_changes(frame(before), frame(now["rows"]))
        done = materialize_delta(spark, str(tmp_path), asset, changes)
        assert done.touched >= done.recomputed and (step != 2 or done.removed)
        assert rows_of(asset.read(spark, str(tmp_path)).select(*ROLLUP.columns)) == rows_of(ROLLUP.full(frame(now["rows"])))
    runs = read_runs(spark, f"{tmp_path}/{RUN_LOG}")
    assert runs.filter("slots = array('delta')").count() == 3


def test_changes_count_repeats_and_cancel(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (2, None), (3, "y")], "k int, v string")
    assert rows_of(row_changes(a, b)) == Counter([(1, "x", -1), (2, None, 1), (3, "z", -1), (3, "y", 1)])
    with pytest.raises(ValueError, match="differ"):
        row_changes(a, b.drop("v"))


def test_only_groups_that_lost_their_extreme_are_read_again(spark, tmp_path):
    rows = spark.range(4_000).selectExpr("int(id % 20) as g", "int(id) as x")
    rows.repartition(1).write.partitionBy("g").parquet(f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    rollup = Rollup(by={"g": "g"}, sums={"total": "x"}, mins={"low": "x"}, maxs={"high": "x"})
    asset = rollup_table("t", source("lines", load=lambda s: lines), rollup)
    materialize(spark, str(tmp_path / "lake"), [asset])
    # Group 3 loses its smallest value, 4 one in the middle, 5 its smallest for a smaller one.
    gone = lines.filter("x in (3, 104, 5)").withColumn("_weight", F.lit(-1).cast("bigint"))
    new = spark.createDataFrame([(5, -7)], "g int, x int").withColumn("_weight", F.lit(1).cast("bigint"))
    after = lines.filter("x not in (3, 104, 5)").unionByName(new.drop("_weight"))
    done = materialize_delta(spark, str(tmp_path / "lake"), asset, gone.unionByName(new), after)
    assert (done.touched, done.recomputed, done.removed) == (3, 1, 0)
    assert rows_of(asset.read(spark, str(tmp_path / "lake")).select(*rollup.columns)) == rows_of(rollup.full(after))
    # The scan knows the group's value: other partitions' files are not opened.
    again = only_groups(lines, rollup.by, spark.createDataFrame([(3,)], "g int"))
    scan = next(line for line in again._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert re.search(r"PartitionFilters: \[.*\(g#\d+ = 3\)", scan), scan


def test_refusals(spark, tmp_path):
    lines = source("lines", load=lambda s: s.range(10).selectExpr("id % 2 as g", "double(id) as x"))
    with pytest.raises(TypeError, match="cast them to decimal"):
        Rollup(by={"g": "g"}, sums={"s": "x"}).full(lines.load(spark))
    with pytest.raises(ValueError, match="called s"):
        Rollup(by={"s": "g"}, sums={"s": "x"})
    asset = rollup_table("never", lines, Rollup(by={"g": "g"}))
    changes = lines.load(spark).withColumn("_weight", F.lit(-5).cast("bigint"))
    with pytest.raises(ValueError, match="not been materialized"):
        materialize_delta(spark, str(tmp_path), asset, changes)
    materialize(spark, str(tmp_path), [asset])
    with pytest.raises(Exception, match="does not hold"):
        materialize_delta(spark, str(tmp_path), asset, changes)
