from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.operators.frames import group_quantiles, range_totals, with_range_frames


def frames(group):
    w = Window.partitionBy(*group).orderBy("x").rangeBetween(-5, 0)
    return {"total": F.sum("v").over(w), "least": F.min("v").over(w), "n": F.count("*").over(w)}


@pytest.mark.parametrize("parts", [1, 6, 40])
def test_range_frames_equal_windows(spark, parts):
    pick = random.Random(parts)
    rows = [(pick.choice(["hot", "hot", "hot", "b", None]), pick.choice([None, 7, *range(60)]), pick.randrange(100), i) for i in range(600)]
    rows += [("hot", 30, 1, 600 + i) for i in range(200)]  # one value over several ranges
    df = spark.createDataFrame(rows, "g string, x int, v int, i int")
    got = with_range_frames(df, ["g"], "x", 5, frames, ["i"], parts)
    assert got.columns == [*df.columns, "total", "least", "n"]
    want = df.withColumns(frames(["g"])).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect() if r["x"] is not None), key=key) == sorted((tuple(r) for r in want if r["x"] is not None), key=key)
    unplaced = got.filter("x is null").collect()
    assert len(unplaced) == sum(r[1] is None for r in rows) and all(r["total"] is None and r["n"] is None for r in unplaced)


@pytest.mark.parametrize("parts, width", [(1, 5), (6, 5), (40, 5), (40, 1), (6, 0), (6, 1_000)])
def test_range_totals_equal_windows(spark, parts, width):
    pick = random.Random(parts)
    rows = [(pick.choice(["hot", "hot", "hot", "b", None]), pick.choice([None, -7, *range(-30, 30)]), pick.choice([None, *range(100)]), i) for i in range(600)]
    rows += [("hot", 10, 1, 600 + i) for i in range(200)] + [("nulls", 1, None, 900)]
    df = spark.createDataFrame(rows, "g string, x int, v int, i int")
    cents = F.col("v").cast("decimal(18,2)")
    totals = {"n": ("count", F.lit(1)), "filled": ("count", F.col("v")), "least": ("min", F.col("v")), "most": ("max", F.col("v")), "v_sum": ("sum", cents)}
    got = range_totals(df, ["g"], "x", width, totals, parts)
    assert got.columns == [*df.columns, *totals]
    w = Window.partitionBy("g").orderBy("x").rangeBetween(-width, 0)
    want = {"n": F.count("*"), "filled": F.count("v"), "least": F.min("v"), "most": F.max("v"), "v_sum": F.sum(cents)}
    want = df.filter("x is not null").withColumns({name: c.over(w) for name, c in want.items()})
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.filter("x is not null").collect()), key=key) == sorted((tuple(r) for r in want.collect()), key=key)
    unplaced = got.filter("x is null").collect()
    assert len(unplaced) == sum(r[1] is None for r in rows) and all(r["n"] is None and r["v_sum"] is None for r in unplaced)


def test_range_totals_do_not_read_frames_anew(spark, sf_dir):
    """Running totals only: no frame of the plan slides."""
    from assetlake.queries import relational

    with pytest.raises(TypeError, match="whole numbers"):
        range_totals(spark.range(3).select(F.col("id").cast("double").alias("x")), [], "x", 1, {"n": ("count", F.lit(1))})
    plan = relational.large_group_range_frames(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RowFrame, unboundedpreceding" in plan and "RangeFrame" not in plan


@pytest.mark.parametrize("kind", ["bigint", "int", "date", "timestamp_ntz"])
def test_quantiles_by_sorting(spark, kind):
    pick = random.Random(1)
    make = {
        "bigint": lambda: pick.choice([-(1 << 63), (1 << 63) - 1, 0, 5, 5, 5, pick.randrange(-(1 << 62), 1 << 62)]), "int": lambda: pick.randrange(-50, 50),
        "date": lambda: dt.date(1960, 1, 1) + dt.timedelta(pick.randrange(40_000)),
        "timestamp_ntz": lambda: dt.datetime(1999, 1, 1) + dt.timedelta(microseconds=pick.randrange(1 << 50)),
    }[kind]
    rows = [(pick.choice(["hot", "hot", "hot", None, "x"]), pick.choice([None, make(), make(), make()])) for _ in range(700)] + [("nulls", None), ("one", make())]
    fractions = [0.0, 0.1, 0.5, 0.999, 1.0]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    got = {(r["g"], r["fraction"]): r["v"] for r in group_quantiles(df, ["g"], "v", fractions).collect()}
    want = {}
    for g in {r[0] for r in rows} - {"nulls"}:
        values = sorted(v for k, v in rows if k == g and v is not None)
        want |= {(g, f): values[max(1, math.ceil(round(f * len(values), 9))) - 1] for f in fractions}
    assert got == want


def test_quantiles_refuse_what_they_cannot_do_exactly(spark):
    with pytest.raises(TypeError, match="scale decimals"):
        group_quantiles(spark.createDataFrame([("a", "b")], "g string, v string"), ["g"], "v", [0.5])
    assert group_quantiles(spark.createDataFrame([], "g string, v int"), ["g"], "v", [0.5]).count() == 0
