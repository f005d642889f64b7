"""Ranges must give what a plain window gives, also with a third of the rows in one group."""

from __future__ import annotations

import pytest
from oracle import rows_of
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from assetlake.operators import ordered
from assetlake.tables import table

MANY, ONE = 40, 1


@pytest.fixture(scope="module")
def skewed(spark, sf_dir):
    """A third of the rows belongs to key 0, a key is null, and some rows share their time."""
    events = table(spark, sf_dir, "events")
    key = F.when(F.col("user_id") < 5, 0).when(F.col("user_id") == 9, None).otherwise(F.col("user_id"))
    ts = F.when(F.col("event_id") % 10 == 0, F.date_trunc("day", "ts").cast("timestamp_ntz")).otherwise(F.col("ts"))
    return events.select(key.alias("k"), ts.alias("ts"), "event_id", "value").persist()


def test_number_rows(skewed):
    plain = skewed.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("ts", "event_id")).cast("bigint"))
    sliced = ordered.number_rows(skewed, ["k"], ["ts", "event_id"], parts=MANY)
    assert rows_of(sliced) == rows_of(plain)


def test_frames(skewed):
    def columns(group, order):
        w = Window.partitionBy(*group).orderBy(*order)
        return {"prev": F.lag("event_id", 2).over(w), "mov": F.sum("event_id").over(w.rowsBetween(-2, 0))}

    args = (skewed, ["k"], ["ts", "event_id"], 2, columns)
    want = rows_of(skewed.withColumns(columns(["k"], ["ts", "event_id"])))
    assert rows_of(ordered.with_frames(*args, parts=MANY)) == rows_of(ordered.with_frames(*args)) == want


@pytest.mark.parametrize("preceding", [0, 7, 60])
def test_frames_that_look_back_over_many_ranges(skewed, preceding):
    def columns(group, order):
        w = Window.partitionBy(*group).orderBy(*order).rowsBetween(-preceding, 0)
        return {"n": F.count("*").over(w), "low": F.min("event_id").over(w)}

    want = rows_of(skewed.withColumns(columns(["k"], ["ts", "event_id"])))
    assert rows_of(ordered.with_frames(skewed, ["k"], ["ts", "event_id"], preceding, columns, parts=150)) == want


def test_ranks_with_ties(skewed):
    days = skewed.withColumn("day", F.to_date("ts"))
    args = (days, ["k"], "day", ["event_id"])
    assert rows_of(ordered.rank_rows(*args, parts=MANY)) == rows_of(ordered.rank_rows(*args))


@pytest.mark.parametrize("gap", ["1 minute", "90 minutes", "3 days"])
def test_sessions_equal_the_built_in_window(skewed, gap):
    keyed = skewed.filter("k is not null")
    plain = ordered.sessions(keyed, ["k"], "ts", gap)
    sliced = ordered.sessions(keyed, ["k"], "ts", gap, parts=MANY)
    built_in = keyed.groupBy("k", F.session_window("ts", gap).alias("w")).agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")
    )
    columns = ["k", "start", "end", "n"]
    assert rows_of(plain) == rows_of(sliced)
    assert rows_of(plain.select(*columns)) == rows_of(built_in.select(*columns))


def test_as_of_join_against_all_pairs(spark, skewed):
    left = skewed.select("k", F.col("event_id").alias("id"), (F.col("ts") + F.expr("interval 1 hour")).alias("at"))
    right = skewed.filter("event_id % 3 = 0").select("k", "ts", F.col("event_id").alias("seen"), "value")
    args = (left, right, ["k"], "at", "ts", ["seen"], ["seen", "value"])
    best = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("seen"))
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("ts") <= F.col("at")), "left")
    want = pairs.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select("l.k", "id", "at", "seen", "value")
    want = rows_of(want)
    assert rows_of(ordered.as_of_join(*args)) == want
    assert rows_of(ordered.as_of_join(*args, parts=MANY)) == want


def test_text_order_and_a_hot_value(skewed):
    text = skewed.withColumn("t", F.when(F.col("event_id") % 2 == 0, "same").otherwise(F.col("event_id").cast("string")))
    plain = text.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("t", "event_id")).cast("bigint"))
    assert rows_of(ordered.number_rows(text, ["k"], ["t", "event_id"], parts=MANY)) == rows_of(plain)
    ranked = text.withColumn("rk", F.rank().over(Window.partitionBy("k").orderBy("t")).cast("bigint"))
    assert rows_of(ordered.rank_rows(text, ["k"], "t", ["event_id"], parts=MANY)) == rows_of(ranked)


def test_one_second_for_all_rows_is_spread(skewed):
    same = skewed.select(F.lit(1).alias("k"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"), "event_id")
    dealt = ordered._dealt(same, ["k"], ["ts", "event_id"], MANY)
    largest = dealt.groupBy("_part").count().agg(F.max("count")).first()[0]
    assert largest < same.count() / 4
    assert {r["rk"] for r in ordered.rank_rows(same, ["k"], "ts", ["event_id"], parts=MANY).collect()} == {1}


def test_frames_longer_than_a_range(skewed):
    def columns(group, order):
        w = Window.partitionBy(*group).orderBy(*order)
        return {"far": F.lag("event_id", 300).over(w), "mov": F.sum("event_id").over(w.rowsBetween(-300, 0))}

    args = (skewed, ["k"], ["ts", "event_id"], 300, columns)
    assert rows_of(ordered.with_frames(*args, parts=MANY)) == rows_of(skewed.withColumns(columns(["k"], ["ts", "event_id"])))


def test_as_of_join_carries_maps(skewed):
    left = skewed.select("k", F.col("event_id").alias("id"), "ts")
    right = skewed.filter("event_id % 50 = 0").select("k", F.col("ts").alias("at"), "event_id", F.create_map(F.lit("v"), "event_id").alias("m"))
    args = (left, right, ["k"], "ts", "at", ["event_id"], ["m"])
    values = lambda df: rows_of(df.select("id", F.map_values("m").alias("m")))
    assert values(ordered.as_of_join(*args, parts=MANY)) == values(ordered.as_of_join(*args, parts=ONE))


def test_empty_table(spark, skewed):
    none = skewed.limit(0)
    assert ordered.number_rows(none, ["k"], ["ts"]).count() == 0
    assert ordered.sessions(none, ["k"], "ts", "1 hour").count() == 0
