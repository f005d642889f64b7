from __future__ import annotations

import os

from oracle import rows_of
from pyspark.sql import functions as F

from assetlake.operators import care


def parquet_files(path):
    return [f for f in os.listdir(path) if f.endswith(".parquet")]


def test_compact(spark, tmp_path):
    source, target = str(tmp_path / "many"), str(tmp_path / "few")
    spark.range(1000).repartition(40).write.parquet(source)
    care.compact(spark, source, target)
    assert len(parquet_files(source)) == 40 and len(parquet_files(target)) < 5
    assert rows_of(spark.read.parquet(source)) == rows_of(spark.read.parquet(target))


def grid(spark):
    shuffled = spark.range(64 * 64).orderBy(F.xxhash64("id"))
    return shuffled.select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"), F.col("id").cast("string").alias("s"))


def share_of_files(spark, path, column):
    """Share of the files that a filter on one value must open."""
    stats = care.file_stats(spark, path, [column])
    hits = stats.select(F.expr(f"avg(if(20 between {column}_lo and {column}_hi, 1, 0))")).first()[0]
    return hits


def test_layouts_narrow_the_files(spark, tmp_path):
    plain, ordered, z = (str(tmp_path / n) for n in ("plain", "sorted", "z"))
    grid(spark).repartition(16).write.parquet(plain)
    care.layout_sort(grid(spark), ["x"], 16).write.parquet(ordered)
    care.layout_zorder(grid(spark), ["x", "y"], 16).write.parquet(z)
    assert rows_of(spark.read.parquet(z)) == rows_of(grid(spark)) == rows_of(spark.read.parquet(ordered))
    assert share_of_files(spark, plain, "x") == 1.0
    assert share_of_files(spark, ordered, "x") < 0.2 and share_of_files(spark, ordered, "y") == 1.0
    assert share_of_files(spark, z, "x") < 0.6 and share_of_files(spark, z, "y") < 0.6


def test_a_common_value_is_spread_over_partitions(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("v"), "id")
    sizes = care.layout_sort(rows, ["v"], 8).groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
    assert sizes < 8_000


def test_constraints_count_unknown_as_broken(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "n int, s string")
    rules = {"n": care.between("n", 0, 2), "s": care.allowed("s", ["a", "b"])}
    assert {tuple(r) for r in care.constraint_counts(df, rules).collect()} == {("n", 1, 2), ("s", 2, 1)}
    good, bad = care.constraint_split(df, rules)
    assert good.count() == 1 and {tuple(r["broken"]) for r in bad.collect()} == {("n",), ("n", "s")}


def test_file_stats(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, None), (5, "b")], "n int, s string").coalesce(1).write.parquet(path)
    row = care.file_stats(spark, path, ["n", "s"]).first()
    assert (row["n"], row["n_lo"], row["n_hi"], row["s_nulls"]) == (2, 1, 5, 1)


def test_bloom_filter_is_written(spark, tmp_path):
    path = str(tmp_path / "b")
    options = care.bloom_filter_options(["s"], 1000)
    spark.range(1000).select(F.col("id").cast("string").alias("s")).coalesce(1).write.options(**options).parquet(path)
    plain = str(tmp_path / "p")
    spark.range(1000).select(F.col("id").cast("string").alias("s")).coalesce(1).write.parquet(plain)
    size = {d: sum(os.path.getsize(f"{d}/{f}") for f in parquet_files(d)) for d in (path, plain)}
    assert size[path] > size[plain]
    assert spark.read.parquet(path).filter("s = '77'").count() == 1
