"""Keyed tables in ranges of their key, with a tree of digests: two states are compared without reading both.

A table is written in folders of key ranges. Its bounds are taken once, from samples, and stored with it; later states
take them over, so the same key is always in the same range. For each range the rows are counted and their hashes added
up, which no order of rows changes; ``FANOUT`` neighbours add up to a node of the next level. Comparing two states starts
at the top and goes down only below nodes that differ. Of the rows themselves only the ranges that differ are read.

Two sums of independent 64-bit hashes stand for a range: two different ranges look alike with a chance of about 2 ** -128.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.functions.paths import join_path
from assetlake.operators.ordered import range_count
from assetlake.operators.versions import table_diff
from assetlake.sources.formats import write_table

FANOUT = 16
_RANGE = "_range"
_TREE = "level int, node bigint, n bigint, a decimal(38,0), b decimal(38,0)"


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sampled_bounds(df: DataFrame, key: str | Sequence[str], ranges: int) -> DataFrame:
    """The smallest key of each of ``ranges`` ranges, numbered from 1; about one row a range."""
    keys = _keys(key)
    dealt = df.select(*keys).repartitionByRange(ranges, *keys).withColumn("_part", F.spark_partition_id())
    lows = dealt.groupBy("_part").agg(F.min(F.struct(*keys)).alias("low")).select("low").collect()  # one key a range
    lows = sorted((r["low"] for r in lows), key=lambda k: [(v is not None, v) if v is not None else (False,) for v in k])
    schema = f"range int, low struct<{','.join(f'`{k}`:{df.schema[k].dataType.simpleString()}' for k in keys)}>"
    return df.sparkSession.createDataFrame([(i + 1, low) for i, low in enumerate(lows)], schema)


def range_of(key: Column, bounds: list, kind: str) -> Column:
    """Number of the last bound at or below ``key``, by binary search; 0 for a key below all."""
    if not bounds:
        return F.lit(0)
    values = F.array(*[F.lit(b).cast(kind) if not isinstance(b, tuple) else _struct_literal(b, kind) for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(values, at + step - 1) <= key, F.lit(False)), at + step).otherwise(at),
    )


def _struct_literal(value: tuple, kind: str) -> Column:
    return F.struct(*[F.lit(v) for v in value]).cast(kind)


def _tree(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Digests of all levels; level 0 has the ranges."""
    # A null leaves a hash as it is, so the places of the nulls are hashed, too.
    parts = [*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns]]
    sums = [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).cast("decimal(38,0)").alias(n) for seed, n in ((1, "a"), (2, "b"))]
    leaves = rows.groupBy(F.col(_RANGE).cast("bigint").alias("node")).agg(F.count("*").alias("n"), *sums)
    return leaves.select(F.lit(0).alias("level"), "node", "n", "a", "b")


def _levels(leaves: DataFrame, ranges: int) -> DataFrame:
    levels, width, count = [leaves], 1, ranges + 1
    while count > 1:
        width, count = width * FANOUT, -(-count // FANOUT)
        up = leaves.groupBy(F.expr(f"node div {width}").alias("node")).agg(*[F.sum(c).alias(c) for c in ("n", "a", "b")])
        levels.append(up.select(F.lit(len(levels)).alias("level"), "node", "n", F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)")))
    return reduce(DataFrame.unionByName, levels)


def write_ranged(df: DataFrame, path: str, key: str | Sequence[str], like: str | None = None, ranges: int | None = None) -> str:
    """Write ``df`` by key ranges with its digests; ``like`` is an earlier state whose bounds are taken over."""
    spark, keys = df.sparkSession, _keys(key)
    if like is not None:
        bounds = spark.read.parquet(join_path(like, "bounds"))
    else:
        bounds = sampled_bounds(df, keys, ranges or range_count(df))
    bounds.coalesce(1).write.parquet(join_path(path, "bounds"))
    lows = [r["low"] for r in spark.read.parquet(join_path(path, "bounds")).orderBy("range").collect()]  # one key a range
    kind = bounds.schema["low"].dataType.simpleString()
    # By position, as a struct literal has names of its own.
    placed = df.withColumn(_RANGE, range_of(F.struct(*keys), [tuple(low) for low in lows], kind))
    spark.range(1).select(F.lit(df.schema.json()).alias("schema")).coalesce(1).write.parquet(join_path(path, "schema"))
    write_table(placed, join_path(path, "data"), partition_by=[_RANGE])
    rows = spark.read.schema(placed.schema).parquet(join_path(path, "data"))
    leaves = _tree(rows, df.columns)
    leaves.coalesce(1).write.parquet(join_path(path, "leaves"))
    stored = spark.read.schema(leaves.schema).parquet(join_path(path, "leaves"))
    _levels(stored, len(lows)).coalesce(1).write.parquet(join_path(path, "tree"))
    return path


def read_ranged(spark: SparkSession, path: str, ranges: Sequence[int] | None = None) -> DataFrame:
    """The rows of a table; of some ranges only, if they are named."""
    declared = T.StructType.fromJson(json.loads(spark.read.parquet(join_path(path, "schema")).first()["schema"]))
    rows = spark.read.schema(T.StructType([*declared, T.StructField(_RANGE, T.IntegerType())])).parquet(join_path(path, "data"))
    if ranges is not None:
        rows = rows.filter(F.col(_RANGE).isin(list(ranges))) if ranges else rows.limit(0)
    return rows.drop(_RANGE)


def differing_ranges(spark: SparkSession, before: str, after: str) -> list[int]:
    """Numbers of the ranges whose digests differ, found from the top of both trees downwards."""
    bounds = [spark.read.parquet(join_path(p, "bounds")) for p in (before, after)]
    if bounds[0].exceptAll(bounds[1]).unionAll(bounds[1].exceptAll(bounds[0])).limit(1).count():
        raise ValueError("the two states have different bounds; write the later one like the earlier one")
    old, new = [spark.read.schema(_TREE).parquet(join_path(p, "tree")) for p in (before, after)]
    nodes: list[int] | None = None
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (old, new)]
    for level in reversed(range(max(tops) + 1)):
        sides = []
        for tree, names in ((old, ("n1", "a1", "b1")), (new, ("n2", "a2", "b2"))):
            rows = tree.filter(F.col("level") == level).select("node", F.col("n").alias(names[0]), F.col("a").alias(names[1]), F.col("b").alias(names[2]))
            if nodes is not None:
                rows = rows.filter(F.expr(f"node div {FANOUT}").isin(nodes)) if nodes else rows.limit(0)
            sides.append(rows)
        both = sides[0].join(sides[1], "node", "full_outer")
        differ = both.filter(~(F.struct("n1", "a1", "b1").eqNullSafe(F.struct(F.col("n2").alias("n1"), F.col("a2").alias("a1"), F.col("b2").alias("b1")))))
        nodes = sorted(r["node"] for r in differ.select("node").collect())  # at most one number a range
    return nodes or []


def ranged_diff(spark: SparkSession, before: str, after: str, key: str | Sequence[str], compare: str = "values") -> DataFrame:
    """``table_diff`` of two ranged tables; only ranges that differ are read."""
    ranges = differing_ranges(spark, before, after)
    return table_diff(read_ranged(spark, before, ranges), read_ranged(spark, after, ranges), key, compare)
