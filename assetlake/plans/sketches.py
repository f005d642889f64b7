"""Statistics of runs that can be merged: quantiles and overlaps of partitions without reading them again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.paths import join_path

SKETCHES = "_sketches"
_SCHEMA = "run_id string, asset string, part string, column string, n bigint, nulls bigint, low bigint, high bigint, quantiles binary, keys binary"
#: Size of the quantile sketches: in 99 of 100 cases ranks are off by less than 0.3 % of the rows.
KLL_K = 1_000
#: Key sketches keep 2 ** this many hashes: the standard error of a count is 0.8 %.
THETA_BITS = 14
#: What is promised: ranks within 1 % of the rows, counts within 5 %.
RANK_ERROR, COUNT_ERROR = 0.01, 0.05


def partition_sketches(df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """Per partition and column (of whole numbers): counts, bounds, a quantile sketch and a distinct-key sketch, in one pass.

    Each task keeps one sketch per partition and column, so a large partition is spread; sketches are some kilobytes.
    """
    measures = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("bigint")
        measures += [
            F.count(F.lit(1)).alias(f"n{i}"), F.count_if(value.isNull()).alias(f"nulls{i}"), F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"),
            F.kll_sketch_agg_bigint(value, F.lit(KLL_K)).alias(f"quantiles{i}"), F.theta_sketch_agg(value, THETA_BITS).alias(f"keys{i}"),
        ]
    rows = df.groupBy(F.col(part).cast("string").alias("part")).agg(*measures)
    fields = ("n", "nulls", "low", "high", "quantiles", "keys")
    structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{f}{i}").alias(f) for f in fields]) for i, c in enumerate(columns)]
    return rows.select("part", F.inline(F.array(*structs)))


def log_sketches(spark: SparkSession, root: str, run_id: str, asset: str, sketches: DataFrame) -> None:
    """Append the sketches of a run next to the run log."""
    rows = sketches.select(F.lit(run_id).alias("run_id"), F.lit(asset).alias("asset"), "part", "column", "n", "nulls", "low", "high", "quantiles", "keys")
    rows.write.mode("append").partitionBy("asset").parquet(join_path(root, SKETCHES))


def read_sketches(spark: SparkSession, root: str, asset: str, parts: Sequence[str] | None = None) -> DataFrame:
    """The newest logged sketches of an asset's partitions are those of the last run that wrote them; runs ascend by id."""
    rows = spark.read.schema(_SCHEMA).parquet(join_path(root, SKETCHES)).filter(F.col("asset") == asset)
    if parts is not None:
        rows = rows.filter(F.col("part").isin(list(parts)))
    values = ["n", "nulls", "low", "high", "quantiles", "keys"]
    newest = rows.groupBy("part", "column").agg(F.max_by(F.struct(*values), "run_id").alias("_newest"))
    return newest.select("part", "column", "_newest.*")


def merged(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """Sketches of many partitions as one for each group."""
    return sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_bigint("quantiles", KLL_K).alias("quantiles"), F.theta_union_agg("keys", THETA_BITS).alias("keys"),
    )


def quantiles(sketches: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """Values at the fractions, as ``fraction`` and ``value`` rows; no value where a column has only nulls."""
    known = sketches.filter(F.col("n") > F.col("nulls"))
    at = [F.struct(F.lit(float(f)).alias("fraction"), F.kll_sketch_get_quantile_bigint("quantiles", F.lit(float(f))).alias("value")) for f in fractions]
    return known.select(*[c for c in ("part", "column") if c in sketches.columns], F.inline(F.array(*at)))


def overlap(one: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct keys of two merged groups, of both together and in common, by column."""
    a, b = one.select("column", F.col("keys").alias("a")), other.select("column", F.col("keys").alias("b"))
    count = F.theta_sketch_estimate
    both = a.join(b, "column")
    return both.select(
        "column", count("a").alias("left_keys"), count("b").alias("right_keys"), count(F.theta_union("a", "b", THETA_BITS)).alias("all_keys"),
        count(F.theta_intersection("a", "b")).alias("common_keys"),
    )
