"""Care of tables: compaction, constraints, file statistics, data layout."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.session import with_conf

_LAYOUT_BITS = 63


def order_number(column: Column, data_type: T.DataType) -> Column:
    """A number that never falls while ``column`` rises; ties are allowed. It only shapes layouts."""
    if isinstance(data_type, T.NumericType):
        return column.cast("double")
    if isinstance(data_type, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(data_type, T.TimestampType):
        return F.unix_micros(column).cast("double")
    if isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(column) * 3_600 + F.minute(column) * 60 + F.second(column)
        return F.unix_date(column.cast("date")).cast("double") * 86_400 + seconds
    raise TypeError(f"no layout along a column of type {data_type.simpleString()}")


def compact(spark: SparkSession, source: str, target: str, target_bytes: int = 256 << 20, fmt: str = "parquet") -> str:
    """Rewrite many small files as few; the content does not change.

    Nothing is shuffled: each task reads whole small files up to ``target_bytes`` and writes one, so a layout inside
    the files stays as it is.
    """
    packing = {
        "spark.sql.files.maxPartitionBytes": str(target_bytes), "spark.sql.files.openCostInBytes": "65536", "spark.sql.files.minPartitionNum": "1",
    }
    with with_conf(spark, packing):
        spark.read.format(fmt).load(source).write.format(fmt).mode("errorifexists").save(target)
    return target


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


def allowed(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values)


def between(column: str, low: object, high: object) -> Column:
    return F.col(column).between(low, high)


def constraint_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Per rule the rows that keep it and those that break it, all in one pass; unknown counts as broken."""
    holds = {name: F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    row = df.agg(*[F.count_if(ok).alias(f"ok_{i}") for i, ok in enumerate(holds.values())],
                 *[F.count_if(~ok).alias(f"bad_{i}") for i, ok in enumerate(holds.values())])
    results = [
        F.struct(F.lit(name).alias("rule"), F.col(f"ok_{i}").alias("ok"), F.col(f"bad_{i}").alias("bad"))
        for i, name in enumerate(holds)
    ]
    return row.select(F.inline(F.array(*results)))


def constraint_split(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the others with the names of the ``broken`` rules)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))
    checked = df.withColumn("broken", broken)
    return checked.filter(F.size("broken") == 0).drop("broken"), checked.filter(F.size("broken") > 0)


def column_stats(df: DataFrame, by: Column | str, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum, null count and row count per file or partition, one row per column."""
    aggregates = [F.count("*").alias("n")]
    for c in columns:
        aggregates += [F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"), F.count_if(F.col(c).isNull()).alias(f"{c}_nulls")]
    part = F.col(by) if isinstance(by, str) else by
    return df.groupBy(part.alias("part")).agg(*aggregates)


def file_stats(spark: SparkSession, path: str, columns: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """Statistics per data file, to see which files a filter could skip."""
    rows = spark.read.format(fmt).load(path).select("*", F.col("_metadata.file_path").alias("_file"))
    return column_stats(rows, "_file", columns).withColumnRenamed("part", "file")


def layout_sort(df: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Cluster rows along the columns: files then cover narrow ranges of them.

    A hash of the row is the last range key, so that rows which share one very common
    value of the columns are spread over several partitions.
    """
    hashable = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    keys = [*columns, F.xxhash64(*hashable)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*columns)


def _bucket(number: Column, cuts: Column, widths: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``number``, by halving."""
    return F.aggregate(
        widths, F.lit(0), lambda at, w: at + F.when(number >= F.get(cuts, at + w - 1), w).otherwise(0)
    )


def layout_zorder(df: DataFrame, columns: Sequence[str], partitions: int | None = None, bits: int = 8) -> DataFrame:
    """Cluster rows on several columns at once.

    Each value turns into the rank of its quantile bucket; the bits of the ranks are
    interleaved and the rows clustered by the result. Quantiles keep the buckets
    even where values are skewed. The bounds are 2**bits numbers per column.
    """
    if bits * len(columns) > _LAYOUT_BITS:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit {_LAYOUT_BITS}; lower bits")
    buckets = 2**bits
    fractions = ", ".join(f"{i / buckets}D" for i in range(1, buckets))
    numbers = {c: order_number(F.col(c), df.schema[c].dataType) for c in columns}
    named = df.select(*[n.alias(f"n{i}") for i, n in enumerate(numbers.values())])
    row = named.agg(*[
        F.expr(f"percentile_approx(n{i}, array({fractions}), 10000)") for i in range(len(columns))
    ]).first()  # one row of bounds, whatever the size of the table
    widths = F.lit([2**i for i in reversed(range(bits))])
    ranks = []
    for i, number in enumerate(numbers.values()):
        cuts = F.lit(list(row[i])) if row[i] else F.lit(None).cast(T.ArrayType(T.DoubleType()))
        ranks.append(_bucket(number, cuts, widths))
    ranked = df.withColumns({f"_rank{i}": rank for i, rank in enumerate(ranks)})
    z = F.lit(0).cast("bigint")
    for bit in range(bits):
        for i in range(len(columns)):
            one = F.shiftright(F.col(f"_rank{i}"), bit).bitwiseAND(F.lit(1)).cast("bigint")
            z = z.bitwiseOR(F.shiftleft(one, bit * len(columns) + i))
    keyed = ranked.withColumn("_z", z).drop(*[f"_rank{i}" for i in range(len(columns))])
    return layout_sort(keyed, ["_z"], partitions).drop("_z")


def bloom_filter_options(columns: Sequence[str], distinct_values: int | None = None) -> dict[str, str]:
    """Parquet write options that put a bloom filter on each column."""
    options = {}
    for c in columns:
        options[f"parquet.bloom.filter.enabled#{c}"] = "true"
        if distinct_values is not None:
            options[f"parquet.bloom.filter.expected.ndv#{c}"] = str(distinct_values)
    return options
