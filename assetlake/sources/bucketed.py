"""Tables stored for a join: rows are dealt and sorted by the key once, when they are written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.operators.ordered import range_count


def bucket_count(*frames: DataFrame) -> int:
    """One number of buckets for all tables that will meet, by the largest."""
    return max(range_count(df) for df in frames)


def write_bucketed(df: DataFrame, path: str, key: str | Sequence[str], buckets: int, name: str | None = None) -> DataFrame:
    """Write ``df`` in ``buckets`` of its key, sorted inside each file, and read it as a table that Spark knows to be so.

    Every bucket is written by one task. A key that holds a large share of the rows fills one bucket: such tables are better joined by
    a shuffle, which AQE can split. The table is external; its name lasts as long as the session's catalog.
    """
    keys = [key] if isinstance(key, str) else list(key)
    name = name or f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *[F.col(k) for k in keys])  # the hash that buckets use: one file each
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def forget(spark: SparkSession, name: str) -> None:
    """Take a table out of the catalog; its files stay."""
    spark.sql(f"drop table if exists `{name}`")
