"""A record of every run: rows, schema, parameters."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN_LOG_SCHEMA = (
    "run_id string, asset string, branch string, path string, rows bigint, schema_hash string, "
    "slots array<string>, finished_at timestamp"
)


def schema_hash(df: DataFrame) -> str:
    return hashlib.sha256(df.schema.json().encode("utf-8")).hexdigest()


def observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows while they are written; no second pass is needed."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics), seen


def append_run(spark: SparkSession, log_path: str, run_id: str, asset: str, branch: str, path: str, rows: int,
               digest: str, slots: list[str] | None) -> None:
    entry = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(asset).alias("asset"), F.lit(branch).alias("branch"),
        F.lit(path).alias("path"), F.lit(rows).cast("bigint").alias("rows"), F.lit(digest).alias("schema_hash"),
        (F.lit(slots) if slots else F.lit(None).cast("array<string>")).alias("slots"),
        F.current_timestamp().alias("finished_at"),
    )
    entry.coalesce(1).write.mode("append").parquet(log_path)


def read_runs(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG_SCHEMA).parquet(log_path)
