"""Object events as streams, and their delivery to subscribers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assetlake.functions.paths import join_path
from assetlake.sources.buckets import LOG_SCHEMA, Bucket, Subscription
from assetlake.sources.files import file_key


def file_events(spark: SparkSession, bucket: Bucket, prefix: str | None = None) -> DataFrame:
    """A ``create`` event per new file below a prefix. File bodies are not read.

    A file stream reports a path once. Where paths are overwritten, use the put log
    (``put_events``) or compare inventories (``operators.objects.changes``).
    """
    files = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .load(join_path(bucket.root, prefix))
    )
    stamp = F.md5(F.concat_ws("-", "key", "size", F.unix_micros("modificationTime")).cast("binary"))
    named = files.select(file_key(F.col("path"), bucket.root).alias("key"), F.col("length").alias("size"), "modificationTime")
    return named.select(F.lit("create").alias("scope"), "key", stamp.alias("etag"), "size")


def put_events(spark: SparkSession, bucket: Bucket) -> DataFrame:
    """An event per put or delete, overwrites included; a delete has no size."""
    log = spark.readStream.schema(LOG_SCHEMA).parquet(bucket.log_path)
    scope = F.when(F.col("deleted"), "delete").otherwise("create")
    return log.select(scope.alias("scope"), "key", "etag", "size")


def deliver(events: DataFrame, subscriptions: Sequence[Subscription], batch_id: int = 0) -> None:
    """Hand each subscriber, in the order they subscribed, the events it asked for."""
    events = events.persist()
    try:
        for s in subscriptions:
            s.handler(events.filter(F.col("scope").isin(*s.scopes) & F.col("key").startswith(s.prefix)), batch_id)
    finally:
        events.unpersist()


def run_subscriptions(events: DataFrame, bucket: Bucket, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Deliver a stream of events; a batch counts as done when every subscriber has returned."""
    return (
        events.writeStream.foreachBatch(lambda batch, batch_id: deliver(batch, bucket.subscriptions, batch_id))
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
