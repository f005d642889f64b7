"""Lakehouse data work on Spark: objects, records, assets, streams, versions."""

from assetlake.functions import Duration, duration
from assetlake.plans import DB, Asset, backfill, every, job, jsonl_etl, materialize, source
from assetlake.schema import partition_key
from assetlake.session import session
from assetlake.sources import Bucket, Folder, TableFormat
from assetlake.streaming import Queue

__all__ = [
    "DB", "Asset", "Bucket", "Duration", "Folder", "Queue", "TableFormat", "backfill", "duration", "every",
    "job", "jsonl_etl", "materialize", "partition_key", "session", "source",
]
