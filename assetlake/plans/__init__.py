from assetlake.plans.assets import DB, Asset, TableAsset, backfill, materialize, source
from assetlake.plans.jobs import every, job, jsonl_etl

__all__ = ["DB", "Asset", "TableAsset", "backfill", "every", "job", "jsonl_etl", "materialize", "source"]
