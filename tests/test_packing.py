from __future__ import annotations

import hashlib
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assetlake.operators import packing
from assetlake.operators.packing import compact_small, finish_compaction, packing_plan


def digests(path: str) -> dict[str, str]:
    files = [p for p in Path(path).rglob("*.parquet") if not any(part.startswith("_") for part in p.relative_to(path).parts)]
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() for p in files}


def rows_of(df) -> list:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def lake(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(6_000).selectExpr("id", "concat('v', id % 7) as v", "array('a b', 'c', null)[int(id % 3)] as part")
    rows.filter("id < 5000").repartition(1).write.partitionBy("part").parquet(path)  # one large file a folder
    for i in range(5):
        rows.filter(f"id >= 5000 and id % 5 = {i}").repartition(2, "id").write.mode("append").partitionBy("part").parquet(path)
    return path


def test_small_files_are_packed_and_large_ones_stay(spark, lake):
    before, rows = digests(lake), rows_of(spark.read.parquet(lake))
    small = min(os.path.getsize(f) for f in before) * 3
    plan = compact_small(spark, lake, ("part",), target_bytes=1 << 20, small_bytes=small)
    after = digests(lake)
    large = {f: d for f, d in before.items() if os.path.getsize(f) >= small} if all(map(os.path.exists, before)) else {f: d for f, d in before.items() if os.path.exists(f)}
    assert len(large) == 3 and all(after[f] == d for f, d in large.items())
    assert len(after) == 6 and plan.count() == len(before) - 3
    assert rows_of(spark.read.parquet(lake)) == rows
    assert not os.path.exists(f"{lake}/_compaction")
    assert packing_plan(spark, lake, 1 << 20, small).count() == 0


def test_an_interrupted_run_is_finished(spark, lake, monkeypatch):
    rows = rows_of(spark.read.parquet(lake))
    calls = []

    def stop_the_second_time(*args):
        calls.append(args)
        if len(calls) == 2:
            raise KeyboardInterrupt

    monkeypatch.setattr(packing, "finish_compaction", stop_the_second_time)
    with pytest.raises(KeyboardInterrupt):
        compact_small(spark, lake, ("part",), target_bytes=1 << 20, small_bytes=1 << 19)
    assert os.path.exists(f"{lake}/_compaction") and rows_of(spark.read.parquet(lake)) == rows
    finish_compaction(spark, lake)
    assert rows_of(spark.read.parquet(lake)) == rows and len(digests(lake)) == 3


def test_bins_in_batches(spark, lake, monkeypatch):
    rows = rows_of(spark.read.parquet(lake))
    monkeypatch.setattr(packing, "_AT_ONCE", 4)
    size = max(os.path.getsize(f) for f in digests(lake))
    plan = compact_small(spark, lake, ("part",), target_bytes=3 * min(os.path.getsize(f) for f in digests(lake)), small_bytes=size)
    assert plan.groupBy("folder", "bin").count().filter("count < 2").count() == 0
    assert rows_of(spark.read.parquet(lake)) == rows
    assert spark.read.parquet(lake).filter(F.col("part").isNull()).count() == 2_000
