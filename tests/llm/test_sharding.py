from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from common import documents, odd_rows

from assetlake.llm.sharding import Shard, place, shard_documents, topology
from pyspark.sql import functions as F


def test_columns_and_odd_rows(spark):
    rows = odd_rows() + [(i, f"text {i}") for i in range(100, 400)]
    got = shard_documents(documents(spark, rows), topology(40), topology(41)).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1
    assert shard_documents(documents(spark, []), topology(40), topology(41)).count() == 0


def shards_of(spark, *trees) -> list[tuple]:
    keys = spark.range(40_000)
    return [tuple(r) for r in keys.select(*[place(F.col("id"), t).alias(f"s{i}") for i, t in enumerate(trees)]).collect()]


def test_shares_follow_the_weights(spark):
    heavy = [Shard(s.number, s.rack, s.region, 3.0 if s.number == 5 else 1.0) for s in topology(40)]
    even, uneven = zip(*shards_of(spark, topology(40), heavy))
    counts = Counter(even)
    assert len(counts) == 40 and all(800 < n < 1200 for n in counts.values())
    assert 2500 < Counter(uneven)[5] < 3250
    # Keys move only into region 0, its rack 1 and shard 5, whose weights have changed.
    assert all(b // 8 == 0 and (a // 8 != 0 or b // 4 == 1) and (a // 4 != 1 or b == 5) for a, b in zip(even, uneven) if a != b)


@pytest.mark.parametrize("count", [40, 41, 47])
def test_one_more_shard_takes_keys_only_into_itself(spark, count):
    moved = [(a, b) for a, b in shards_of(spark, topology(count), topology(count + 1)) if a != b]
    assert {b for _, b in moved} == {count} and len({a for a, _ in moved}) == count
    assert 0.7 < len(moved) * (count + 1) / 40_000 < 1.3


def test_fewer_shards_than_planned_are_refused():
    with pytest.raises(ValueError, match="laid out"):
        topology(39)
