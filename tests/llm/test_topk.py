from __future__ import annotations

import math
import random

from assetlake.llm import topk
from assetlake.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, q string, part int, id int"


def brute_force(rows: list[tuple], k: int) -> list[tuple]:
    usable = [
        (i, [math.floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for i, q in usable:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in usable if j != i)
            out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)}
    return sorted(out)


def run(spark, rows: list[tuple], k: int = 20) -> list[tuple]:
    table = spark.createDataFrame([(i, v, "q", 1, 2) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(table, table.where("vec_id % 20 = 0"), k).collect()))


def as_floats(values: list[float]) -> list[float]:
    return [struct_float(v) for v in values]


def struct_float(v: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", v))[0]


def test_ties_repeats_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "PARTITION", 60)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "BATCH", 3)
    pick = random.Random(5)
    rows = [(i, as_floats([pick.choice((-0.1, 0.0, 0.1, 0.11)) for _ in range(6)])) for i in range(200)]
    rows += [(200 + i, as_floats([0.1] * 6)) for i in range(50)]  # one vector many times
    rows += [(300, None), (301, [0.1, None]), (302, [float("nan")] * 6), (303, [float("inf")]), (None, [0.1] * 6), (304, []), (320, as_floats([0.5, 0.5]))]
    assert run(spark, rows) == brute_force(rows, 20)


def test_large_values_stay_exact(spark):
    rows = [(i, as_floats([1e9 + 64 * i, -3e8, 7.0 * i])) for i in range(45)]
    rows[40] = (40, as_floats([1e2, 1.0, 2.0]))
    want = [r for r in brute_force(rows, 3) if abs(r[3]) < 2**63]
    assert [r for r in run(spark, [r for r in rows if r[0] % 20 or r[0] == 40], 3)] == [r for r in brute_force([r for r in rows if r[0] % 20 or r[0] == 40], 3)]
    assert want


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [0.5]), (20, [0.25]), (3, [-1.0])]) == brute_force([(0, [0.5]), (20, [0.25]), (3, [-1.0])], 20)
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
