from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from common import documents, odd_rows, prose

from assetlake.llm.columns import crc32_of_id
from assetlake.llm.runs import find_runs, periodic_runs, repeated_tails, run_digests
from pyspark.sql import functions as F


def plain_runs(ids: list) -> list[tuple[int, int, int]]:
    """Every lag against the whole sequence."""
    n, out = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_digests(doc: int | None, text: str | None) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def sequences() -> list[list[int]]:
    pick = random.Random(3)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 300:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    out = [fibonacci[-1], [0] * 150, ([0, 0, 1] * 5 + [0]) * 6, [], [1] * 11, [1] * 12]
    for _ in range(1500):
        letters, x = pick.choice([1, 2, 2, 2, 3, 5]), []
        x = [pick.randrange(letters) for _ in range(pick.randrange(120))]
        for _ in range(pick.randrange(4)):
            if len(x) > 20:
                a = pick.randrange(len(x))
                p, m = pick.randrange(1, len(x) - a + 1), pick.randrange(len(x) - a + 1)
                for i in range(a, a + m):
                    x[i] = x[a + (i - a) % p]
        out.append(x)
    for _ in range(150):  # periods within periods
        x = [pick.randrange(2) for _ in range(pick.randrange(1, 6))]
        while len(x) < 300:
            x = x * pick.randrange(1, 5) + x[: pick.randrange(len(x) + 1)] + [pick.randrange(2) for _ in range(pick.randrange(3))]
        out.append(x[: pick.randrange(200, 400)])
    return out


def test_runs_by_brute_force():
    for x in sequences():
        assert find_runs(np.array(x, dtype=np.int64)) == plain_runs(x), x


@pytest.mark.parametrize("ids", [[0] * 100_000, [0, 0, 1] * 30_000, ([0] * 30 + [1]) * 3_000, list(range(50_000)) * 2], ids=["one", "three", "nested", "halves"])
def test_long_texts_take_seconds(ids):
    started = time.time()
    found = find_runs(np.array(ids, dtype=np.int64))
    assert found and time.time() - started < 20
    assert found[0][1] in (len(ids), 30)


def run_rows() -> list:
    rows = odd_rows() + [(i, prose(i, 60 + i % 50, 30)) for i in range(20, 60)]
    rows += [(100, "a b c " * 10), (100, "a b c " * 10), (101, "x " * 11), (102, "x " * 12), (103, "p q r s t u " * 2), (104, "a\x1cb\x85c d " * 9)]
    return rows


def test_query_columns_by_brute_force(spark):
    rows = [(i, t) for i, t in run_rows() if not t or len(t) < 100_000]
    docs = repeated_tails(documents(spark, rows), crc32_of_id(F.col("doc_id")))
    got = sorted((tuple(r) for r in run_digests(periodic_runs(docs)).collect()), key=str)
    assert got == sorted((plain_digests(i, t) for i, t in rows), key=str)


def test_odd_rows_and_empty_table(spark):
    rows = run_rows()
    found = periodic_runs(documents(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(r["collapsed"] is not None for r in found)
    assert next(r["collapsed"] for r in found if r["doc_id"] == 100) == "a b c"
    empty = run_digests(periodic_runs(repeated_tails(documents(spark, []), crc32_of_id(F.col("doc_id")))))
    assert empty.count() == 0
