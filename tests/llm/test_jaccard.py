from __future__ import annotations

import random
import re

import numpy as np
import pytest
from common import documents, odd_rows, prose
from pyspark.sql import functions as F

from assetlake.llm import jaccard
from assetlake.llm.jaccard import Chunk, CountTree, _links, distinct_documents, near_duplicates, shard_keys
from assetlake.llm.words import shingle_sets
from assetlake.tables import table


def plain_set(text: str | None) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows: list[tuple[int | None, str | None]]) -> dict[int, tuple[int, int]]:
    sets = {i: plain_set(t) for i, t in rows if i is not None}
    ids, up = sorted(sets), {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            i = up[i]
        return i

    for at, i in enumerate(ids):
        for j in ids[at + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(text: str, share: float, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(f"new{pick.randrange(10**6)}" if pick.random() < share else w for w in text.split())


def family() -> list[tuple[int, str]]:
    """Copies of all sizes with edits from none to too many, some of them only linked through others."""
    rows = []
    for k, words in enumerate((6, 9, 30, 62, 70, 130, 260, 1_000)):
        text = prose(k, words)
        rows += [(100 * k + i, edited(text, share, i)) for i, share in enumerate((0, 0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.05, 0.2))]
        rows.append((100 * k + 50, text.upper()))
        rows += [(100 * k + 60 + i, text + " " + prose(i + 900, words * i // 12)) for i in range(1, 5)]
    return rows


def check(spark, rows) -> None:
    want = brute_force(rows)
    got = near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] is None


def test_against_brute_force(spark):
    check(spark, family() + [(5_000 + i, t) for i, t in odd_rows() if i is not None] + [(None, "a b c d e f"), (None, None)])


def test_split_neighbourhoods(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 3)
    check(spark, family())


def test_table(spark, sf_dir):
    check(spark, [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()])


def test_empty_table(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert near_duplicates(documents(spark, [(1, "all alone here"), (2, None)])).count() == 2


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 9, 31, 62, 63, 64, 65, 79, 80, 100, 127, 128, 150, 300, 1_000, 3_000])
def test_linked_sets_share_a_key(size):
    draw = np.random.Generator(np.random.PCG64(size))
    for _ in range(30):
        small = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for grown in {size, size * 9 // 8, size * 5 // 4}:
            kept = int(np.ceil((len(small) + grown) * 4 / 9))
            if kept > len(small):
                continue
            large = np.concatenate((draw.permutation(small)[:kept], draw.integers(0, 1 << 63, grown - kept, dtype=np.uint64)))
            large = np.unique(large)
            assert _links(small, large)
            assert set(shard_keys(small).tolist()) & set(shard_keys(large).tolist())


def test_a_common_line_brings_no_sets_together(spark):
    rng = np.random.default_rng(5)
    line = " ".join(f"c{i}" for i in range(20))
    texts = [f"{line} {' '.join(f'w{x}' for x in rng.integers(0, 10**6, n))}" for n in rng.integers(25, 90, 400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    together = jaccard._keys(docs, "doc_id", "text").groupBy("key").agg(F.countDistinct("id").alias("n")).agg(F.max("n")).first()[0]
    assert together <= jaccard.COMMON_SETS
    assert near_duplicates(docs).where("component_id <> doc_id").count() == 0


@pytest.mark.parametrize("size", [5, 20, 63, 64, 70, 79, 127, 128, 150, 300])
def test_linked_sets_share_a_key_whatever_is_common(size):
    rng = np.random.default_rng(size)
    for _ in range(60):
        x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        y = np.unique(np.concatenate((x[rng.permutation(len(x))[: len(x) - len(x) // 10]], rng.integers(0, 2**64, len(x) // 10, dtype=np.uint64))))
        if _links(x, y):
            known = np.unique(np.concatenate([jaccard._block_keys(s, level)[0] for s in (x, y) for level, _ in jaccard._levels(len(s))]))
            common = jaccard.Common(rng.permutation(known)[: rng.integers(0, len(known) + 1)])
            assert set(shard_keys(x, common).tolist()) & set(shard_keys(y, common).tolist())


def test_tree_finds_every_link():
    texts = [t.encode() for _, t in family()]
    sets = shingle_sets(texts)
    points = np.stack([np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=64) for s in sets])
    sizes = np.array([len(s) for s in sets])
    tree = CountTree(points, sizes)
    pruned = 0
    for i, s in enumerate(sets):
        found = set(tree.search(points[i], len(s)).tolist())
        pruned += len(sets) - len(found)
        assert {j for j in range(len(sets)) if _links(s, sets[j])} <= found
    assert pruned > len(sets) ** 2 / 2
    linked = {i for i, a in enumerate(sets) if any(_links(a, b) for j, b in enumerate(sets) if j != i)}
    assert {i for pair in Chunk(sets).edges() for i in pair} == linked
    half = Chunk(sets[::2])
    for s in sets[1::2]:
        found = half.visit(s)
        assert (found is not None) == any(_links(s, t) for t in sets[::2])


def test_one_document_of_each_group_stays(spark):
    text = prose(4, 100)
    rows = [(3, text), (1, text), (1, text), (2, edited(text, 0.005, 1)), (9, "other words"), (None, text), (7, None), (8, "")]
    kept = sorted(((r["doc_id"], r["text"]) for r in distinct_documents(documents(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, text), (9, "other words"), (None, text), (7, None), (8, "")], key=str)


def by_id(rows: list[tuple[int | None, str | None]]) -> dict[int, int]:
    """The component of each id by comparing every row with every other; ids may have several texts."""
    rows, up = [(i, plain_set(t)) for i, t in rows if i is not None], {}

    def root(i: int) -> int:
        while up.get(i, i) != i:
            i = up[i]
        return i

    for at, (i, x) in enumerate(rows):
        for j, y in rows[at + 1 :]:
            both = len(x & y)
            if root(i) != root(j) and both and 100 * both >= 80 * (len(x) + len(y) - both):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i, _ in rows}


def test_an_id_with_different_texts_links_by_each_of_them(spark):
    a, b, c = prose(21, 100), prose(22, 100), prose(23, 100)
    rows = [
        (1, a), (9, a), (9, b), (7, edited(b, 0.005, 3)), (9, ""), (-4, c), (20, edited(c, 0.005, 4)), (20, edited(a, 0.005, 5)),
        (30, "alone with " + prose(24, 20)), (30, "and " + prose(25, 20)), (31, prose(26, 20)), (31, None), (None, b), (None, None),
        (-(1 << 63), "x y"), ((1 << 63) - 1, "x y"), (40, "x y"), (41, None), (41, None),
    ]
    want = by_id(rows)
    assert want[9] == want[7] == want[1] == want[20] == want[-4] == -4
    got = near_duplicates(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(
        ((i, len(plain_set(t)), want.get(i)) for i, t in rows), key=str
    )
