from __future__ import annotations

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from common import documents, odd_rows, prose

from assetlake.llm import lattice
from assetlake.llm.lattice import END, Lattice, score_documents, words_of

PIECES = ["<unk>", "<s>", "</s>", *[f"<0x{i:02X}>" for i in range(256)], "▁", "▁a", "▁ab", "a", "b", "c", "ab", "bc", "abc"]


def tiny() -> Lattice:
    weights = np.arange(1, len(PIECES) + 1, dtype=float)
    return Lattice(PIECES, np.log(weights / weights.sum()))


def cuts(own: Lattice, word: str) -> list[tuple[float, list[int]]]:
    """Probability and pieces of every cut."""
    if not word:
        return [(1.0, [])]
    out = []
    if word[0] not in own.single:
        ids = own._bytes_of(word[0])
        out += [(math.prod(math.exp(own.logs[i]) for i in ids) * p, ids + rest) for p, rest in cuts(own, word[1:])]
    for end in range(1, len(word) + 1):
        if word[:end] in PIECES:
            i = PIECES.index(word[:end])
            out += [(math.exp(own.logs[i]) * p, [i, *rest]) for p, rest in cuts(own, word[end:])]
    return out


@pytest.mark.parametrize("word", ["abc", "aabbc", "", "xaéb", "cab☃c", "abcabcab"])
def test_forward_and_expectation_by_enumeration(word):
    own = tiny()
    every = cuts(own, "▁" + word)
    total = sum(p for p, _ in every)
    assert own.word(word.encode()) == pytest.approx(math.log(total))
    expected, found = Counter(), np.zeros(len(PIECES))
    for p, ids in every:
        for i in ids:
            expected[i] += 3 * p / total
    own.expect(word.encode(), 3, found)
    assert found == pytest.approx(np.array([expected[i] for i in range(len(PIECES))]))


def odd_words(n: int) -> list[bytes]:
    pick = random.Random(n)
    words = {"".join(pick.choice("aabbcx\u00e9\u2603\U0001f600\u2581") for _ in range(pick.randrange(1, 14))).encode() for _ in range(n)}
    return [b"", b"\xff\xfea", b"a\x00b\nc", b"abc" * 700, b"abcab" * 300, *sorted(words)]


@pytest.mark.parametrize("n", [0, 3, 40, 3_000])
def test_many_words_as_one_by_one(n, monkeypatch):
    monkeypatch.setattr(lattice, "_GROUP_CHARS", 2_000)
    own, words = tiny(), odd_words(n) if n else []
    times = np.arange(1, len(words) + 1)
    assert own.words(words) == pytest.approx(np.array([own.word(w) for w in words]), rel=1e-12)
    plain, found = np.zeros(len(PIECES)), np.zeros(len(PIECES))
    for word, c in zip(words, times.tolist(), strict=True):
        own.expect(word, c, plain)
    own.expect_words(words, times, found)
    assert found == pytest.approx(plain, rel=1e-9)


def test_trie_finds_every_piece():
    pick = random.Random(5)
    pieces = {"".join(pick.choice("ab\u00e9\U0001f600") for _ in range(pick.randrange(1, 6))): i for i in range(300)}
    words = ["".join(pick.choice("ab\u00e9\U0001f600z") for _ in range(pick.randrange(1, 30))) for _ in range(50)]
    start, end, piece = lattice.Trie(pieces).matches(lattice._codes(words))
    text = "\n".join(words) + "\n"
    singles = {(i, i + 1, -1) for i, c in enumerate(text) if c != "\n" and c not in pieces}
    plain = {(i, j, pieces[text[i:j]]) for i in range(len(text)) for j in range(i + 1, i + 6) if text[i:j] in pieces and j <= len(text)}
    got = list(zip(start.tolist(), end.tolist(), piece.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == plain | singles


def test_many_words_cost_less_than_one_by_one():
    own = tiny()
    words, into = [w for w in odd_words(6_000) if len(w) < 99], np.zeros(len(PIECES))
    begun = time.process_time()
    for w in words:
        own.expect(w, 1, into)
    between = time.process_time()
    own.expect_words(words, np.ones(len(words)), into)
    assert time.process_time() - between < (between - begun) / 2


def test_long_words_take_no_steps_of_their_own(monkeypatch):
    own, seen = tiny(), []
    plain = own._edges_of
    monkeypatch.setattr(own, "_edges_of", lambda words: seen.append(max(map(len, words))) or plain(words))
    own.words([b"abc" * (20_000 + i) for i in range(4)] + odd_words(500)[5:])
    assert seen and max(seen) < 50


def test_tasks_go_with_words(spark, monkeypatch):
    monkeypatch.setattr(lattice, "TASK_WORDS", 100)
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + i % 3) for i in range(950)], "word binary, c bigint")
    dealt = lattice.spread(counts, 950)
    assert dealt.rdd.getNumPartitions() == 10 and dealt.count() == 950
    assert lattice.spread(counts.limit(0), 0).count() == 0


def base_by_hand(rows: list) -> dict:
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts: Counter = Counter()
    for i, t in rows:
        if i is not None and not held(i):
            counts.update([*words_of(t or ""), END])
    total, distinct, out = sum(counts.values()), len(counts), []
    for i, t in rows:
        tokens = [*words_of(t or ""), END]
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens)
        out.append((i, None if i is None else held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, base))
    return sorted(out, key=str)


def check(spark, rows: list) -> list:
    got = score_documents(documents(spark, rows)).collect()
    ours = sorted(((*r[:5], r["base_score"]) for r in got), key=str)
    for mine, plain in zip(ours, base_by_hand(rows), strict=True):
        assert mine[:5] == plain[:5] and mine[5] == pytest.approx(plain[5], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    return got


def test_scores_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lattice, "HEAD", 50)
    rows = odd_rows() + [(100 + i, prose(i, 80, 30)) for i in range(60)] + [(400, "unseenword " * 3), (401, "A a\x0bb\xa0c")]
    got = check(spark, rows)
    same = [r["score"] for r in got if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_likely_texts_score_higher(spark):
    rows = [(i, prose(i, 60, 40)) for i in range(80)] + [(1_000, prose(3, 60, 40)), (1_001, " ".join(f"{x}" for x in range(10**9, 10**9 + 60)))]
    got = {r["doc_id"]: r["score"] for r in check(spark, rows)}
    assert got[1_000] > got[1_001]


def test_no_training_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    check(spark, [(held[0], "some words"), (held[1], None), (None, "more")])
    assert score_documents(documents(spark, [])).count() == 0
