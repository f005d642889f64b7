from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
from common import documents, odd_rows
from tokenizers import Tokenizer

from assetlake.llm.packing import Plan, default_tokenizer, encoder, pack
from assetlake.tables import table


def library() -> Tokenizer:
    own = Tokenizer.from_file(default_tokenizer())
    own.encode_special_tokens = True
    return own


def check_plan(counts: dict[int, int], plan: Plan, capacity: int) -> None:
    seen: Counter[int] = Counter()
    filled: dict[int, list[tuple[int, int]]] = {}
    for length, rank, n, sequence, each, offset in plan.table().tolist():
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            filled.setdefault(sequence + i // each, []).append((offset + i % each * length, length))
    assert dict(seen) == {k: v for k, v in counts.items() if v}
    assert sorted(filled) == list(range(plan.used))
    for pieces in filled.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def test_plans_hold_every_piece_once():
    pick = random.Random(3)
    for _ in range(100):
        counts = {pick.randint(1, 512): pick.randint(1, 40) for _ in range(pick.randint(1, 60))}
        plan = Plan.best(counts, 512)
        check_plan(counts, plan, 512)
        assert plan.used >= -(-sum(k * v for k, v in counts.items()) // 512)
    assert Plan.best({}).used == 0 and Plan.best({4096: 5}).used == 5 and Plan.best({1: 10_000}).used == 3


def test_ids_equal_the_tokenizer():
    pick, own, ours = random.Random(2), library(), encoder(default_tokenizer())
    letters = "abcdeTHNIO'sſİµ½3 ,.!\t\n\x0b\x85\xa0\x1cé́ΣΑς日本😀ǅ²_-<|endoftext|>"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 60))) for _ in range(2_000)]
    texts += ["<|endoftext|> a", "it's we'll I'VE"]
    for text, ids in zip(texts, ours.encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == own.encode(text, add_special_tokens=False).ids, text


def check_packing(rows: list[tuple[int | None, str | None]], result: list) -> None:
    own = library()
    want: Counter = Counter()
    for key, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            data = np.array(ids[start : start + 4096], dtype="<u4").tobytes()
            want[key, piece, start, len(data) // 4, zlib.crc32(data)] += 1
    assert Counter((r[0], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in result) == want
    sequences: dict[int, list] = {}
    for r in result:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r["length"] for r in result)
    assert len(sequences) <= 1.1 * total / 4096 + 1


def test_packing_of_a_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], pack(docs).collect())


def test_odd_rows(spark):
    check_packing(odd_rows(), pack(documents(spark, odd_rows())).collect())
    assert pack(documents(spark, [])).count() == 0


MARKED = [
    "x <|endoftext|> y", "<|endoftext|>", "<|startoftext|><|endoftext|>a", "a<|endoftext|><|endoftext|> b\n", "<|endoftext|", "<|ENDOFTEXT|>",
    "é日本<|startoftext|>'s e\u0301<|endoftext|>\u0301", "<|endof<|endoftext|>text|>", "plain words", "", " <|endoftext|> ",
]


def test_added_tokens_in_texts_are_as_in_the_plain_call(spark):
    plain = Tokenizer.from_file(default_tokenizer())
    pick = random.Random(7)
    pieces = ["<|endoftext|>", "<|startoftext|>", " ", "a", "B c", "é", "\u0301", "日本", "'s", "<|", "|>", "1", "\n", "\x85"]
    texts = MARKED + ["".join(pick.choice(pieces) for _ in range(pick.randint(1, 12))) for _ in range(1_000)]
    wanted = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert wanted[0] == [343, 49407, 344]
    for text, want, ids in zip(texts, wanted, encoder(default_tokenizer()).encode_marked(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == want, text
    rows = list(enumerate(MARKED))
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in pack(documents(spark, rows)).collect()}
    for i, want in zip(range(len(MARKED)), wanted, strict=False):
        assert got[i] == (len(want) + 1, zlib.crc32(np.array([*want, 1], dtype="<u4").tobytes()))
