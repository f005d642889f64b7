from __future__ import annotations

import random

from common import documents, odd_rows
from tokenizers import Tokenizer, models, pre_tokenizers

from assetlake.llm.tokens import count_tokens, counter, default_model, vocabulary
from assetlake.tables import table


def library() -> Tokenizer:
    own = Tokenizer(models.Unigram(vocabulary(default_model()), unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return own


def test_counts_equal_the_library_on_random_texts():
    pick, own, count = random.Random(1), library(), counter(default_model())
    letters = "abcdethnio ▁  \n\té☃😀<s>x0A日本"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 40))) for _ in range(2_000)]
    for text in [*texts, "", " ", "  a", "a ", "▁", "\n\n", "<s> <0x0A>"]:
        assert count.text(text)[0] == len(own.encode(text, add_special_tokens=False).ids), text


def test_query_equals_the_library(spark, sf_dir):
    own = library()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    for row in count_tokens(table(spark, sf_dir, "documents")).collect():
        assert row["n_tokens"] == len(own.encode(texts[row["doc_id"]], add_special_tokens=False).ids)


def test_odd_rows(spark):
    rows = count_tokens(documents(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert count_tokens(documents(spark, [])).count() == 0


def test_least_score_path_by_brute_force():
    count = counter(default_model())
    scores = dict(vocabulary(default_model()))

    def all_cuts(word: str):
        if not word:
            yield 0.0
        for end in range(1, len(word) + 1):
            if word[:end] in scores:
                for rest in all_cuts(word[end:]):
                    yield scores[word[:end]] + rest

    for word in ("▁the", "▁thing", "▁ation", "▁dances"):
        assert count.best(word)[1] == max(all_cuts(word))
