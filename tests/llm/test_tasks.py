from __future__ import annotations

from common import documents

from assetlake.llm import columns, packing, secrets, tokens
from assetlake.llm.secrets import redacted_documents


def made() -> list[int]:
    """How many tables each operator keeps in this process."""
    kept = (packing.encoder, secrets._dictionary, tokens.counter)
    return [k.cache_info().currsize for k in kept]


def test_a_task_lets_go_of_what_other_operators_kept():
    packing.encoder(packing.default_tokenizer())
    secrets._dictionary(secrets.default_vocabulary())
    tokens.counter(tokens.default_model())
    assert all(made())
    assert list(columns.tidy(iter, packing.__name__)([1, 2])) == [1, 2]
    assert made() == [1, 0, 0]
    assert list(columns.tidy(lambda batches: batches)(iter([]))) == []
    assert made() == [0, 0, 0]
    assert len(packing.encoder(packing.default_tokenizer()).encode(["one two"])) == 1


def test_memory_is_given_back_when_a_task_ends_or_is_left(monkeypatch):
    ends: list[int] = []
    monkeypatch.setattr(columns, "give_back", lambda: ends.append(1))
    task = columns.tidy(iter, "operator")
    assert list(task([1, 2, 3])) == [1, 2, 3]
    assert len(ends) == 1
    left = task([1, 2, 3])
    next(left)
    left.close()
    assert len(ends) == 2


def test_redacted_texts_are_stored_before_the_caller_reads_them(spark):
    docs = documents(spark, [(i, f"password = x8Kq2!zPw9Lm{i}") for i in range(20)])
    result = redacted_documents(docs)
    assert "MapInArrow" not in result._jdf.queryExecution().executedPlan().toString()
    assert result.schema.simpleString() == docs.schema.simpleString()
    assert sorted(r["doc_id"] for r in result.collect()) == list(range(20))
