"""Rows with everything that can be odd about a table of documents."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, key string, words string, "
    "text_hash string, n int, row int, score double, component string"
)


def documents(spark: SparkSession, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    """Documents with columns whose names the operators use inside."""
    more = ("en", None, None, 1, "k", None, "h", 2, 3, 0.5, "c")
    return spark.createDataFrame([(i, t, *more) for i, t in rows], SCHEMA)


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"{pick.choice('bcdfg')}{pick.choice('aeiou')}w{pick.randrange(vocabulary)}" for _ in range(words))


def odd_rows() -> list[tuple[int | None, str | None]]:
    long = prose(1, 60_000, 5_000)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one two three four"), (5, "one two three four"), (6, prose(2, 300)),
        (None, prose(2, 300)), (None, None), (7, long), (8, long), (9, "日本 語の é テキスト" * 30), (10, "\x00" * 5 + "a b"), (11, "x" * 50_000),
    ]
