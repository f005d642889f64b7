"""Bytes to text, text to lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode_utf8(body: Column, strict: bool = True) -> Column:
    """UTF-8 text of a binary column.

    Strict decoding fails the query on malformed bytes. Otherwise such a value
    becomes null, so that the caller can set the row aside.
    """
    if strict:
        return F.decode(body, "UTF-8")
    return F.try_validate_utf8(body.cast("string"))


def split_lines(df: DataFrame, text: str, line: str = "line", pos: str = "pos") -> DataFrame:
    """One row per line, numbered from 0; a trailing newline gives a last empty line."""
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(F.split(text, "\n", -1)).alias(pos, line)).withColumn(
        pos, F.col(pos).cast("bigint")
    )


def not_blank(line: Column) -> Column:
    return line.rlike(r"\S")
