"""Two or three versions of a keyed table: state at a time, differences, merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.functions.records import FULL_TIMES
from assetlake.operators.objects import latest


def as_of(log: DataFrame, key: str | Sequence[str], ts: str, at: Column | None = None,
          tie: Sequence[str] = (), tombstone: Column | None = None) -> DataFrame:
    """State of a keyed table at a time, from its change log.

    The time limit is a plain filter and reaches the scan. ``tie`` orders changes
    of the same time. A key whose newest change is a tombstone is absent.
    """
    rows = log if at is None else log.filter(F.col(ts) <= at)
    return latest(rows, key, [F.desc(c) for c in (ts, *tie)], tombstone)


def _payload(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in keys]


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _single(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """``df`` with its payload packed as ``side``; two rows of one key fail the query."""
    packed = df.groupBy(*keys).agg(F.first(F.struct(*_payload(df, keys))).alias(side), F.count("*").alias("_n"))
    twice = F.concat(F.lit(f"two rows in {side} for key "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("_n") > 1, F.raise_error(twice)).otherwise(F.col(side))
    return packed.select(*keys, checked.alias(side))


def _packed(df: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    return df.select(*keys, F.struct(*_payload(df, keys)).alias(side))


def table_diff(before: DataFrame, after: DataFrame, key: str | Sequence[str], compare: str = "values") -> DataFrame:
    """Keys that were ``added``, ``removed`` or ``changed``.

    ``compare="values"`` compares all payload columns exactly. For wide rows
    ``compare="digest"`` sends a SHA-256 of the payload through the shuffle instead.
    """
    keys = _keys(key)
    odd = set(before.columns) ^ set(after.columns)
    if odd:
        raise ValueError(f"the two states differ in the columns {sorted(odd)}")

    def side(df: DataFrame, name: str) -> DataFrame:
        if compare == "values":
            return _packed(df.select(*before.columns), keys, name)
        text = F.to_json(F.struct(*_payload(before, keys)), {"ignoreNullFields": "false", **FULL_TIMES})
        return df.select(*keys, F.sha2(text, 256).alias(name))

    # As one value the keys are equal also where they are null.
    keyed = lambda df: df.withColumn("_key", F.struct(*keys)).drop(*keys)
    both = keyed(side(before, "_old")).join(keyed(side(after, "_new")), "_key", "full_outer").select("_key.*", "_old", "_new")
    change = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    )
    return both.select(*keys, change.alias("change")).filter(F.col("change").isNotNull())


def apply_diff(before: DataFrame, after: DataFrame, diff: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """``before`` with the changes of ``diff`` taken from ``after``."""
    keys = _keys(key)
    kept = before.join(diff.select(*keys), keys, "left_anti")
    fresh = after.join(diff.filter("change <> 'removed'").select(*keys), keys, "left_semi")
    return kept.unionByName(fresh)


def branch_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Three-way merge: key, the merged row ``merged``, ``present`` and ``conflict``.

    A side equal to the base yields to the other side; a removed row counts as a
    change. Where both sides changed and differ, ``conflict`` is true and the row
    is left empty. All three versions go through one shuffle on the key.
    """
    keys = _keys(key)
    sides = {"_base": base, "_ours": ours, "_theirs": theirs}
    tagged = [
        df.select(*keys, *[(F.struct(*_payload(base, keys)) if s == side else F.lit(None)).alias(s) for s in sides])
        for side, df in sides.items()
    ]
    rows = reduce(DataFrame.unionByName, tagged).groupBy(*keys).agg(
        *[F.first(s, ignorenulls=True).alias(s) for s in sides], *[F.count(s).alias(f"{s}_n") for s in sides]
    )
    twice = reduce(lambda a, b: a | b, [F.col(f"{s}_n") > 1 for s in sides])
    named = F.concat(F.lit("two rows in one version for key "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))
    old, mine, other = F.col("_base"), F.col("_ours"), F.col("_theirs")
    merged = (
        F.when(twice, F.raise_error(named))
        .when(mine.eqNullSafe(old), other)
        .when(other.eqNullSafe(old) | mine.eqNullSafe(other), mine)
    )
    conflict = ~(mine.eqNullSafe(old) | other.eqNullSafe(old) | mine.eqNullSafe(other))
    out = rows.select(*keys, merged.alias("merged"), conflict.alias("conflict"))
    return out.withColumn("present", F.col("merged").isNotNull())


def table_merge(target: DataFrame, source: DataFrame, key: str | Sequence[str], delete: Column | None = None) -> DataFrame:
    """Upsert ``source`` into ``target``; ``delete`` drops target rows that the source does not touch.

    Two source rows for one key are an error, as it would be open which one wins.
    """
    keys = _keys(key)
    columns = target.columns
    old = target.withColumn("_gone", F.coalesce(delete, F.lit(False)) if delete is not None else F.lit(False))
    old = old.select(*keys, F.struct(*_payload(target, keys)).alias("_old"), "_gone")
    both = old.join(_single(source.select(*columns), keys, "source"), keys, "full_outer")
    kept = both.filter(F.col("source").isNotNull() | ~F.col("_gone"))
    row = F.coalesce("source", "_old")
    return kept.select(*keys, *[row[c].alias(c) for c in _payload(target, keys)]).select(*columns)


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true; an unknown condition keeps the row."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def update_where(target: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set columns on the rows for which the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    new = {c: F.when(hit, v.cast(target.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}
    return target.withColumns(new)
