"""Branches and tags as tables: a keyed table's rows with the commit that wrote them, parent links, and refs.

A commit is the rows it changed, marked with its id, and one row (``commit_id``, ``parent``). A branch or tag is one row
(``ref``, ``commit_id``); moving or rolling it back changes that row. What a ref sees is computed from these tables by joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlake.operators.graph import ancestors
from assetlake.operators.objects import latest
from assetlake.operators.versions import branch_merge
from assetlake.session import stored

_REF = "ref"


def ref_states(changes: DataFrame, commits: DataFrame, refs: DataFrame, key: str | Sequence[str], tombstone: Column | None = None) -> DataFrame:
    """``ref`` and the row of every key that the ref sees: the one of the nearest commit behind it.

    A key whose nearest change is a tombstone is absent. All refs are computed in one plan; each task keeps its best row
    per ref and key before the shuffle. What the refs see is stored, so that its size is known: few commits are broadcast,
    and the changes of a large commit are not brought into one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    seen = stored(ancestors(commits, refs.select(_REF, "commit_id")), "seen")
    rows = changes.join(seen, "commit_id")
    newest = latest(rows, [_REF, *keys], [F.col("distance")], tombstone)
    return newest.select(_REF, *[c for c in changes.columns if c != "commit_id"])


def common_commits(commits: DataFrame, refs: DataFrame, ours: str, theirs: str) -> DataFrame:
    """``commit_id`` of the newest commit that both refs have behind them; no row if they share none."""
    seen = ancestors(commits, refs.filter(F.col(_REF).isin(ours, theirs)).select(_REF, "commit_id"))
    shared = seen.groupBy("commit_id").agg(F.max(F.when(F.col(_REF) == ours, F.col("distance"))).alias("d"), F.count_distinct(_REF).alias("n"))
    return shared.filter("n = 2").orderBy("d").limit(1).select("commit_id")


def merge_refs(changes: DataFrame, commits: DataFrame, refs: DataFrame, key: str | Sequence[str], ours: str, theirs: str,
               tombstone: Column | None = None) -> DataFrame:
    """``branch_merge`` of what two refs see, against their newest common commit."""
    base = common_commits(commits, refs, ours, theirs).select(F.lit("_base").alias(_REF), "commit_id")
    all_refs = refs.filter(F.col(_REF).isin(ours, theirs)).select(_REF, "commit_id").unionByName(base)
    states = ref_states(changes, commits, all_refs, key, tombstone)
    one = lambda name: states.filter(F.col(_REF) == name).drop(_REF)
    return branch_merge(one("_base"), one(ours), one(theirs), key)
