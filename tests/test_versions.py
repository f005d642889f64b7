from __future__ import annotations

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from assetlake.operators import versions as ops
from assetlake.operators.graph import ancestors, impact
from assetlake.operators.refs import common_commits, merge_refs, ref_states

SCHEMA = "k long, a string, b double"
BASE = [(1, "x", 1.0), (2, "x", None), (3, None, 3.0), (4, "x", 4.0)]
AFTER = [(1, "x", 1.0), (2, "x", 2.0), (4, "y", 4.0), (5, "n", None)]


def df(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("compare", ["values", "digest"])
def test_diff_and_apply(spark, compare):
    before, after = df(spark, BASE), df(spark, AFTER)
    diff = ops.table_diff(before, after, "k", compare)
    assert {tuple(r) for r in diff.collect()} == {(2, "changed"), (3, "removed"), (4, "changed"), (5, "added")}
    assert rows_of(ops.apply_diff(before, after, diff, "k")) == rows_of(after)
    assert ops.table_diff(after, after, "k", compare).count() == 0


def test_merge_of_an_unchanged_side_is_the_other_side(spark):
    base, after = df(spark, BASE), df(spark, AFTER)
    for ours, theirs in [(base, after), (after, base), (after, after)]:
        rows = ops.branch_merge(base, ours, theirs, "k")
        assert rows.filter("conflict").count() == 0
        assert rows_of(rows.filter("present").select("k", "merged.*")) == rows_of(after)


def test_merge_conflicts(spark):
    ours = df(spark, [(1, "ours", 1.0), (2, "x", None), (4, "x", 4.0)])
    theirs = df(spark, [(1, "theirs", 1.0), (2, "x", 9.0), (3, "changed", 3.0), (4, "x", 4.0)])
    rows = {r["k"]: r for r in ops.branch_merge(df(spark, BASE), ours, theirs, "k").collect()}
    assert [k for k, r in rows.items() if r["conflict"]] == [1, 3] or {k for k, r in rows.items() if r["conflict"]} == {1, 3}
    assert rows[2]["merged"]["b"] == 9.0 and not rows[1]["present"]
    with pytest.raises(Exception, match="two rows in one version for key 1"):
        ops.branch_merge(df(spark, BASE), ours.unionByName(ours), theirs, "k").collect()


def test_table_merge(spark):
    target = df(spark, BASE)
    source = df(spark, [(2, "s", 0.0), (9, "new", None)])
    merged = ops.table_merge(target, source, "k", delete=F.col("a").isNull())
    assert {tuple(r) for r in merged.collect()} == {(1, "x", 1.0), (2, "s", 0.0), (4, "x", 4.0), (9, "new", None)}
    with pytest.raises(Exception, match="two rows in source for key 2"):
        ops.table_merge(target, source.unionByName(source), "k").collect()


def test_delete_and_update_where(spark):
    target = df(spark, BASE)
    assert {r["k"] for r in ops.delete_where(target, F.col("b") > 2).collect()} == {1, 2}
    updated = ops.update_where(target, F.col("a") == "x", b=F.lit(0))
    assert {(r["k"], r["b"]) for r in updated.collect()} == {(1, 0.0), (2, 0.0), (3, 3.0), (4, 0.0)}


def test_tombstones_and_ties(spark):
    log = spark.createDataFrame([(1, 1, 1, "put"), (1, 2, 2, "del"), (2, 1, 3, "del"), (2, 1, 4, "put")], "k int, ts int, seq int, op string")
    state = ops.as_of(log, "k", "ts", tie=["seq"], tombstone=F.col("op") == "del")
    assert [(r["k"], r["seq"]) for r in state.collect()] == [(2, 4)]
    assert {r["k"] for r in ops.as_of(log, "k", "ts", F.lit(1), ["seq"], F.col("op") == "del").collect()} == {1, 2}


CHANGES = "commit_id string, k int, v int, gone boolean"
HISTORY = [("c1", None), ("c2", "c1"), ("c3", "c2"), ("d1", "c1"), ("d2", "d1"), ("e1", "d2")]


def history(spark, refs):
    commits = spark.createDataFrame(HISTORY, "commit_id string, parent string")
    return commits, spark.createDataFrame(refs, "ref string, commit_id string")


def test_refs_see_what_lies_behind_them(spark):
    changes = df(spark, [
        ("c1", 0, 1, False), ("c1", 1, 2, False), ("c2", 0, 10, False), ("c3", 1, 0, True), ("c3", 2, 5, False), ("d1", 1, 20, False), ("d2", 0, 0, True),
        ("c1", None, 7, False), ("d2", None, 8, False),
    ], CHANGES)
    commits, refs = history(spark, [("main", "c3"), ("tag", "c1"), ("dev", "d2"), ("back", "c2"), ("none", "zz")])
    got = {}
    for r in ref_states(changes, commits, refs, "k", F.col("gone")).collect():
        got.setdefault(r["ref"], {})[r["k"]] = r["v"]
    assert got == {"main": {0: 10, 2: 5, None: 7}, "tag": {0: 1, 1: 2, None: 7}, "dev": {1: 20, None: 8}, "back": {0: 10, 1: 2, None: 7}}


def test_refs_merge_against_their_common_commit(spark):
    changes = df(spark, [
        ("c1", 0, 1, False), ("c1", 1, 2, False), ("c2", 0, 10, False), ("d1", 1, 20, False), ("d2", 2, 30, False), ("e1", 0, 5, False),
    ], CHANGES)
    commits, refs = history(spark, [("main", "c2"), ("dev", "d2"), ("late", "e1")])
    assert [r["commit_id"] for r in common_commits(commits, refs, "main", "dev").collect()] == ["c1"]
    merged = {r["k"]: r for r in merge_refs(changes, commits, refs, "k", "main", "dev").collect()}
    assert {k: r["merged"]["v"] for k, r in merged.items()} == {0: 10, 1: 20, 2: 30} and not any(r["conflict"] for r in merged.values())
    late = {r["k"]: r["conflict"] for r in merge_refs(changes, commits, refs, "k", "main", "late").collect()}
    assert late == {0: True, 1: False, 2: False}


def test_ancestors_of_shared_history(spark):
    chain = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(21)]
    commits = spark.createDataFrame([*chain, ("b", "c3")], "commit_id string, parent string")
    heads = spark.createDataFrame([("main", "c20"), ("side", "b")], "ref string, commit_id string")
    got = {(r["ref"], r["commit_id"]): r["distance"] for r in ancestors(commits, heads).collect()}
    want = {("main", f"c{20 - d}"): d for d in range(21)} | {("side", "b"): 0} | {("side", f"c{3 - d}"): d + 1 for d in range(4)}
    assert got == want


def test_impact_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("x", "y"), ("a", "b")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in impact(edges, roots).collect()} == {("b", 1), ("c", 1), ("d", 2), ("a", 3)}
    assert impact(edges, roots.filter("node = 'zzz'")).count() == 0


def test_changes_are_not_dealt_by_their_few_commits(spark):
    changes = spark.range(2_000_000).selectExpr("if(id % 3 = 0, 'c1', 'c2') as commit_id", "id as k", "id as v")  # too large for a broadcast
    commits, refs = history(spark, [("main", "c3")])
    states = ref_states(changes, commits, refs, "k")
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(commit_id" not in plan and "BroadcastHashJoin [commit_id" in plan
