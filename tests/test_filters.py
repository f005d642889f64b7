from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assetlake.functions import duration
from assetlake.functions.paths import uri_container
from assetlake.operators.filters import first_of_type, flatten_groups, require_columns, status_filter

GROUPS = "cluster string, kind string, instances array<struct<id:string>>"


@pytest.fixture
def groups(spark):
    rows = [
        ("c1", "TASK", [("t1",), (None,)]), ("c1", "MASTER", [("m1",), ("m2",)]), ("c1", "CORE", []),
        ("c1", "OTHER", [("x",)]), ("c2", "CORE", [("k1",)]), ("c2", "TASK", None),
    ]
    return spark.createDataFrame(rows, GROUPS)


def test_flatten_reports_types_in_order_and_skips_missing_ids(groups):
    flat = flatten_groups(groups, "kind", "instances", F.col("member.id"))
    got = [(r["cluster"], r["type"], r["id"]) for r in flat.orderBy("cluster", "type_pos", "id").collect()]
    assert got == [("c1", "primary", "m1"), ("c1", "primary", "m2"), ("c1", "task", "t1"), ("c2", "core", "k1")]
    only = flatten_groups(groups, "kind", "instances", F.col("member.id"), wanted="core")
    assert [r["id"] for r in only.collect()] == ["k1"]
    with pytest.raises(ValueError, match="unknown type"):
        flatten_groups(groups, "kind", "instances", F.col("member.id"), wanted="master")


def test_first_of_a_type(groups):
    flat = flatten_groups(groups, "kind", "instances", F.col("member.id"))
    first = first_of_type(flat, "type", ["cluster", "id"])
    assert {(r["type"], r["id"]) for r in first.collect()} == {("primary", "m1"), ("core", "k1"), ("task", "t1")}
    assert first_of_type(flat, "type", ["id"], require=["primary"]).first()["id"] == "m1"
    with pytest.raises(Exception, match="nothing found for primary"):
        first_of_type(flat.filter("type <> 'primary'"), "type", ["id"], require=["primary"]).collect()


def test_status_filter(spark):
    states = [("a", "STARTING"), ("b", "TERMINATED"), ("c", "WAITING"), ("d", None)]
    df = spark.createDataFrame(states, "id string, state string")
    assert {r["id"] for r in status_filter(df, "state").collect()} == {"a", "c"}
    assert {r["id"] for r in status_filter(df, "state", "TERMINATED").collect()} == {"b"}
    with pytest.raises(ValueError, match="unknown state GONE"):
        status_filter(df, "state", "WAITING,GONE")


def test_require_columns(spark):
    df = spark.createDataFrame([("1", "n", 1), ("2", None, 1), (None, "n", 1)], "id string, name string, extra int")
    assert [tuple(r) for r in require_columns(df, ["id", "name"]).collect()] == [("1", "n")]


def test_uri_container(spark):
    df = spark.createDataFrame([("s3://logs/a/b",), ("short",), (None,)], "uri string")
    assert [r[0] for r in df.select(uri_container(F.col("uri"))).collect()] == ["logs", None, None]


def test_durations(spark):
    with pytest.raises(ValueError):
        duration(0, "day")
    slots = spark.sql("select timestamp_ntz'2024-01-01 00:00:59' as ts").select(duration(1, "minute").window("ts").alias("w"))
    assert str(slots.select("w.start").first()[0]) == "2024-01-01 00:00:00"


def test_glob_tables_match_like_lists(spark):
    import random

    from assetlake.operators.filters import glob_filter, glob_filter_table

    pick = random.Random(6)
    names = ["".join(pick.choice("abc.[]-!/*?\\^é") for _ in range(pick.randrange(1, 9))) for _ in range(300)] + ["a" * 40, "abc/def/ghi.gz", ""]
    globs = ["".join(pick.choice("aabbc.*?[]-!/\\^é") for _ in range(pick.randrange(0, 7))) for _ in range(400)]
    globs += ["*.gz", "abc/*", "*def*", "*", "[z-a]", "[!z-a]*", "[]a]", "[!]a]?", "a[!]b", "[a", "*/de[a-f]/*.gz", "*/de[a-f]/*.gz", "?", "", "[\\^a-]*", "*a[bc"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate([*names, *names[:20]])] + [(None, -1)], "name string, col int")
    table = spark.createDataFrame([(g,) for g in [*globs, None]], "pattern string")
    for chosen in (globs, globs[:3], globs[-3:]):
        table = spark.createDataFrame([(g,) for g in [*chosen, None]], "pattern string")
        got = sorted(tuple(r) for r in glob_filter_table(df, "name", table).collect())
        assert got == sorted(tuple(r) for r in glob_filter(df, "name", chosen).collect())
        got = sorted(tuple(r) for r in glob_filter_table(df, "name", table, distinct_keys=True).collect())
        assert got == sorted(tuple(r) for r in glob_filter(df, "name", chosen, distinct_keys=True).collect())
    assert glob_filter_table(df, "name", table.limit(0)).count() == df.count()
    assert glob_filter_table(df, "name", spark.createDataFrame([(None,)], "pattern string")).count() == 0


def test_many_globs_meet_names_by_equality(spark):
    from assetlake.operators.filters import glob_filter, glob_filter_table

    names = spark.range(2_000).selectExpr("concat('s3://b/', id, '/part.gz') as name")
    globs = spark.range(10_000).selectExpr("concat('s3://b/', id, '/*') as pattern")
    for distinct in (True, False):
        found = glob_filter_table(names, "name", globs, distinct_keys=distinct)
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert found.count() == 2_000


@pytest.mark.parametrize("limit, join", [(8 << 20, "BuildRight"), (0, "SortMergeJoin")])
def test_texts_of_names_are_not_broadcast(spark, monkeypatch, limit, join):
    """A name becomes a hundred texts; an estimate by names takes them for small."""
    from assetlake.operators import filters

    monkeypatch.setattr(filters, "BROADCAST_GLOBS", limit)
    names = spark.range(200).selectExpr("concat('s3://bucket/', id, '/', repeat('x', 60), '/part.gz') as name")
    globs = spark.range(3_000).selectExpr("concat('*/', id, '?*') as pattern")
    found = filters.glob_filter_table(names, "name", globs)
    joins = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and "_anchor" in x]
    assert len(joins) == 1 and join in joins[0]
    assert found.count() == sum(len({s[:n] for n in range(1, len(s))}) for s in map(str, range(200))) + 200


def test_members_in_other_states_are_passed_over(spark):
    from assetlake.operators.filters import first_members

    rows = [(1, "MASTER", [("a", "PENDING"), ("b", "RUNNING"), (None, "RUNNING")]), (2, "MASTER", [("c", "STOPPED")]), (3, "CORE", [("d", "RUNNING")]), (4, "MASTER", None)]
    df = spark.createDataFrame(rows, "g int, t string, members array<struct<id:string,state:string>>")
    state = lambda m: m["state"]
    found = flatten_groups(df, "t", "members", F.col("member.id"), state=F.col("member.state"))
    assert sorted((r["g"], r["type"], r["id"]) for r in found.collect()) == [(1, "primary", "b"), (3, "core", "d")]
    assert [tuple(r) for r in first_members(df, "t", "members", lambda m: m["id"], "primary", state=state).collect()] == [(1, "b")]
    broken = spark.createDataFrame([(1, "MASTER", [(None, "RUNNING"), ("b", "RUNNING")])], df.schema)
    with pytest.raises(Exception, match="has no id"):
        first_members(broken, "t", "members", lambda m: m["id"], "primary", state=state).collect()
    with pytest.raises(ValueError, match="unknown type"):
        first_members(df, "t", "members", lambda m: m["id"], "other")
