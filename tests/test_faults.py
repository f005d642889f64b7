"""Rows that must not get lost, and faults that a small table does not show."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from assetlake.functions.records import check_json, encode_json
from assetlake.functions.text import not_blank
from assetlake.operators.care import layout_zorder
from assetlake.operators.objects import changes
from assetlake.operators.versions import table_diff
from assetlake.plans.assets import DB, backfill, source
from assetlake.queries.relational import conversation_sizes
from assetlake.session import is_missing_path, with_conf, work_path


@pytest.mark.parametrize("body, good", [
    ('{"k":1}', True), ('\t{"k":4}\n', True), (' \r\n{"k":5} ', True), ('{"k":1} junk', False), ('{"k":2}{"k":3}', False), ('{"k":2},{"k":3}', False),
    ('{"k":2}]', False), ('{"k":2}}', False), ('[{"k":2}]', False), ("", False), (None, False), ('{"k":"x"}', False),
])
def test_one_whole_record(spark, body, good):
    row = check_json(spark.createDataFrame([(body,)], "body string"), "body", "k int").first()
    assert (row["_reason"] is None) == good


def test_blank_lines_and_microseconds(spark):
    lines = spark.createDataFrame([("\r",), ("\t ",), ("",), (" x ",)], "line string")
    assert [r[0] for r in lines.filter(not_blank(F.col("line"))).collect()] == [" x "]
    at = spark.sql("select timestamp'2024-01-01 00:00:00.000001' as at")
    assert "00.000001" in at.select(encode_json("at").alias("j")).first()["j"]


def test_diff_of_microseconds_null_keys_and_columns(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    before = rows((None, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00"), (2, None))
    after = rows((None, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:00.000001"), (2, None))
    for compare in ("values", "digest"):
        assert [tuple(r) for r in table_diff(before, after, "k", compare).collect()] == [(1, "changed")]
    with pytest.raises(ValueError, match="extra"):
        table_diff(before, after.withColumn("extra", F.lit(1)), "k")
    objects = lambda *r: spark.createDataFrame(list(r), "key string, etag string, size bigint")
    assert changes(objects((None, "a", 1)), objects((None, "a", 1))).count() == 0


def test_backfill_keeps_every_row(spark):
    data = work_path(spark, "in")
    spark.createDataFrame([("1", "a"), ("x", "b"), ("2", "bad"), (None, "c")], "p string, v string").write.parquet(data)
    raw = source("faults_raw", load=lambda s: s.read.parquet(data))
    db = DB("faults")

    @db.t.table(input=raw, output="p int, v string", partition_by=["p"])
    def kept(raw):
        return raw

    root = work_path(spark, "lake")
    first = backfill(spark, root, kept, [{"p": 1}], run_id="one")
    second = backfill(spark, root, kept, [{"p": 2}, {"p": None}], run_id="two")
    good = kept.read(spark, root)
    assert sorted(map(tuple, good.collect()), key=str) == sorted([(1, "a"), (2, "bad"), (None, "c")], key=str)
    rejected = spark.read.parquet(f"{kept.path(root)}__rejected")
    assert {(r["run_id"], r["v"]) for r in rejected.collect()} == {("one", "b"), ("two", "b")}
    assert (first.rejected, second.rejected) == (1, 1)


def test_long_conversations(spark):
    turns = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("ab").alias("text"))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    assert conversation_sizes(spark, turns).agg(F.max("chars"), F.count("*")).first() == (600, 300)
    assert spark.conf.get(limit) == before


def test_settings_come_back_and_errors_come_out(spark):
    with with_conf(spark, {"spark.sql.files.maxPartitionBytes": "1m", "spark.made.up": "x"}):
        assert spark.conf.get("spark.made.up") == "x"
    assert spark.conf.get("spark.made.up", None) is None
    with pytest.raises(AnalysisException) as caught:
        spark.read.parquet(work_path(spark, "nothing"))
    assert is_missing_path(caught.value)
    with pytest.raises(AnalysisException) as caught:
        spark.range(1).select("none")
    assert not is_missing_path(caught.value)


def test_too_many_layout_bits(spark):
    wide = spark.range(3).select(*[F.col("id").alias(f"c{i}") for i in range(9)])
    with pytest.raises(ValueError, match="bits"):
        layout_zorder(wide, wide.columns)


def test_an_order_whose_lines_have_no_quantity_is_not_empty(spark, tmp_path):
    from assetlake.queries.relational import rel_semi_anti

    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, None), (2, None), (2, 50.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(tuple(r) for r in rel_semi_anti(spark, str(tmp_path)).collect()) == [("empty", 3), ("large", 2)]


def test_parents_in_a_circle_end(spark):
    from assetlake.operators.graph import ancestors

    commits = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "commit_id string, parent string")
    heads = spark.createDataFrame([("main", "d"), ("dev", "b")], "ref string, commit_id string")
    got = {(r["ref"], r["commit_id"]): r["distance"] for r in ancestors(commits, heads).collect()}
    assert got == {("main", "d"): 0, ("main", "a"): 1, ("main", "b"): 2, ("main", "c"): 3, ("dev", "b"): 0, ("dev", "c"): 1, ("dev", "a"): 2}
