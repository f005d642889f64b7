from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assetlake.functions.variants import _fields, infer_variant, variant_columns
from assetlake.plans import sketches as sk
from assetlake.sources.bucketed import forget, write_bucketed


def test_types_that_clash_stay_variants(spark):
    bodies = [
        '{"a": 1, "b": "x", "odd name": true, "l": [1, 2], "o": {"p": 1}}', '{"a": "one", "b": null, "l": [3], "o": {"p": "q"}, "it\'s": 1.5, "it\'s \\"q\\"": "w"}',
        '{"a": [1], "b": "y"}', '{"a": ', "5", None, "[1]", '{"b": "z", "x`y": 7}',
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = infer_variant(df, "body")
    assert variant_columns(got) == ["a", "o"]
    types = {f.name: f.dataType.simpleString() for f in got.schema}
    assert types["b"] == "string" and types["l"] == "array<bigint>" and types["odd name"] == "boolean" and types["x`y"] == "bigint"
    rows = {r["i"]: r for r in got.withColumns({"a": F.to_json("a"), "o": F.to_json("o")}).collect()}
    assert [rows[i]["a"] for i in range(3)] == ["1", '"one"', "[1]"] and rows[1]["o"] == '{"p":"q"}'
    assert [rows[i]["_corrupt"] for i in range(8)] == [False, False, False, True, False, False, False, False]
    assert rows[0]["odd name"] is True and float(rows[1]["it's"]) == 1.5 and rows[1]['it\'s "q"'] == "w" and rows[7]["x`y"] == 7 and rows[4]["b"] is None
    with pytest.raises(ValueError, match="exist already"):
        infer_variant(spark.createDataFrame([('{"body": 1}',)], "body string"), "body")


def test_no_objects_and_no_rows(spark):
    for rows in ([], [("nonsense",), (None,)], [("3",)]):
        assert infer_variant(spark.createDataFrame(rows, "body string"), "body").columns == ["body", "_corrupt"]


def test_schema_text():
    assert _fields("OBJECT<a: ARRAY<OBJECT<x: BIGINT, y: STRING>>, `b, c`: DECIMAL(3,1), d: VOID>") == [
        ("a", "ARRAY<OBJECT<x: BIGINT, y: STRING>>"), ("b, c", "DECIMAL(3,1)"), ("d", "VOID"),
    ]
    assert _fields("BIGINT") == []


def test_sketches_merge_like_the_rows(spark, tmp_path):
    rows = spark.range(27_000).selectExpr("concat('p', id % 6) as part", "id % 9000 as k", "if(id % 10 = 0, null, id * 3) as v")
    sk.log_sketches(spark, str(tmp_path), "1", "t", sk.partition_sketches(rows.filter("part = 'p0'").limit(5), "part", ["k", "v"]))
    sk.log_sketches(spark, str(tmp_path), "2", "t", sk.partition_sketches(rows, "part", ["k", "v"]))
    whole = {r["column"]: r for r in sk.merged(sk.read_sketches(spark, str(tmp_path), "t")).collect()}
    assert (whole["k"]["n"], whole["k"]["low"], whole["k"]["high"], whole["v"]["nulls"]) == (27_000, 0, 8_999, 2_700)
    found = {(r["column"], r["fraction"]): r["value"] for r in sk.quantiles(sk.merged(sk.read_sketches(spark, str(tmp_path), "t")), [0.1, 0.5, 0.9]).collect()}
    assert all(abs(found["k", f] / 9_000 - f) < 0.02 and abs(found["v", f] / 81_000 - f) < 0.02 for f in (0.1, 0.5, 0.9))
    one, other = [sk.merged(sk.read_sketches(spark, str(tmp_path), "t", parts)) for parts in (["p0", "p1"], ["p1", "p2"])]
    r = {r["column"]: r for r in sk.overlap(one, other).collect()}["k"]
    exact = {n: set(x % 9000 for x in range(27_000) if x % 6 in p) for n, p in (("a", (0, 1)), ("b", (1, 2)))}
    assert abs(r["all_keys"] - len(exact["a"] | exact["b"])) < 0.06 * len(exact["a"] | exact["b"])
    assert abs(r["common_keys"] - len(exact["a"] & exact["b"])) < 0.06 * len(exact["a"] | exact["b"])


def test_bucketed_tables_join_without_a_shuffle(spark, tmp_path):
    a = write_bucketed(spark.range(3_000).selectExpr("id % 500 as k", "id as v"), f"{tmp_path}/a", "k", 8, "bucketed_a")
    b = write_bucketed(spark.range(500).selectExpr("id as j", "id * 2 as w"), f"{tmp_path}/b", "j", 8, "bucketed_b")
    joined = b.hint("merge").join(a, F.col("k") == F.col("j")).groupBy("k").agg(F.count("*").alias("n"))
    assert {r["n"] for r in joined.collect()} == {6}
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "SortMergeJoin" in text
    forget(spark, "bucketed_a")
    forget(spark, "bucketed_b")
    assert spark.read.parquet(f"{tmp_path}/a").count() == 3_000
