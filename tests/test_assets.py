from __future__ import annotations

import os
from graphlib import CycleError
from typing import NamedTuple

import pyspark.pandas as ps
import pytest
from oracle import rows_of
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assetlake.plans.assets import DB, Namespace, backfill, materialize, plan_order, source
from assetlake.plans.runlog import read_runs
from assetlake.schema import partition_key
from assetlake.sources.formats import MissingPackage, TableFormat, read_table, snapshot_sink, write_table


class Cell(NamedTuple):
    v: int
    p: partition_key(str)
    q: partition_key(bool)


def cells(spark):
    rows = [(1, "007", True), (2, "a b/c=d", False), (3, None, None), (4, "007", False), (5, "é", True)]
    return spark.createDataFrame(rows, "v long, p string, q boolean")


def test_names():
    db = DB("names_test")
    assert db.raw.web.path == "names_test.raw.web"
    assert db.raw is db.raw
    with pytest.raises(ValueError):
        DB("names_test")
    src = source("s", load=lambda spark: spark.range(1))

    @db.raw.table(input=src)
    def visits(df):
        return df

    assert visits.name == "names_test.raw.visits" and visits.view == "names_test__raw__visits"
    assert visits.path("/lake") == "/lake/main/names_test/raw/visits"


def test_shared_upstream_is_computed_once(spark, tmp_path):
    loads = []

    def load(spark):
        loads.append(1)
        return spark.range(4)

    src, ns = source("src", "id long", load), Namespace("once")

    @ns.table(input=src)
    def base(df):
        return df

    @ns.table(input=base)
    def left(df):
        return df.withColumn("l", F.lit(1))

    @ns.table(input=[left, base])
    def top(l, b):
        return l.join(b, "id")

    assert [t.name for t in ns.tables()] == ["once.base", "once.left", "once.top"]
    assert ns.tables(["once.left"]) == [left]
    with pytest.raises(KeyError):
        ns.tables(["once.right"])
    assert [n.name for n in plan_order([top])] == ["src", "once.base", "once.left", "once.top"]
    results = materialize(spark, str(tmp_path), ns, branch="dev", run_id="r1")
    assert [r.asset for r in results] == ["once.base", "once.left", "once.top"] and len(loads) == 1
    assert top.read(spark, str(tmp_path), "dev").count() == 4
    assert spark.sql("select count(*) from once__left").first()[0] == 4
    runs = read_runs(spark, f"{tmp_path}/_runs").collect()
    assert sorted((r["asset"], r["rows"], r["branch"], r["run_id"]) for r in runs) == [
        ("once.base", 4, "dev", "r1"), ("once.left", 4, "dev", "r1"), ("once.top", 4, "dev", "r1"),
    ]
    base.upstream.append(top)
    with pytest.raises(CycleError):
        plan_order([top])


def test_partitioned_table_needs_its_types():
    with pytest.raises(TypeError, match="declared output"):
        source("src", load=lambda s: s.range(1)).table(partition_by=["id"])(lambda df: df)


def test_rows_that_break_the_declaration_are_set_aside(spark, tmp_path):
    class Positive(NamedTuple):
        id: int

    ns = Namespace("reject")

    @ns.table(input=source("src", load=lambda s: s.createDataFrame([("1",), ("x",)], "id string")), output=Positive)
    def typed(df):
        return df

    (result,) = materialize(spark, str(tmp_path), [typed])
    assert (result.rows, result.rejected) == (1, 1)
    assert spark.read.parquet(f"{result.path}__rejected").first()["_reason"].startswith("id: cannot be cast")


def test_source_must_have_its_columns(spark):
    with pytest.raises(TypeError):
        source("src", "missing long", lambda s: s.range(1)).frame(spark)


@pytest.mark.parametrize("fmt", [TableFormat.PARQUET, TableFormat.ORC, TableFormat.CSV, TableFormat.JSON])
def test_partition_values_come_back_unchanged(spark, tmp_path, fmt):
    path = write_table(cells(spark), str(tmp_path / fmt.value), fmt, ["p", "q"])
    assert rows_of(read_table(spark, path, Cell, fmt)) == rows_of(cells(spark))


def test_text_formats_keep_difficult_text(spark, tmp_path):
    texts = ['say "hi"', "two\nlines", "back\\slash", "", None, " padded ", "a,b", "\\", '"', "x\r\ny"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for fmt in (TableFormat.CSV, TableFormat.JSON):
        back = read_table(spark, write_table(df, str(tmp_path / fmt.value), fmt), df.schema, fmt)
        assert dict(map(tuple, back.collect())) == dict(enumerate(texts)), fmt


@pytest.mark.parametrize("fmt", [TableFormat.AVRO, TableFormat.DELTA])
def test_formats_without_their_package(spark, tmp_path, fmt):
    try:
        path = write_table(spark.range(3), str(tmp_path / "t"), fmt)
    except MissingPackage as error:
        assert fmt.value in str(error)
    else:
        assert read_table(spark, path, "id long", fmt).count() == 3


def yearly(values):
    ns = Namespace("yearly")

    @ns.table(input=source("src", load=lambda s: s.createDataFrame(values, "v long, p string, q boolean")), output=Cell)
    def table(df):
        return df

    return table


def test_backfill_touches_only_its_slots(spark, tmp_path):
    root = str(tmp_path)
    materialize(spark, root, [yearly([(1, "a", True), (2, "b", False), (3, "b", True), (4, None, None)])])
    changed = yearly([(10, "a", True), (20, "b", False), (40, None, None)])
    result = backfill(spark, root, changed, [{"p": "b", "q": False}, {"p": "b", "q": True}, {"p": None, "q": None}])
    assert result.rows == 2
    got = {tuple(r) for r in changed.read(spark, root).collect()}
    assert got == {(1, "a", True), (20, "b", False), (40, None, None)}
    with pytest.raises(ValueError):
        backfill(spark, root, changed, [{"p": "b"}])


def test_backfill_of_all_slots_equals_a_full_run(spark, tmp_path):
    rows = [(1, "a", True), (2, "b", False)]
    materialize(spark, str(tmp_path / "full"), [yearly(rows)])
    materialize(spark, str(tmp_path / "filled"), [yearly([(0, "a", True), (0, "b", False)])])
    backfill(spark, str(tmp_path / "filled"), yearly(rows), [{"p": "a", "q": True}, {"p": "b", "q": False}])
    one, two = (yearly(rows).read(spark, str(tmp_path / d)) for d in ("full", "filled"))
    assert rows_of(one) == rows_of(two)


def test_pandas_transform(spark):
    @source("src", load=lambda s: s.range(5)).table("doubled")
    def doubled(df: ps.DataFrame) -> ps.DataFrame:
        df["id"] = df["id"] * 2
        return df

    assert doubled.name == "doubled"
    assert sorted(r["id"] for r in doubled.frame(spark).collect()) == [0, 2, 4, 6, 8]


def test_hot_partition_is_split_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        df = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit("hot").alias("p"))
        path = write_table(df, str(tmp_path / "hot"), partition_by=["p"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = [f for f in os.listdir(f"{path}/p=hot") if f.endswith(".parquet")]
    assert len(files) > 4


def test_snapshot_is_written_once(spark, tmp_path):
    path = snapshot_sink(spark.range(2), str(tmp_path), "2024-01-01-00-00-00")
    assert spark.read.parquet(path).count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        snapshot_sink(spark.range(2), str(tmp_path), "2024-01-01-00-00-00")


def test_rows_of_a_transform_by_chance_are_written_once(spark, tmp_path):
    """Which rows are rejected changes from one evaluation to the next; none may be lost or come twice."""
    numbers = source("numbers", load=lambda s: s.range(2_000))

    @numbers.table(output="id long, n int")
    def by_chance(df):
        return df.withColumn("n", F.when(F.rand() < 0.5, "1").otherwise("none"))

    [done] = materialize(spark, str(tmp_path), [by_chance])
    good, bad = by_chance.read(spark, str(tmp_path)), spark.read.parquet(f"{by_chance.path(str(tmp_path))}__rejected")
    assert done.rows == good.count() and done.rejected == bad.count() and 0 < done.rejected < 2_000
    assert sorted(r["id"] for r in good.select("id").unionByName(bad.select("id")).collect()) == list(range(2_000))
