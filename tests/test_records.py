from __future__ import annotations

from typing import Literal, NamedTuple

import pytest

from assetlake.functions.records import check_json, decode_json, encode_json, infer_json
from assetlake.functions.text import decode_utf8, split_lines
from assetlake.plans.jobs import every, job, jsonl_etl, read_records, read_records_whole
from assetlake.sources import read_table


class Inner(NamedTuple):
    a: int
    b: str | None


class Rec(NamedTuple):
    k: int
    name: str | None
    inner: Inner | None
    tags: list[str] | None
    kind: Literal["x", "y"] | None


def reasons(spark, bodies, model=Rec, **kw):
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    return {r["body"]: r["_reason"] for r in check_json(df, "body", model, **kw).collect()}


def test_good_and_bad_records(spark):
    good = ['{"k":1}', '{"k":2,"name":null,"extra":7}', '{"k":3,"inner":{"a":1},"tags":["t"],"kind":"x"}', ' {"k":4}']
    bad = ["", "bad", '{"k":"x"}', '{"k":"1"}', "5", "[]", '{"name":"n"}', '{"k":1', '{"k":1,"inner":{"b":"z"}}',
           '{"k":1,"tags":[null]}', '{"k":1,"kind":"z"}', "null"]
    found = reasons(spark, good + bad)
    assert [b for b in good if found[b]] == []
    assert [b for b in bad if not found[b]] == []
    assert found['{"name":"n"}'] == "k: required value is missing"
    assert found['{"k":1,"kind":"z"}'] == "kind: value is not allowed"


def test_strict_fails(spark):
    df = spark.createDataFrame([('{"k":1}',), ("bad",)], "body string")
    with pytest.raises(Exception, match="broken record"):
        decode_json(df, "body", Rec, strict=True)[0].select("record.k").collect()


def test_encode_keeps_nulls_and_round_trips(spark):
    df = spark.createDataFrame([(1, None, (2, None), ["t"], "x")], "k long, name string, inner struct<a:long,b:string>, tags array<string>, kind string")
    body = df.select(encode_json("k", "name", "inner", "tags", "kind").alias("body"))
    assert '"name":null' in body.first()["body"]
    good, bad = decode_json(body, "body", Rec)
    assert good.select("record.*").collect() == df.collect() and bad.count() == 0


def test_utf8(spark):
    df = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xffA"),)], "b binary")
    assert [r[0] for r in df.select(decode_utf8(df["b"], strict=False)).collect()] == ["ok", None]
    with pytest.raises(Exception, match="MALFORMED"):
        df.select(decode_utf8(df["b"])).collect()


def test_split_keeps_the_last_empty_line(spark):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "")], "id int, text string")
    assert sorted(map(tuple, split_lines(df, "text").collect())) == [(1, 0, "a"), (1, 1, "b"), (1, 2, ""), (2, 0, "")]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_bytes(b'{"k":1}\n\nbad\n{"k":"x"}\n5\n')
    (tmp_path / "in" / "deep" / "b.jsonl").write_bytes(b'{"k":2,"name":"\xff"}\n{"k":3}\r\n')
    return tmp_path


def test_folder_of_json_lines(spark, folder):
    good, bad = read_records(spark, str(folder / "in"), Rec)
    assert sorted(r["k"] for r in good.collect()) == [1, 3]
    assert sorted(r["_reason"] for r in bad.collect())[-1] == "not a JSON object" and bad.count() == 4
    whole, rejected = read_records_whole(spark, str(folder / "in" / "a.jsonl"), Rec, strict=False)
    assert [r["k"] for r in whole.collect()] == [1] and rejected.count() == 3
    with pytest.raises(Exception, match="MALFORMED"):
        read_records(spark, str(folder / "in" / "deep"), Rec, strict=True)[0].collect()


def test_job_writes_a_stamped_folder_and_the_rejects(spark, folder):
    out = jsonl_etl(spark, str(folder / "in"), str(folder / "out"), "2024-01-01-00-00-00", Rec)
    assert out == str(folder / "out" / "2024-01-01-00-00-00")
    assert read_table(spark, out, Rec).count() == 2
    assert spark.read.parquet(f"{out}__rejected").count() == 4
    with pytest.raises(Exception):
        jsonl_etl(spark, str(folder / "in"), str(folder / "out"), "2024-01-01-00-00-00", Rec)
    with pytest.raises(ValueError, match="inside the input"):
        jsonl_etl(spark, str(folder / "in"), str(folder / "in" / "out"), "run", Rec)


def test_inference_unites_and_widens(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"b":1}\n{"b":2.5,"e":9}\n')
    df = infer_json(spark, str(tmp_path))
    assert df.dtypes == [("b", "double"), ("e", "bigint")]
    path = jsonl_etl(spark, str(tmp_path), str(tmp_path.parent / "inferred"), "run")
    assert spark.read.parquet(path).count() == 2


def test_jobs():
    @every(2, "hours")
    @job("nightly")
    def nightly(spark, factor):
        return factor * 2

    assert nightly(None, 4) == 8 and str(nightly.period) == "2 hours" and nightly.period.trigger() == {"processingTime": "2 hours"}
    with pytest.raises(ValueError):
        job("nightly")(lambda spark: None)
    with pytest.raises(ValueError):
        every(1, "week")(nightly)
