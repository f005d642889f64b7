from __future__ import annotations

import datetime as dt
import decimal
import enum
from dataclasses import dataclass
from typing import Literal, NamedTuple, TypedDict

import pytest

from assetlake.schema import SchemaError, as_row_type, conform, partition_key, row_type


class Colour(enum.Enum):
    RED = "red"
    BLUE = "blue"


@dataclass
class Point:
    x: float
    y: float | None


class Everything(NamedTuple):
    s: str
    i: int
    f: float
    b: bool
    raw: bytes
    ts: dt.datetime
    day: dt.date
    money: decimal.Decimal
    points: list[Point]
    notes: dict[str, str]
    maybe: int | None
    colour: Colour
    size: Literal["s", "m"]
    region: partition_key(str)


def test_all_types():
    row = row_type(Everything)
    kinds = {f.name: (f.dataType.simpleString(), f.nullable) for f in row.schema}
    assert kinds == {
        "s": ("string", False), "i": ("bigint", False), "f": ("double", False), "b": ("boolean", False),
        "raw": ("binary", False), "ts": ("timestamp", False), "day": ("date", False), "money": ("decimal(38,18)", False),
        "points": ("array<struct<x:double,y:double>>", False), "notes": ("map<string,string>", False),
        "maybe": ("bigint", True), "colour": ("string", False), "size": ("string", False), "region": ("string", True),
    }
    assert row.allowed == {"colour": ("red", "blue"), "size": ("s", "m")}
    assert row.partition_by == ["region"]


def test_other_models(spark):
    class Typed(TypedDict):
        a: int

    assert as_row_type(Typed).schema.simpleString() == "struct<a:bigint>"
    assert as_row_type("a int, b string").schema.simpleString() == "struct<a:int,b:string>"
    pydantic = pytest.importorskip("pydantic")
    model = pydantic.create_model("M", a=(int, ...), b=(str | None, None))
    assert [(f.name, f.nullable) for f in as_row_type(model).schema] == [("a", False), ("b", True)]


def test_unknown_types_name_the_field():
    class Bad(NamedTuple):
        odd: complex

    with pytest.raises(SchemaError, match="odd"):
        row_type(Bad)
    with pytest.raises(SchemaError):
        partition_key(list)


class Out(NamedTuple):
    a: int
    b: Literal["x"] | None


def test_conform(spark):
    df = spark.createDataFrame([("1", "x", 0), ("z", "x", 0), (None, None, 0), ("2", "y", 0)], "a string, b string, c int")
    good, bad = conform(df, Out)
    assert [tuple(r) for r in good.collect()] == [(1, "x")] and good.dtypes[0] == ("a", "bigint")
    assert sorted(r["_reason"] for r in bad.collect()) == [
        "a: cannot be cast to bigint", "a: required value is missing", "b: value is not allowed",
    ]
    with pytest.raises(SchemaError, match="not declared"):
        conform(df, Out, extra="error")
    with pytest.raises(SchemaError, match="missing"):
        conform(df.drop("b"), Out)
