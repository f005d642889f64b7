"""Row types declared in Python, as Spark schemas and as checks."""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import types
import typing
from dataclasses import dataclass, field, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    from pydantic import BaseModel
except ImportError:
    BaseModel = None

_PRIMITIVES: dict[type, T.DataType] = {
    str: T.StringType(),
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    bytes: T.BinaryType(),
    dt.datetime: T.TimestampType(),
    dt.date: T.DateType(),
    decimal.Decimal: T.DecimalType(38, 18),
}


class SchemaError(TypeError):
    """A declared type that has no Spark type, or data that lacks a declared column."""


@dataclass(frozen=True)
class _PartitionMark:
    """Marks a field as a partition column inside ``Annotated``."""


PARTITION = _PartitionMark()


def partition_key(value_type: type) -> object:
    """Annotation for a partition column: ``region: partition_key(str)``."""
    if value_type not in (str, int, float, bool, type(None)):
        raise SchemaError(f"{value_type!r} cannot be a partition value")
    return typing.Annotated[value_type | None, PARTITION]


@dataclass
class RowType:
    """What a model declares: the Spark schema, which values are allowed, how it is partitioned."""

    schema: T.StructType
    allowed: dict[str, tuple] = field(default_factory=dict)
    partition_by: list[str] = field(default_factory=list)


def is_model(annotation: object) -> bool:
    if not isinstance(annotation, type):
        return False
    if BaseModel is not None and issubclass(annotation, BaseModel):
        return True
    named_tuple = issubclass(annotation, tuple) and hasattr(annotation, "_fields")
    return is_dataclass(annotation) or named_tuple or typing.is_typeddict(annotation)


def _unwrap(annotation: object) -> tuple[object, bool, bool]:
    """(bare annotation, nullable, partition mark)."""
    marked = False
    if typing.get_origin(annotation) is typing.Annotated:
        marked = any(isinstance(m, _PartitionMark) for m in annotation.__metadata__)
        annotation = typing.get_args(annotation)[0]
    nullable = False
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        members = typing.get_args(annotation)
        rest = [m for m in members if m is not type(None)]
        nullable = len(rest) < len(members)
        if len(rest) == 1:
            annotation = rest[0]
    return annotation, nullable, marked


def _allowed_values(annotation: object) -> tuple | None:
    if typing.get_origin(annotation) is typing.Literal:
        return typing.get_args(annotation)
    if isinstance(annotation, type) and issubclass(annotation, enum.Enum):
        return tuple(member.value for member in annotation)
    return None


def _data_type(annotation: object, name: str) -> T.DataType:
    if annotation in _PRIMITIVES:
        return _PRIMITIVES[annotation]
    values = _allowed_values(annotation)
    if values is not None:
        kinds = {type(v) for v in values}
        if len(kinds) == 1 and kinds <= set(_PRIMITIVES):
            return _PRIMITIVES[kinds.pop()]
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin is list and len(args) == 1:
        element, nullable, _ = _unwrap(args[0])
        return T.ArrayType(_data_type(element, f"{name}[]"), nullable)
    if origin is dict and len(args) == 2 and args[0] is str:
        value, nullable, _ = _unwrap(args[1])
        return T.MapType(T.StringType(), _data_type(value, f"{name}{{}}"), nullable)
    if is_model(annotation):
        return row_type(annotation, f"{name}.").schema
    raise SchemaError(f"field {name!r}: no Spark type for {annotation!r}")


def row_type(model: type, path: str = "") -> RowType:
    """Schema of a NamedTuple, dataclass, TypedDict or pydantic model."""
    if not is_model(model):
        raise SchemaError(f"{model!r} declares no fields")
    fields, allowed, partition_by = [], {}, []
    for name, annotation in typing.get_type_hints(model, include_extras=True).items():
        if name.startswith("_") or name == "model_config":
            continue
        bare, nullable, marked = _unwrap(annotation)
        fields.append(T.StructField(name, _data_type(bare, f"{path}{name}"), nullable))
        values = _allowed_values(bare)
        if values is not None:
            allowed[name] = values
        if marked:
            partition_by.append(name)
    return RowType(T.StructType(fields), allowed, partition_by)


def as_row_type(schema: RowType | T.StructType | type | str) -> RowType:
    """Accept a model, a Spark schema, a DDL string or a RowType."""
    if isinstance(schema, RowType):
        return schema
    if isinstance(schema, str):
        return RowType(T.StructType.fromDDL(schema))
    if isinstance(schema, T.StructType):
        return RowType(schema)
    return row_type(schema)


def nullable(data_type: T.DataType) -> T.DataType:
    """The same type with every field and element nullable, as files and JSON deliver it."""
    if isinstance(data_type, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in data_type])
    if isinstance(data_type, T.ArrayType):
        return T.ArrayType(nullable(data_type.elementType), True)
    if isinstance(data_type, T.MapType):
        return T.MapType(data_type.keyType, nullable(data_type.valueType), True)
    return data_type


def missing_values(value: Column, data_type: T.DataType) -> Column:
    """True where a required field below ``value`` is null, at any depth."""
    checks = []
    if isinstance(data_type, T.StructType):
        for f in data_type:
            inner = value[f.name]
            if not f.nullable:
                checks.append(inner.isNull())
            if _has_required(f.dataType):
                checks.append(inner.isNotNull() & missing_values(inner, f.dataType))
    elif isinstance(data_type, T.ArrayType):
        if not data_type.containsNull:
            checks.append(F.exists(value, lambda x: x.isNull()))
        if _has_required(data_type.elementType):
            inner_type = data_type.elementType
            checks.append(F.exists(value, lambda x: x.isNotNull() & missing_values(x, inner_type)))
    elif isinstance(data_type, T.MapType):
        checks.append(missing_values(F.map_values(value), T.ArrayType(data_type.valueType, data_type.valueContainsNull)))
    found = F.lit(False)
    for check in checks:
        found = found | F.coalesce(check, F.lit(False))
    return found


def _has_required(data_type: T.DataType) -> bool:
    if isinstance(data_type, T.StructType):
        return any(not f.nullable or _has_required(f.dataType) for f in data_type)
    if isinstance(data_type, T.ArrayType):
        return not data_type.containsNull or _has_required(data_type.elementType)
    if isinstance(data_type, T.MapType):
        return not data_type.valueContainsNull or _has_required(data_type.valueType)
    return False


def violation(row: RowType, column: typing.Callable[[str], Column]) -> Column:
    """First broken rule of a row as text, null for a good row."""
    rules = [
        F.when(_broken(column(f.name), f), F.lit(f"{f.name}: required value is missing"))
        for f in row.schema
        if not f.nullable or _has_required(f.dataType)
    ]
    for name, values in row.allowed.items():
        rules.append(
            F.when(column(name).isNotNull() & ~column(name).isin(*values), F.lit(f"{name}: value is not allowed"))
        )
    return F.coalesce(*rules) if rules else F.lit(None).cast("string")


def _broken(value: Column, f: T.StructField) -> Column:
    broken = F.lit(False) if f.nullable else value.isNull()
    return broken | (value.isNotNull() & missing_values(value, f.dataType)) if _has_required(f.dataType) else broken


def split_rows(df: DataFrame, reason: str = "_reason") -> tuple[DataFrame, DataFrame]:
    """(good rows without the reason column, bad rows with it)."""
    return df.filter(F.col(reason).isNull()).drop(reason), df.filter(F.col(reason).isNotNull())


def check_rows(df: DataFrame, schema: RowType | T.StructType | type | str, extra: str = "drop",
               reason: str = "_reason") -> DataFrame:
    """``df`` in the declared columns and types, plus why a row breaks the declaration.

    A declared column that ``df`` lacks is an error; undeclared columns are
    dropped, or refused with ``extra="error"``. A value that cannot be cast
    turns null and is reported.
    """
    row = as_row_type(schema)
    lacking = [f.name for f in row.schema if f.name not in df.columns]
    if lacking:
        raise SchemaError(f"columns {lacking} are declared but missing")
    surplus = [c for c in df.columns if c not in row.schema.names]
    if surplus and extra == "error":
        raise SchemaError(f"columns {surplus} are not declared")
    present = {f.name: f.dataType for f in df.schema}
    casts, failed = [], []
    for f in row.schema:
        source, target = F.col(f"`{f.name}`"), nullable(f.dataType)
        if nullable(present[f.name]) == target:
            casts.append(source)
            continue
        value = source.try_cast(target)
        casts.append(value.alias(f.name))
        failed.append(F.when(source.isNotNull() & value.isNull(), F.lit(f"{f.name}: cannot be cast to {f.dataType.simpleString()}")))
    uncast = F.coalesce(*failed) if failed else F.lit(None).cast("string")
    kept = df.select(*casts, uncast.alias(reason))
    broken = violation(row, lambda name: F.col(f"`{name}`"))
    return kept.withColumn(reason, F.coalesce(F.col(reason), broken))


def conform(df: DataFrame, schema: RowType | T.StructType | type | str,
            extra: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(rows that fit the declaration, rows that do not, with ``_reason``)."""
    return split_rows(check_rows(df, schema, extra))
