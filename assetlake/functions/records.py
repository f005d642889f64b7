"""JSON text to typed rows and back, with the broken records set apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.schema import RowType, as_row_type, nullable, split_rows, violation

_CORRUPT = "_corrupt_record"

#: The default formats cut timestamps to milliseconds.
FULL_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def parse_json(body: Column, schema: RowType | T.StructType | type | str) -> Column:
    """Struct of the declared fields; a record that does not parse gives nulls."""
    return F.from_json(body, nullable(as_row_type(schema).schema))


def check_json(df: DataFrame, body: str, schema: RowType | T.StructType | type | str,
               out: str = "record", reason: str = "_reason", strict: bool = False) -> DataFrame:
    """Add the decoded struct ``out`` and ``reason``, which is null for a good record.

    With ``strict`` a broken record fails the query. ``from_json`` alone is too lenient: a missing required field, a bare scalar
    and a value of the wrong type would all pass as nulls.
    """
    row = as_row_type(schema)
    wire = T.StructType([*nullable(row.schema).fields, T.StructField(_CORRUPT, T.StringType())])
    parsed = df.withColumn(out, F.from_json(F.col(body), wire, {"columnNameOfCorruptRecord": _CORRUPT}))
    value = F.col(out)
    why = (
        F.when(F.col(body).isNull(), "no body")
        .when(~F.col(body).rlike(r"^\s*\{"), "not a JSON object")
        .when(value[_CORRUPT].isNotNull(), "malformed or wrong type")
        # One pair of braces that opens and closes the body: what parses there has nothing behind it.
        .when(~F.col(body).rlike(r"^\s*\{[^{}]*\}\s*$") & _has_tail(F.col(body)), "text after the record")
        .otherwise(violation(row, lambda name: value[name]))
    )
    if strict:
        why = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("broken record: "), why)))
    fields = F.struct(*[value[f.name].alias(f.name) for f in row.schema])
    if strict:  # whoever reads the record also runs the check
        fields = F.when(why.isNull(), fields)
    return parsed.withColumns({reason: why, out: fields})


def _has_tail(body: Column) -> Column:
    """Whether text follows the first record. Spark's parsers stop there; no tail closes both of these wrappers."""
    listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), T.ArrayType(T.StructType()))
    held = F.from_json(
        F.concat(F.lit('{"v":'), body, F.lit("}")), T.StructType([T.StructField("v", T.StringType()), T.StructField(_CORRUPT, T.StringType())]),
        {"columnNameOfCorruptRecord": _CORRUPT},
    )
    return ~F.coalesce((F.size(listed) == 1) & held[_CORRUPT].isNull() & held["v"].isNotNull(), F.lit(False))


def decode_json(df: DataFrame, body: str, schema: RowType | T.StructType | type | str, out: str = "record",
                strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows; with ``strict`` a broken record fails the query instead."""
    return split_rows(check_json(df, body, schema, out, strict=strict))


def encode_json(*columns: str | Column) -> Column:
    """JSON object of the columns; nulls are written, not left out."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false", **FULL_TIMES})


def infer_json(spark: SparkSession, paths: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """Rows of JSON-lines files with a schema taken from all lines: fields united, numbers widened.

    Reads the files twice. Broken lines stay in ``_corrupt_record``.
    """
    return spark.read.option("recursiveFileLookup", str(recursive).lower()).json(paths)
