"""Tables in files: write and read back in a chosen format, partitioned, with a declared schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from enum import Enum

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetlake.schema import RowType, as_row_type, nullable


# The formats a table can have, by the names that Spark gives them.
class TableFormat(Enum):
    AVRO = "avro"
    CSV = "csv"
    DELTA = "delta"
    JSON = "json"
    ORC = "orc"
    PARQUET = "parquet"


_PACKAGES = {TableFormat.AVRO: "spark-avro", TableFormat.DELTA: "delta-spark"}

# The default formats of the text sources cut timestamps to milliseconds.
_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}

# Doubled quotes keep text with quotes, newlines and backslashes. A null is written as \N, as
# an empty field could also be an empty text; text that is exactly \N would come back as null.
_CSV = {
    "header": "true", "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false", **_TIMES,
}

_WRITE_OPTIONS: dict[TableFormat, Mapping[str, str]] = {
    # A CSV file with line breaks inside its values is read by one task, so files are kept small.
    TableFormat.CSV: {**_CSV, "emptyValue": '""', "lineSep": "\n", "maxRecordsPerFile": "1000000"},
    TableFormat.JSON: {"ignoreNullFields": "false", **_TIMES},
}

_READ_OPTIONS: dict[TableFormat, Mapping[str, str]] = {
    TableFormat.CSV: {**_CSV, "emptyValue": "", "multiLine": "true", "mode": "FAILFAST"},
    TableFormat.JSON: {"mode": "FAILFAST", **_TIMES},
}


class MissingPackage(RuntimeError):
    """The format needs a package that is not on the class path."""


def _explain_missing(error: Exception, fmt: TableFormat) -> Exception:
    text = str(error)
    unknown = "DATA_SOURCE_NOT_FOUND" in text or "Failed to find data source" in text
    if fmt in _PACKAGES and unknown:
        return MissingPackage(f"format {fmt.value!r} needs the package {_PACKAGES[fmt]} on the class path")
    return error


def write_table(df: DataFrame, path: str, fmt: TableFormat = TableFormat.PARQUET, partition_by: Sequence[str] = (),
                mode: str = "overwrite", replace_partitions: bool = False, options: Mapping[str, str] | None = None) -> str:
    """Write ``df`` and return ``path``.

    A partitioned write first rebalances by the partition columns: AQE puts the
    rows of small partitions together and splits large ones, so that neither many
    tiny files nor one huge task comes out. ``replace_partitions`` overwrites only
    the partitions that ``df`` holds rows for.
    """
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = df.write.format(fmt.value).mode(mode).options(**_WRITE_OPTIONS.get(fmt, {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if replace_partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    try:
        writer.options(**(options or {})).save(path)
    except (AnalysisException, Py4JJavaError) as error:
        raise _explain_missing(error, fmt) from error
    return path


def read_table(spark: SparkSession, path: str, schema: RowType | T.StructType | type | str,
               fmt: TableFormat = TableFormat.PARQUET) -> DataFrame:
    """Read with the declared schema.

    The schema is not inferred: text formats lose types, and partition values such
    as ``007`` would come back as numbers.
    """
    declared = as_row_type(schema).schema
    reader = spark.read.format(fmt.value).schema(nullable(declared)).options(**_READ_OPTIONS.get(fmt, {}))
    try:
        return reader.load(path).select(*[F.col(f"`{c}`") for c in declared.names])
    except (AnalysisException, Py4JJavaError) as error:
        raise _explain_missing(error, fmt) from error


def snapshot_sink(df: DataFrame, root: str, run_at: str, fmt: TableFormat = TableFormat.PARQUET,
                  inputs: Sequence[str] = ()) -> str:
    """Write to a folder stamped with the run time and return its path.

    The stamp is passed in, so a rerun of the same run meets its own folder and
    fails. A folder inside one of ``inputs`` is refused: the next scan would read it.
    """
    from assetlake.functions.paths import is_inside, join_path

    path = join_path(root, run_at)
    for source in inputs:
        if is_inside(path, source):
            raise ValueError(f"output {path} lies inside the input {source}")
    return write_table(df, path, fmt, mode="errorifexists")
