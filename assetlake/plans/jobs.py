"""Jobs: functions over a session, and the JSON-lines job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.durations import Duration, duration
from assetlake.functions.records import check_json, infer_json
from assetlake.functions.text import decode_utf8, not_blank, split_lines
from assetlake.plans.runlog import observed
from assetlake.schema import RowType, split_rows
from assetlake.sources.files import read_lines, scan_files
from assetlake.sources.formats import TableFormat, snapshot_sink


@dataclass
class Job:
    """A function that takes the session first; it may return anything."""

    job_id: str
    handler: Callable[..., object]
    period: Duration | None = None

    def __call__(self, spark: SparkSession, *args: object, **kwargs: object) -> object:
        return self.handler(spark, *args, **kwargs)


_jobs: dict[str, Job] = {}


def job(job_id: str | None = None) -> Callable[[Callable], Job]:
    def decorate(handler: Callable) -> Job:
        name = job_id or f"{handler.__module__}.{handler.__qualname__}"
        if name in _jobs:
            raise ValueError(f"job {name} already exists")
        _jobs[name] = Job(name, handler)
        return _jobs[name]

    return decorate


def every(amount: int, unit: str) -> Callable[[Job], Job]:
    """Note how often a job is meant to run; ``job.period`` gives its slots and its trigger."""

    def decorate(target: Job) -> Job:
        target.period = duration(amount, unit)
        return target

    return decorate


def read_records(spark: SparkSession, source: str, schema: RowType | type | str, recursive: bool = True,
                 strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Typed records of the JSON-lines files below a folder, and the broken lines with reasons.

    Blank lines are dropped. Lines come straight from the text reader: no file is
    held in memory as a whole and no Python runs per row.
    """
    lines = read_lines(spark, source, recursive=recursive)
    checked = _checked_lines(lines, schema, strict)
    good, bad = split_rows(checked)
    return good.select("record.*"), bad.select("line", "_reason")


def _checked_lines(lines: DataFrame, schema: RowType | type | str, strict: bool) -> DataFrame:
    if strict:
        lines = lines.withColumn("line", decode_utf8(F.col("line").cast("binary")))
    checked = check_json(lines.filter(not_blank(F.col("line"))), "line", schema, strict=strict)
    not_text = F.when(~F.is_valid_utf8("line"), "not UTF-8")
    return checked.withColumn("_reason", F.coalesce(not_text, F.col("_reason")))


def read_records_whole(spark: SparkSession, source: str, schema: RowType | type | str,
                       strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same from whole files, with strict UTF-8; for files whose bytes must be checked."""
    files = scan_files(spark, source)
    texts = files.select("key", decode_utf8(F.col("body"), strict).alias("text"))
    lines = split_lines(texts, "text").filter(not_blank(F.col("line")))
    good, bad = split_rows(check_json(lines, "line", schema, strict=strict))
    undecoded = texts.filter(F.col("text").isNull()).select("key", F.lit(None).cast("string").alias("line"), F.lit("not UTF-8").alias("_reason"))
    return good.select("record.*"), bad.select("key", "line", "_reason").unionByName(undecoded)


def jsonl_etl(spark: SparkSession, source: str, target: str, run_at: str, schema: RowType | type | str | None = None,
              fmt: TableFormat = TableFormat.PARQUET) -> str:
    """Turn a folder of JSON-lines files into a table stamped with the run time.

    Without a schema it is inferred from all lines, at the price of a second read.
    Broken records go to ``<path>__rejected``.
    """
    if schema is None:
        return snapshot_sink(infer_json(spark, source), target, run_at, fmt, inputs=[source])
    checked = _checked_lines(read_lines(spark, source), schema, strict=False)
    broken = F.col("_reason").isNotNull()
    watched, seen = observed(checked, "jsonl", F.count_if(broken).alias("bad"))
    path = snapshot_sink(watched.filter(~broken).select("record.*"), target, run_at, fmt, inputs=[source])
    if seen.get["bad"]:
        checked.filter(broken).select("line", "_reason").write.mode("errorifexists").parquet(f"{path}__rejected")
    return path
