"""Windowed results of streams, kept in files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assetlake.session import with_conf
from assetlake.streaming.queues import write_batch

_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """``df`` with a watermark; a column without time zone is read in the session's zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def windowed(df: DataFrame, window: Column, by: Sequence[str], *aggregates: Column) -> DataFrame:
    """Aggregates per window and group, with the window as ``start`` and ``end``.

    Session windows are merged in each task before the shuffle if ``latest_windows`` starts the stream, so that a busy
    group sends its sessions and not its rows.
    """
    grouped = df.groupBy(window.alias("_window"), *by).agg(*aggregates)
    return grouped.select(F.col("_window.start").alias("start"), F.col("_window.end").alias("end"), *[c for c in grouped.columns if c != "_window"])


def latest_windows(df: DataFrame, path: str, checkpoint: str, output: str = "update", **trigger: object) -> StreamingQuery:
    """Write every change of a window, one folder per batch; read with ``read_windows``.

    In update mode also the windows that are still open at the end are written.
    """
    with with_conf(df.sparkSession, _SESSIONS):  # a stream keeps the settings that it was started with
        return (
            df.writeStream.outputMode(output).foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def read_windows(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest state of each window from the folders that ``latest_windows`` wrote."""
    values = [c for c in changes.columns if c not in keys and c != "batch"]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_newest"))
    return newest.select(*keys, "_newest.*")


def drop_repeats(df: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str | None = None,
                 spread: int = 1) -> DataFrame:
    """One occurrence of each key; with a delay the state is dropped behind the watermark.

    ``spread`` is for streams with very common keys: repeats are first dropped in that many
    parts of a key, chosen by the other columns, and then over all parts. A common key
    is then worked on by ``spread`` tasks, at the price of up to as many state entries.
    """
    if delay is not None:
        df = df.withWatermark(event_time, delay)

    def unique(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.dropDuplicates(columns) if delay is None else rows.dropDuplicatesWithinWatermark(columns)

    others = [c for c in df.columns if c not in keys]
    if spread > 1 and others:
        part = F.pmod(F.xxhash64(*others), F.lit(spread))
        df = unique(df.withColumn("_part", part), [*keys, "_part"]).drop("_part")
    return unique(df, list(keys))
