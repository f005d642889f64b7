"""Messages that nobody has acknowledged in time, as a join of two streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending_stream(messages: DataFrame, acks: DataFrame, on: Sequence[str], sent: str, acked: str, within: str, delay: str) -> DataFrame:
    """Messages without an acknowledgement from ``sent`` to ``sent`` + ``within``; both sides may be ``delay`` late.

    A left outer join of the two streams with a bound on the time between them: once both watermarks have passed that
    bound a message leaves the state, and comes out if nothing matched it. The state therefore holds what
    was sent within the bound and the delay, and not the log. Rows whose ``on`` columns are null only move the
    watermarks: a source that is quiet can send such heartbeats, so that the last messages come out.
    """
    # Spark moves filters on other columns below a watermark, also the one that an equality implies; heartbeats would
    # not be seen there. A struct is never null, and the filter at the end looks at the time as well.
    left = messages.withColumn("_key", F.struct(*on)).withWatermark(sent, delay)
    right = acks.select(F.struct(*on).alias("_ack_key"), F.col(acked).alias("_acked")).withWatermark("_acked", delay)
    in_time = (F.col("_acked") >= F.col(sent)) & (F.col("_acked") <= F.col(sent) + F.expr(f"interval {within}"))
    joined = left.join(right, [F.col("_key") == F.col("_ack_key"), in_time], "left_outer")
    known = F.array_compact(F.array(*[F.col(c).cast("string") for c in (*on, sent)]))
    return joined.filter(F.col("_acked").isNull() & (F.size(known) == len(on) + 1)).select(*messages.columns)
