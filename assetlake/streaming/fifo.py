"""Order of messages inside their groups, kept over batches in the state of the stream."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from assetlake.session import with_conf
from assetlake.streaming.queues import Queue, write_batch

_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: State on local disk with changelogs in the checkpoint, so that it may outgrow memory and survives lost executors.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": _ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class _Numbers(StatefulProcessor):
    """The last number given in a group.

    It is called once for every group of a batch, so it takes plain rows, reads the state once and writes it once:
    a pandas frame costs more than all of that.
    """

    def __init__(self, order: Sequence[str], out: str):
        self.order, self.out = list(order), out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        first = next(rows)
        at = [first.__fields__.index(name) for name in self.order]

        def place(row: tuple) -> list[object]:  # values, and missing ones behind them
            return [x for v in map(row.__getitem__, at) for x in ((True, None) if v is None or v != v else (False, v))]

        batch = sorted(map(tuple, chain([first], rows)), key=place)
        before = self.last.get()
        last = before[0] if before is not None else 0
        self.last.update((last + len(batch),))
        numbered = Row(*first.__fields__, self.out)
        batch.reverse()
        while batch:  # what was passed on is let go
            last += 1
            yield numbered(*batch.pop(), last)

    def close(self) -> None:
        pass


class _FrameNumbers(_Numbers):
    """The same for streams that began with pandas frames: Spark lets their state be used in no other way."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last = self.last.get()[0] if self.last.exists() else 0
        batch[self.out] = range(last + 1, last + len(batch) + 1)
        self.last.update((last + len(batch),))
        yield batch


def began_with_frames(spark: SparkSession, checkpoint: str) -> bool:
    """Whether the stream of a checkpoint numbers pandas frames, as all did once."""
    operators = spark.read.format("state-metadata").load(checkpoint)
    return operators.where("operatorName = 'transformWithStateInPandasExec'").limit(1).count() > 0


def fifo_numbers(
    messages: DataFrame, group: str, order: Sequence[str], message: str, seen_for: str = "7 days", out: str = "seq", frames: bool = False
) -> DataFrame:
    """A stream of messages numbered from 1 in their group: by batch, and by ``order`` inside a batch.

    The state is one number a group, so a batch costs what its messages cost, however many came before, and a restart from
    the checkpoint goes on with the same numbers. A message that comes again within ``seen_for`` is
    dropped; ids are kept in a state of their own, dealt by id, so that a busy group is no burden there. That state is
    kept by time of arrival: nothing is late, whatever a message says about when it was sent.

    The messages of one group in one batch are sorted in one task; bound batches by ``max_files``.
    ``frames`` is for a stream that ``began_with_frames``.
    """
    arrived = messages.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", seen_for)
    unique = arrived.dropDuplicatesWithinWatermark([message]).drop("_arrived")
    # Instants pass Python as microseconds: their order there is that of time, also when clocks are set back.
    instants = [f.name for f in unique.schema.fields if isinstance(f.dataType, T.TimestampType) and f.name != group]
    passing = unique.withColumns({name: F.unix_micros(name) for name in instants})
    schema = T.StructType([*passing.schema.fields, T.StructField(out, T.LongType())])
    grouped = passing.groupBy(group)
    if frames:
        numbered = grouped.transformWithStateInPandas(_FrameNumbers(order, out), schema, "append", "none")
    else:
        numbered = grouped.transformWithState(_Numbers(order, out), schema, "append", "none")
    return numbered.withColumns({name: F.timestamp_micros(name) for name in instants})


def run_fifo(spark: SparkSession, queue: Queue, sink: str, checkpoint: str, max_files: int | None = None, seen_for: str = "7 days",
             **trigger: object) -> StreamingQuery:
    """Number the queue's messages into ``sink``, one folder a batch; a repeated batch replaces itself."""
    frames = began_with_frames(spark, checkpoint)
    numbered = fifo_numbers(queue.stream(spark, max_files), "group_id", ["sent_at", "message_id"], "message_id", seen_for, frames=frames)
    with with_conf(spark, STATE_CONF):
        return (
            numbered.writeStream.outputMode("append").foreachBatch(lambda batch, i: write_batch(batch, sink, i))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )
