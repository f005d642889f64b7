"""Typed message queues kept as Parquet folders, read as batches or as streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from assetlake.functions.paths import join_path
from assetlake.functions.records import check_json, encode_json
from assetlake.operators.ordered import number_rows
from assetlake.session import is_missing_path
from assetlake.schema import as_row_type

MESSAGE_SCHEMA = "message_id string, group_id string, sent_at timestamp, body string"


@dataclass(eq=False)
class Queue:
    """Messages of one type below ``root``. ``model`` is ``str`` (raw text) or a declared row type."""

    queue_id: str
    root: str
    model: type | str = str
    fifo: bool = False
    consumers: list[Callable] = field(default_factory=list)

    @property
    def messages_path(self) -> str:
        return join_path(self.root, "messages")

    @property
    def log_path(self) -> str:
        return join_path(self.root, "log")

    def encode(self, df: DataFrame) -> Column:
        """Message body of a row: the ``body`` column as it is, or the model's fields as JSON."""
        if self.model is str:
            return F.col("body").cast("string")
        return encode_json(*as_row_type(self.model).schema.names)

    def send(self, spark: SparkSession, rows: DataFrame | str | dict, group_id: str | None = None) -> None:
        """Append messages: a DataFrame of fields (or of ``body``), one text, or one dictionary."""
        if isinstance(rows, str):
            rows = spark.range(1).select(F.lit(rows).alias("body"))
        elif isinstance(rows, dict):
            rows = spark.createDataFrame([rows], as_row_type(self.model).schema)
        columns = rows.columns
        group = F.col("group_id") if "group_id" in columns and group_id is None else F.lit(group_id)
        rows.select(
            (F.col("message_id") if "message_id" in columns else F.uuid()).cast("string").alias("message_id"),
            group.cast("string").alias("group_id"),
            (F.col("sent_at") if "sent_at" in columns else F.current_timestamp()).cast("timestamp").alias("sent_at"),
            self.encode(rows).alias("body"),
        ).write.mode("append").parquet(self.messages_path)

    def decode(self, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(good, bad) messages; good ones carry ``value``, bad ones ``_reason``."""
        checked = self.check(messages)
        bad = F.col("_reason").isNotNull()
        return checked.filter(~bad).drop("_reason"), checked.filter(bad).drop("value")

    def check(self, messages: DataFrame) -> DataFrame:
        if self.model is str:
            return messages.withColumns({"value": F.col("body"), "_reason": F.lit(None).cast("string")})
        return check_json(messages, "body", self.model, out="value")

    def stream(self, spark: SparkSession, max_files: int | None = None) -> DataFrame:
        """All messages as a stream; files arrive in the order they were sent."""
        reader = spark.readStream.schema(MESSAGE_SCHEMA)
        if max_files is not None:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(self.messages_path)

    def messages(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(MESSAGE_SCHEMA).parquet(self.messages_path)

    def _events(self, spark: SparkSession) -> DataFrame | None:
        schema = "message_id string, at timestamp, deadline timestamp, deleted boolean"
        try:
            return spark.read.schema(schema).parquet(self.log_path)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            return None

    def _note(self, ids: DataFrame, seconds: int | None, deleted: bool) -> None:
        now = F.current_timestamp()
        deadline = F.lit(None).cast("timestamp") if seconds is None else now + F.make_dt_interval(secs=F.lit(seconds))
        ids.select("message_id", now.alias("at"), deadline.alias("deadline"), F.lit(deleted).alias("deleted")).write.mode(
            "append"
        ).parquet(self.log_path)

    def delete(self, spark: SparkSession, ids: DataFrame | str) -> None:
        """Acknowledge messages by their id: they are not received again."""
        self._note(_ids(spark, ids), None, True)

    def change_visibility(self, spark: SparkSession, ids: DataFrame | str, seconds: int) -> None:
        """Hide messages for that many seconds from now; 0 shows them at once."""
        self._note(_ids(spark, ids), seconds, False)

    def pending(self, spark: SparkSession, at: Column | None = None) -> DataFrame:
        """Messages that are neither deleted nor hidden at a time (default: now)."""
        at = F.current_timestamp() if at is None else at
        sent = self.messages(spark).filter(F.col("sent_at") <= at)
        events = self._events(spark)
        if events is None:
            return sent
        hidden = hidden_messages(events, "message_id", "at", "deadline", F.col("deleted"), at)
        return sent.join(hidden, "message_id", "left_anti")

    def receive(self, spark: SparkSession) -> DataFrame:
        """Pending messages, decoded; a broken body fails the query."""
        messages = self.pending(spark)
        if self.model is str:
            return messages.withColumn("value", F.col("body"))
        return check_json(messages, "body", self.model, out="value", strict=True).drop("_reason")

    def consumer(self) -> Callable:
        """Decorator: call the function with the DataFrame of each batch and its id.

        The function is returned unchanged.
        """

        def decorate(handler: Callable[[DataFrame, int], object]) -> Callable:
            self.consumers.append(handler)
            return handler

        return decorate

    def run(self, spark: SparkSession, checkpoint: str, quarantine: str | None = None, max_files: int | None = None,
            **trigger: object) -> StreamingQuery:
        """Start the consumers.

        A batch is committed after all handlers have returned; a handler that fails
        stops the stream and gets the same batch with the same id again, so sinks
        must be idempotent per batch (see ``write_batch``). Without a quarantine
        folder a broken message fails its batch.
        """

        def deliver(batch: DataFrame, batch_id: int) -> None:
            checked = self.check(batch)
            if quarantine is None:
                checked = checked.withColumn(
                    "value", F.when(F.col("_reason").isNotNull(), F.raise_error(F.concat(F.lit("broken message: "), F.col("_reason")))).otherwise(F.col("value"))
                )
            checked = checked.persist()
            try:
                if quarantine is not None:
                    write_batch(checked.filter(F.col("_reason").isNotNull()).drop("value"), quarantine, batch_id)
                    good = checked.filter(F.col("_reason").isNull())
                else:
                    good = checked
                good = good.drop("_reason")
                if self.fifo:
                    good = number_rows(good, ["group_id"], ["sent_at", "message_id"], "seq").sortWithinPartitions("group_id", "seq")
                for handler in self.consumers:
                    handler(good, batch_id)
            finally:
                checked.unpersist()

        return (
            self.stream(spark, max_files).writeStream.foreachBatch(deliver)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        )


def _ids(spark: SparkSession, ids: DataFrame | str) -> DataFrame:
    return ids if isinstance(ids, DataFrame) else spark.range(1).select(F.lit(ids).alias("message_id"))


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch to its own folder; a repeated batch replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def hidden_messages(events: DataFrame, message: str, at_column: str, deadline: str, deleted: Column, at: Column) -> DataFrame:
    """Ids of messages that are deleted, or whose newest deadline lies behind ``at``.

    One aggregation with partial results per task: a message with very many log rows
    is no burden on one task.
    """
    past = events.filter(F.col(at_column) <= at)
    state = past.groupBy(message).agg(
        F.max_by(deadline, at_column).alias("_deadline"), F.max(deleted).alias("_deleted")
    )
    return state.filter(F.col("_deleted") | (F.col("_deadline") > at)).select(message)


def pending_messages(events: DataFrame, message: str, order: Sequence[str], deadline: Column, deleted: Column, at: Column) -> DataFrame:
    """Ids from a receive/delete log that can be received again at ``at``."""
    past = events.filter(F.col(order[0]) <= at)
    state = past.groupBy(message).agg(
        F.max_by(deadline, F.struct(*order)).alias("_deadline"), F.max(deleted).alias("_deleted")
    )
    return state.filter(~F.col("_deleted") & (F.col("_deadline") <= at)).select(F.col(message).alias("message_id"))


def fifo_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Handler that continues each group's numbering over batches.

    A message's number is its place in the batch plus the messages of its group in
    earlier batches, which are counted from what the sink holds. A repeated batch
    counts only batches before it and therefore gets the same numbers.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbered = number_rows(batch, ["group_id"], ["sent_at", "message_id"], "_place")
        counts = f"{path}/counts"
        try:
            earlier = spark.read.schema("group_id string, n bigint, batch bigint").parquet(counts).filter(F.col("batch") < batch_id)
        except AnalysisException as error:
            if not is_missing_path(error):
                raise
            earlier = spark.createDataFrame([], "group_id string, n bigint, batch bigint")
        before = earlier.groupBy("group_id").agg(F.sum("n").alias("_before")).withColumnRenamed("group_id", "_group")
        joined = numbered.join(before, numbered["group_id"].eqNullSafe(before["_group"]), "left")
        out = joined.withColumn("seq", F.col("_place") + F.coalesce("_before", F.lit(0))).drop("_place", "_before", "_group")
        write_batch(out, f"{path}/messages", batch_id)
        write_batch(batch.groupBy("group_id").agg(F.count("*").alias("n")), counts, batch_id)

    return write
