"""Messages and streams; every stream result is also the result of a batch query."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlake.functions.durations import duration
from assetlake.functions.records import encode_json
from assetlake.operators.ordered import number_rows
from assetlake.queries import query
from assetlake.queries.objects import moment, page_objects, page_url
from assetlake.session import work_path
from assetlake.sources.buckets import Bucket
from assetlake.streaming import windows as w
from assetlake.streaming.events import deliver, put_events, run_subscriptions
from assetlake.streaming.fifo import run_fifo
from assetlake.streaming.pending import pending_stream
from assetlake.streaming.queues import Queue, fifo_sink, write_batch
from assetlake.streaming.queues import pending_messages as pending
from assetlake.tables import table


class Visit(NamedTuple):
    user_id: int
    event_type: str


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def visit_queue(spark: SparkSession, sf_dir: str, model: type = Visit, fifo: bool = False) -> Queue:
    """A queue that has received every event as a message."""
    queue = Queue("visits", work_path(spark, "queue"), model, fifo)
    events = table(spark, sf_dir, "events")
    queue.send(spark, events.select(
        F.col("event_id").cast("string").alias("message_id"), F.col("user_id").cast("string").alias("group_id"),
        F.col("ts").alias("sent_at"), "user_id", "event_type", F.col("props").alias("body"),
    ))
    return queue


@query("message_encode", """
    select event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' as body from events
""")
def message_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", encode_json("user_id", "event_type").alias("body"))


@query("message_decode", "select event_id, user_id, event_type from events")
def message_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies to typed values; a broken body would show as missing values."""
    queue = Queue("visits", "", Visit)
    bodies = table(spark, sf_dir, "events").select("event_id", queue.encode(table(spark, sf_dir, "events")).alias("body"))
    good, _ = queue.decode(bodies)
    return good.select("event_id", "value.*")


@query("queue_receive", """
    select cast(event_id as varchar) as message_id, user_id, event_type from events where event_type <> 'purchase'
""")
def queue_receive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Send all events, acknowledge the purchases, receive the rest."""
    queue = visit_queue(spark, sf_dir)
    bought = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    queue.delete(spark, bought.select(F.col("event_id").cast("string").alias("message_id")))
    return queue.receive(spark).select("message_id", "value.*")


@query("queue_consumer", "select cast(event_id as varchar) as message_id, user_id, event_type from events")
def queue_consumer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of messages handled batch by batch, each batch written under its id."""
    queue, out = visit_queue(spark, sf_dir), work_path(spark, "consumed")

    @queue.consumer()
    def store(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select("message_id", "value.*"), out, batch_id)

    queue.run(spark, work_path(spark, "checkpoint"), max_files=4).awaitTermination()
    return spark.read.schema("message_id string, user_id long, event_type string").parquet(f"{out}/*")


@query("stream_fifo", """
    select cast(user_id as varchar) as group_id, cast(event_id as varchar) as message_id,
        row_number() over (partition by user_id order by ts, cast(event_id as varchar)) as seq from events
""")
def stream_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages numbered per group over all batches of a stream."""
    queue, out = visit_queue(spark, sf_dir, fifo=True), work_path(spark, "fifo")
    queue.consumer()(fifo_sink(out))
    queue.run(spark, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("group_id string, message_id string, seq long").parquet(f"{out}/messages/*")


@query("stream_fifo_state", """
    select cast(user_id as varchar) as group_id, cast(event_id as varchar) as message_id,
        row_number() over (partition by user_id order by ts, cast(event_id as varchar)) as seq from events
""")
def stream_fifo_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five runs of one stream, each with later messages and with repeats of the run before; numbers go on from the checkpoint."""
    events = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("message_id"), F.col("user_id").cast("string").alias("group_id"), F.col("ts").alias("sent_at"),
        F.col("event_type").alias("body"),
    )
    queue, out, checkpoint = Queue("visits", work_path(spark, "queue"), fifo=True), work_path(spark, "fifo"), work_path(spark, "checkpoint")
    first, last = events.agg(F.min("sent_at"), F.max("sent_at")).first()
    step = (last - first) / 5
    for i in range(5):
        low, high = first + i * step, first + (i + 1) * step if i < 4 else last + step
        again = low - step / 10 if i else low
        queue.send(spark, events.filter((F.col("sent_at") >= F.lit(again)) & (F.col("sent_at") < F.lit(high))))
        run_fifo(spark, queue, out, checkpoint).awaitTermination()
    return spark.read.schema("group_id string, message_id string, seq long").parquet(f"{out}/*")


@query("stream_pending", """
    select e.event_id, e.user_id from events e where not exists (select 1 from events p where p.event_type = 'purchase'
        and p.user_id = e.user_id and p.ts >= e.ts and p.ts <= e.ts + interval '6' hour)
""")
def stream_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no purchase of their user answers within six hours, as a join of two streams."""
    events, path = table(spark, sf_dir, "events"), work_path(spark, "answers")
    # A day of silence at the end: heartbeats without a user let the last events come out.
    beat = events.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts"))
    columns = events.select("event_id", "user_id", "ts", "event_type")
    columns.write.parquet(f"{path}/log")
    for kind in ("view", "purchase"):
        beat.withColumn("event_type", F.lit(kind)).write.mode("append").parquet(f"{path}/log")
    log = spark.readStream.schema(columns.schema).parquet(f"{path}/log").withColumn("ts", F.col("ts").cast("timestamp"))
    answers = log.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    waiting = pending_stream(log, answers, ["user_id"], "ts", "at", "6 hours", "1 hour").select("event_id", "user_id")
    w.latest_windows(waiting, f"{path}/out", work_path(spark, "checkpoint"), "append").awaitTermination()
    return spark.read.schema(waiting.schema).parquet(f"{path}/out/*")


@query("pending_messages", """
    with l as (select user_id m, ts, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) rn,
        max(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id) deleted
        from events where ts <= timestamp '2024-01-10 00:00:00')
    select m as message_id from l where rn = 1 and deleted = 0 and ts + interval '30' minute <= timestamp '2024-01-10 00:00:00'
""")
def pending_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    deadline = F.col("ts") + F.expr("interval 30 minutes")
    return pending(events, "user_id", ["ts", "event_id"], deadline, F.col("event_type") == "purchase", moment("2024-01-10 00:00:00"))


@query("fifo_order", """
    select user_id as grp, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events
""")
def fifo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), "event_id", "ts")
    return number_rows(events, ["grp"], ["ts", "event_id"], "seq").drop("ts")


@query("object_event_stream", """
    select 'create' as scope, url as key, octet_length(encode(html)) as size from pages
    union all select 'create', url, octet_length(encode(html)) + 1 from pages where starts_with(url, 'https://')
    union all select 'delete', url, null from pages where starts_with(url, 'http://')
""")
def object_event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts, overwrites and deletes of a bucket delivered to two subscribers with prefixes."""
    bucket, out = Bucket("pages", work_path(spark, "bucket")), work_path(spark, "events")
    pages = page_objects(spark, sf_dir)
    secure, plain = F.col("url").startswith("https://"), F.col("url").startswith("http://")
    bucket.put(spark, pages)
    bucket.put(spark, pages.filter(secure).withColumn("body", F.concat("body", F.lit("x"))))
    bucket.delete(spark, pages.filter(plain).select("key"))

    @bucket.on("create", "https://")
    def created(events: DataFrame, batch_id: int) -> None:
        write_batch(events, f"{out}/secure", batch_id)

    @bucket.on(["create", "delete"], "http://")
    def any_change(events: DataFrame, batch_id: int) -> None:
        write_batch(events, f"{out}/plain", batch_id)

    run_subscriptions(put_events(spark, bucket), bucket, work_path(spark, "checkpoint")).awaitTermination()
    return spark.read.schema("scope string, key string, size long").parquet(f"{out}/*/*").withColumn("key", page_url(F.col("key")))


@query("slot_agg", """
    select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as slot, event_type, count(*) as n,
        sum(cast(value as decimal(18,2))) as total from events group by 1, 2
""")
def slot_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "events").groupBy(duration(1, "day").window("ts").alias("slot"), "event_type")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)")
    return slots.agg(F.count("*").alias("n"), total.alias("total")).withColumn("slot", F.col("slot.start"))


def _run_windows(spark: SparkSession, df: DataFrame, keys: list[str], output: str = "update") -> DataFrame:
    """Run a windowed stream over all input and read its newest state per window."""
    path = work_path(spark, "windows")
    w.latest_windows(df, path, work_path(spark, "checkpoint"), output).awaitTermination()
    changes = spark.read.schema(df.schema).parquet(f"{path}/*").withColumn(
        "batch", F.regexp_extract(F.col("_metadata.file_path"), "batch=(\\d+)", 1).cast("bigint")
    )
    return w.read_windows(changes, keys)


@query("stream_slot_agg", """
    select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as slot, event_type, count(*) as n,
        sum(cast(value as decimal(18,2))) as total from events group by 1, 2
""")
def stream_slot_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = w.event_time(event_stream(spark, sf_dir), "ts", "1 day")
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total")
    counted = w.windowed(events, F.window("ts", "1 day"), ["event_type"], F.count("*").alias("n"), total)
    rows = _run_windows(spark, counted, ["start", "event_type"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("slot"), "event_type", "n", "total")


@query("stream_sliding", """
    select slot, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts, timestamp '1970-01-01'),
        time_bucket(interval '1 hour', ts, timestamp '1970-01-01') - interval '1 hour']) as slot from events) t group by 1
""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = w.event_time(event_stream(spark, sf_dir), "ts", "1 day")
    counted = w.windowed(events, F.window("ts", "2 hours", "1 hour"), [], F.count("*").alias("n"))
    rows = _run_windows(spark, counted, ["start"])
    return rows.select(F.col("start").cast("timestamp_ntz").alias("slot"), "n")


SESSION_SQL = """
    select user_id, min(ts) as first_at, max(ts) as last_at, count(*) as n from (
        select *, sum(b) over (partition by user_id order by ts, event_id) sid from (
            select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30' minute
                then 0 else 1 end b from events)) group by user_id, sid
"""


@query("stream_session", SESSION_SQL)
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = w.event_time(event_stream(spark, sf_dir), "ts", "1 day")
    spans = [F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("n")]
    counted = w.windowed(events, F.session_window("ts", "30 minutes"), ["user_id"], *spans)
    rows = _run_windows(spark, counted, ["start", "user_id"], output="complete")
    return rows.select("user_id", F.col("first_at").cast("timestamp_ntz").alias("first_at"), F.col("last_at").cast("timestamp_ntz").alias("last_at"), "n")


@query("stream_dedup", "select user_id, event_type from events group by 1, 2")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and event type out of the whole stream."""
    path = work_path(spark, "dedup")
    events = event_stream(spark, sf_dir).select("user_id", "event_type", "event_id")
    unique = w.drop_repeats(events, ["user_id", "event_type"], spread=4).select("user_id", "event_type")
    w.latest_windows(unique, path, work_path(spark, "checkpoint"), "append").awaitTermination()
    return spark.read.schema(unique.schema).parquet(f"{path}/*")


@query("event_fanout", """
    select 'errors' as subscriber, event_id from events where event_type = 'error'
    union all select 'everything', event_id from events
""")
def event_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One set of events for two subscribers: creations under ``error/`` and everything."""
    out = work_path(spark, "fanout")
    events = table(spark, sf_dir, "events").select(
        F.lit("create").alias("scope"), F.concat_ws("/", "event_type", "event_id").alias("key"), "event_id"
    )
    bucket = Bucket("events", out)
    bucket.on("create", "error/")(lambda df, i: write_batch(df.select(F.lit("errors").alias("subscriber"), "event_id"), f"{out}/a", i))
    bucket.on(["create", "delete"])(lambda df, i: write_batch(df.select(F.lit("everything").alias("subscriber"), "event_id"), f"{out}/b", i))
    deliver(events, bucket.subscriptions)
    return spark.read.schema("subscriber string, event_id long").parquet(f"{out}/*/*")
