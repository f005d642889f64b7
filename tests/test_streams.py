from __future__ import annotations

import json
import os
from typing import NamedTuple

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from assetlake.sources import Bucket
from assetlake.streaming import windows as w
from assetlake.streaming.events import deliver, file_events, put_events, run_subscriptions
from assetlake.streaming.queues import Queue, fifo_sink, write_batch


class Visit(NamedTuple):
    user: int
    page: str | None


@pytest.fixture
def queue(tmp_path):
    return Queue("visits", str(tmp_path / "queue"), Visit)


def test_text_queue_round_trip(spark, tmp_path):
    queue = Queue("texts", str(tmp_path / "q"))
    for text in ('{"not": "decoded"}', "plain", "", "two\nlines"):
        queue.send(spark, text)
    assert sorted(r["value"] for r in queue.receive(spark).collect()) == ["", "plain", "two\nlines", '{"not": "decoded"}']


def test_model_queue_round_trip_keeps_nulls(spark, queue):
    queue.send(spark, {"user": 1, "page": None})
    message = queue.receive(spark).first()
    assert message["body"] == '{"user":1,"page":null}' and message["value"].asDict() == {"user": 1, "page": None}
    assert message["message_id"]


def test_delete_and_visibility(spark, queue):
    queue.send(spark, spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 3, "z")], "message_id string, user long, page string"))

    def visible(at=None):
        return sorted(r["message_id"] for r in queue.pending(spark, at).collect())

    assert visible() == ["a", "b", "c"]
    queue.delete(spark, "a")
    queue.change_visibility(spark, "b", 3600)
    assert visible() == ["c"]
    assert visible(F.current_timestamp() + F.expr("interval 2 hours")) == ["b", "c"]
    queue.change_visibility(spark, "b", 0)
    assert visible() == ["b", "c"]
    queue.delete(spark, "unknown")
    assert queue.receive(spark).count() == 2


def test_broken_body_fails_receive_and_can_be_quarantined(spark, queue, tmp_path):
    Queue("raw", queue.root).send(spark, '{"page":"no user"}')
    queue.send(spark, {"user": 1, "page": "p"})
    with pytest.raises(Exception, match="broken record"):
        queue.receive(spark).collect()
    got = []
    queue.consumer()(lambda batch, i: got.extend(r["value"]["user"] for r in batch.collect()))
    bad = str(tmp_path / "bad")
    queue.run(spark, str(tmp_path / "cp"), quarantine=bad).awaitTermination()
    assert got == [1]
    assert spark.read.parquet(bad).first()["_reason"] == "user: required value is missing"
    with pytest.raises(Exception, match="broken message"):
        queue.run(spark, str(tmp_path / "cp2")).awaitTermination()


def test_rerun_without_new_messages_delivers_nothing(spark, queue, tmp_path):
    batches = []

    @queue.consumer()
    def handler(batch, batch_id):
        batches.append((batch_id, batch.count()))

    queue.send(spark, {"user": 1, "page": "p"})
    for _ in range(2):
        queue.run(spark, str(tmp_path / "cp")).awaitTermination()
    assert batches == [(0, 1)]
    queue.send(spark, {"user": 2, "page": "p"})
    queue.run(spark, str(tmp_path / "cp")).awaitTermination()
    assert batches == [(0, 1), (1, 1)] and handler is queue.consumers[0]


def test_failed_batch_comes_again_and_replaces_its_output(spark, queue, tmp_path):
    out, attempts = str(tmp_path / "out"), []

    @queue.consumer()
    def fragile(batch, batch_id):
        write_batch(batch.select("message_id"), out, batch_id)
        attempts.append(batch_id)
        if len(attempts) == 1:
            raise RuntimeError("after the write")

    queue.send(spark, spark.range(5).select(F.col("id").alias("user"), F.lit("p").alias("page")))
    with pytest.raises(Exception, match="after the write"):
        queue.run(spark, str(tmp_path / "cp")).awaitTermination()
    queue.run(spark, str(tmp_path / "cp")).awaitTermination()
    assert attempts == [0, 0] and spark.read.parquet(out).count() == 5


def test_fifo_numbers_continue_over_batches(spark, tmp_path):
    queue, out = Queue("f", str(tmp_path / "q"), fifo=True), str(tmp_path / "out")
    queue.consumer()(fifo_sink(out))
    for part in range(3):
        rows = spark.range(part * 4, part * 4 + 4).select(
            F.format_string("m%02d", "id").alias("message_id"), F.when(F.col("id") % 2 == 0, "even").alias("group_id"),
            F.timestamp_seconds("id").alias("sent_at"), F.lit("b").alias("body"),
        )
        queue.send(spark, rows)
        queue.run(spark, str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(f"{out}/messages").orderBy("message_id").collect()
    assert [r["seq"] for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    again = spark.createDataFrame([(r["message_id"], r["group_id"], r["sent_at"]) for r in rows if r["batch"] == 1], "message_id string, group_id string, sent_at timestamp")
    before = rows_of(spark.read.parquet(f"{out}/messages").select("message_id", "seq"))
    fifo_sink(out)(again, 1)
    assert rows_of(spark.read.parquet(f"{out}/messages").select("message_id", "seq")) == before


def drain(spark, stream, path, checkpoint):
    w.latest_windows(stream, path, checkpoint, "append").awaitTermination()
    return sorted((r["scope"], r["key"]) for r in spark.read.schema(stream.schema).parquet(f"{path}/*").collect())


def test_new_files_are_events_and_overwritten_files_are_not(spark, tmp_path):
    root = tmp_path / "b"
    (root / "in" / "deep").mkdir(parents=True)
    (root / "in" / "a").write_bytes(b"1")
    (root / "in" / "deep" / "b").write_bytes(b"22")
    (root / "other").mkdir()
    (root / "other" / "c").write_bytes(b"3")
    bucket, out, cp = Bucket("b", str(root)), str(tmp_path / "out"), str(tmp_path / "cp")
    stream = file_events(spark, bucket, "in")
    assert drain(spark, stream, out, cp) == [("create", "in/a"), ("create", "in/deep/b")]
    (root / "in" / "a").write_bytes(b"changed")
    os.utime(root / "in" / "a", (2_000_000_000, 2_000_000_000))
    (root / "in" / "new").write_bytes(b"4")
    assert drain(spark, stream, out, cp) == [("create", "in/a"), ("create", "in/deep/b"), ("create", "in/new")]


def test_put_log_reports_overwrites_and_deletes(spark, tmp_path):
    bucket = Bucket("b", str(tmp_path / "b"))
    bucket.put(spark, "a/x", "1")
    bucket.put(spark, "a/x", "2")
    bucket.delete(spark, "a/x")
    bucket.put(spark, "c", "3")
    calls = []
    bucket.on("create", "a/")(lambda df, i: calls.append(("created", sorted((r["key"], r["size"]) for r in df.collect()))))
    (bucket / "a").on(["delete"])(lambda df, i: calls.append(("deleted", [(r["key"], r["size"]) for r in df.collect()])))
    run_subscriptions(put_events(spark, bucket), bucket, str(tmp_path / "cp")).awaitTermination()
    assert calls == [("created", [("a/x", 1), ("a/x", 1)]), ("deleted", [("a/x", None)])]
    with pytest.raises(ValueError):
        bucket.on("rename")


def test_fan_out_keeps_the_order_of_subscribers(spark, tmp_path):
    bucket, calls = Bucket("b", str(tmp_path)), []
    for name in ("first", "second"):
        bucket.on("create")(lambda df, i, name=name: calls.append((name, i, df.count())))
    deliver(spark.createDataFrame([("create", "k", "e", 1)], "scope string, key string, etag string, size long"), bucket.subscriptions, 7)
    assert calls == [("first", 7, 1), ("second", 7, 1)]


def test_append_mode_holds_back_open_windows(spark, sf_dir, tmp_path):
    from assetlake.queries.streams import event_stream
    from assetlake.tables import table

    events = w.event_time(event_stream(spark, sf_dir), "ts", "1 day")
    counted = w.windowed(events, F.window("ts", "1 day"), [], F.count("*").alias("n"))
    path = str(tmp_path / "out")
    w.latest_windows(counted, path, str(tmp_path / "cp"), "append").awaitTermination()
    closed = spark.read.schema(counted.schema).parquet(f"{path}/*").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
    batch = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    all_windows = rows_of(batch.select(F.col("w.start").alias("start"), "n"))
    assert rows_of(closed) <= all_windows and 0 < closed.count() < sum(all_windows.values())


@pytest.mark.parametrize("spread", [1, 3])
def test_repeats_within_the_watermark(spark, tmp_path, spread):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", 0), ("a", 5), ("b", 10), ("a", 20)]
    df = spark.createDataFrame(rows, "id string, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    unique = w.drop_repeats(stream, ["id"], "ts", "1 hour", spread)
    w.latest_windows(unique, path, str(tmp_path / "cp"), "append").awaitTermination()
    assert sorted(r["id"] for r in spark.read.schema(df.schema).parquet(f"{path}/*").collect()) == ["a", "b"]


def test_numbers_go_on_over_batches_and_restarts(spark, tmp_path):
    from assetlake.streaming.fifo import run_fifo

    queue, out, checkpoint = Queue("q", str(tmp_path / "q")), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "message_id string, group_id string, sent_at timestamp, body string"
    sent, progress = [], []
    for batch in range(5):
        rows = [(f"{batch}-{i}", None if i % 5 == 4 else f"g{i % 3}", 1_000 * batch + (i * 7) % 20) for i in range(20)]
        sent.append(rows)
        again = sent[-2][:6] if batch else []
        frame = spark.createDataFrame([(m, g, t, "x") for m, g, t in rows + again], "message_id string, group_id string, t long, body string")
        queue.send(spark, frame.withColumn("sent_at", F.timestamp_seconds("t")).select(*[f.split()[0] for f in schema.split(", ")]))
        query = run_fifo(spark, queue, out, checkpoint)
        query.awaitTermination()
        progress.append(query.lastProgress)
    got = {(r["group_id"], r["message_id"]): r["seq"] for r in spark.read.parquet(f"{out}/*").collect()}
    want, count = {}, {}
    for rows in sent:
        for m, g, _ in sorted(rows, key=lambda r: (r[2], r[0])):
            count[g] = count.get(g, 0) + 1
            want[g, m] = count[g]
    assert got == want
    assert spark.read.parquet(f"{out}/*").count() == 100
    # One number a group is all that the numbering keeps, however many batches came before.
    kept = [min(s["numRowsTotal"] for s in (p["stateOperators"] if isinstance(p, dict) else json.loads(p.json)["stateOperators"])) for p in progress if p]
    assert kept and max(kept) <= 4 + 1


def test_numbering_a_group_reads_and_writes_its_state_once():
    from pyspark.sql import Row

    from assetlake.streaming.fifo import _Numbers

    class State:
        def __init__(self):
            self.value, self.calls = None, []

        def __getattr__(self, name):
            def call(*given):
                self.calls.append(name)
                if name == "update":
                    self.value = given[0]
                return self.value if name == "get" else self.value is not None

            return call

    class Handle:
        state = State()

        def getValueState(self, name, schema):
            return self.state

    numbers = _Numbers(["at", "m"], "seq")
    numbers.init(Handle())
    first = [Row(m="b", at=None), Row(m=None, at=5), Row(m="c", at=1), Row(m="a", at=5), Row(m="a", at=None)]
    got = list(numbers.handleInputRows(("g",), iter(first), None))
    assert [(r.m, r.at, r.seq) for r in got] == [("c", 1, 1), ("a", 5, 2), (None, 5, 3), ("a", None, 4), ("b", None, 5)]
    (more,) = numbers.handleInputRows(("g",), iter([Row(m="d", at=0)]), None)
    assert more.seq == 6 and Handle.state.value == (6,)
    assert Handle.state.calls == ["get", "update"] * 2


def test_a_stream_that_began_with_frames_goes_on(spark, tmp_path):
    from assetlake.session import with_conf
    from assetlake.streaming import fifo

    queue, out, checkpoint = Queue("q", str(tmp_path / "q")), str(tmp_path / "out"), str(tmp_path / "cp")

    def send(ids):
        queue.send(spark, spark.createDataFrame([(f"m{i}", f"g{i % 2}", i, "x") for i in ids], "message_id string, group_id string, t long, body string").withColumn("sent_at", F.timestamp_seconds("t")))

    send(range(6))
    assert not fifo.began_with_frames(spark, checkpoint)
    old = fifo.fifo_numbers(queue.stream(spark), "group_id", ["sent_at", "message_id"], "message_id", frames=True)
    with with_conf(spark, fifo.STATE_CONF):
        old.writeStream.foreachBatch(lambda b, i: write_batch(b, out, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert fifo.began_with_frames(spark, checkpoint)
    send(range(4, 10))
    fifo.run_fifo(spark, queue, out, checkpoint).awaitTermination()
    got = {(r["message_id"], r["seq"]) for r in spark.read.parquet(f"{out}/*").collect()}
    assert got == {(f"m{i}", i // 2 + 1) for i in range(10)}


def test_numbers_follow_time_when_clocks_are_set_back(spark, tmp_path):
    from assetlake.session import with_conf
    from assetlake.streaming.fifo import run_fifo

    queue, out = Queue("q", str(tmp_path / "q")), str(tmp_path / "out")
    at = {"first": 1_699_162_200, "second": 1_699_164_900}  # 01:30 before, 01:15 after the change
    with with_conf(spark, {"spark.sql.session.timeZone": "America/New_York"}):
        rows = spark.createDataFrame([(m, "g", t, "x") for m, t in at.items()], "message_id string, group_id string, t long, body string")
        queue.send(spark, rows.withColumn("sent_at", F.timestamp_seconds("t")))
        run_fifo(spark, queue, out, str(tmp_path / "cp")).awaitTermination()
        got = spark.read.parquet(f"{out}/*").select("message_id", "seq", F.unix_seconds("sent_at").alias("t")).collect()
    assert {(r["message_id"], r["seq"], r["t"]) for r in got} == {("first", 1, at["first"]), ("second", 2, at["second"])}


def test_pending_stream_equals_the_queue_and_forgets(spark, tmp_path):
    from assetlake.streaming.pending import pending_stream

    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    schema = "message_id string, sent_at timestamp, at timestamp"
    rows, states = [], []
    for part in range(8):
        batch = []
        for i in range(50):
            t = part * 3_600 + i * 60
            batch.append((f"{part}-{i}", t, None))
            if i % 3 == 0:
                batch.append((f"{part}-{i}", None, t + (600 if i % 2 else 3_000)))  # in time, or too late
        batch += [(None, part * 3_600 + 3_599, None), (None, None, part * 3_600 + 3_599)]
        rows += batch
        frame = spark.createDataFrame(batch, "message_id string, s long, a long")
        frame = frame.select("message_id", F.timestamp_seconds(F.col("s") + 10**9).alias("sent_at"), F.timestamp_seconds(F.col("a") + 10**9).alias("at"))
        frame.coalesce(1).write.mode("append").parquet(path)
        log = spark.readStream.schema(schema).parquet(path)
        messages, acks = log.filter("at is null").select("message_id", "sent_at"), log.filter("sent_at is null").select("message_id", "at")
        waiting = pending_stream(messages, acks, ["message_id"], "sent_at", "at", "20 minutes", "5 minutes")
        query = w.latest_windows(waiting, out, str(tmp_path / "checkpoint"), "append")
        query.awaitTermination()
        states.append(query.recentProgress[-1])
    acked = {m for m, s, a in rows if a is not None and m is not None and int(m.split("-")[1]) % 2}
    sent = {m for m, s, a in rows if s is not None and m is not None and s < 7 * 3_600 + 3_599 - 25 * 60}
    got = {r["message_id"] for r in spark.read.schema("message_id string, sent_at timestamp").parquet(f"{out}/*").collect()}
    assert sent - acked <= got and not got & acked
    held = [sum(o["numRowsTotal"] for o in (p if isinstance(p, dict) else json.loads(p.json))["stateOperators"]) for p in states]
    assert max(held) <= 200 and held[-1] <= 2 * held[1] + 10
