"""Flushes and the ledger of inputs over several micro-batches, against plain Python."""

import random
from datetime import datetime, timedelta, timezone

from mnemoframe.streaming import sinks, stateful

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return START + timedelta(seconds=seconds)


def run(spark, tmp_path, schema, batches, make):
    """Output rows per micro-batch; each list of rows is a file, and a file a micro-batch."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with stateful.state_store(spark):
            sinks.run_available(make(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return sorted((tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch_id").collect()), key=repr)


def plain_flushes(messages, watermark, size, idle):
    open_, last, out, number = [], 0, [], 0
    for second, _, line in sorted(messages):
        if second > watermark:
            break
        if open_ and second - last >= idle:
            out.append((number, len(open_), "idle", "\n".join(open_)))
            open_, number = [], number + 1
        open_.append(line)
        last = second
        if len(open_) == size:
            out.append((number, size, "count", "\n".join(open_)))
            open_, number = [], number + 1
    if open_ and last + idle <= watermark:
        out.append((number, len(open_), "idle", "\n".join(open_)))
    return out


def test_flushes_by_count_and_idle_time(spark, tmp_path):
    rnd = random.Random(4)
    messages = {s: [] for s in range(6)}
    for s, own in messages.items():
        second = s
        for turn in range(rnd.choice([1, 4, 23, 40])):
            second += rnd.choice([0, 1, 3, 7, 29, 30, 31, 90])
            own.append((second, turn, f"user: m{s}.{turn}"))
    rows = [(s, turn, "user", f"m{s}.{turn}", at(second)) for s, own in messages.items() for second, turn, _ in own]
    rows.append((99, 0, "user", "the last", at(5000)))
    # out of order within a minute: by second, shuffled in windows
    rows.sort(key=lambda r: (r[4] - START).total_seconds() // 60 + rnd.random() * 0.5)
    schema = "session_id long, turn_number int, role string, content string, created_at timestamp"
    batches = [rows[:40], rows[40:60], rows[60:]]
    got = run(spark, tmp_path, schema, batches, lambda s: stateful.flushes(s, delay="200 seconds").withColumnRenamed("batch", "number"))
    want = [(s, *flush) for s, own in messages.items() for flush in plain_flushes(own, 4800, 5, 30)]
    assert {w[3] for w in want} == {"idle", "count"}
    assert sorted(tuple(r[:5]) for r in got) == sorted(want)


def test_inputs_are_retried_after_a_failure_only(spark, tmp_path):
    schema = "tenant_id string, input_hash string, ts timestamp, kind string"
    ledger = spark.createDataFrame([("t", "done", "completed"), ("t", "bad", "failed"), ("u", "busy", "processing")],
                                   "tenant_id string, input_hash string, status string")
    batches = [
        [("t", "a", at(1), "input"), ("t", "a", at(2), "input"), ("t", "done", at(1), "input"), ("t", "bad", at(1), "input"),
         ("u", "a", at(1), "input"), ("u", "busy", at(1), "input")],
        [("t", "a", at(10), "failed"), ("t", "a", at(11), "input"), ("u", "a", at(10), "completed"), ("u", "a", at(11), "input"),
         ("u", "busy", at(9), "failed"), ("t", "new", at(9), "failed")],
        [("t", "a", at(20), "input"), ("t", "a", at(21), "failed"), ("t", "a", at(21), "input"), ("u", "busy", at(20), "input"),
         ("t", "new", at(20), "input"), ("t", "bad", at(20), "completed"), ("t", "bad", at(22), "input")]]
    got = run(spark, tmp_path, schema, batches, lambda s: stateful.accepted_inputs(s, ledger))
    told = sorted((r[0], r[1], int((r[2].astimezone(timezone.utc) - START).total_seconds()), r[3]) for r in got)
    assert told == [("t", "a", 1, 1), ("t", "a", 11, 2), ("t", "a", 21, 3), ("t", "bad", 1, 1), ("t", "new", 20, 1),
                    ("u", "a", 1, 1), ("u", "busy", 20, 1)]


def test_flush_times_of_sessions_beyond_an_int_of_seconds(spark):
    from pyspark.sql import functions as F
    from workload.streams import flush_time

    rows = spark.createDataFrame([(0, 8), (700_000, 8), (None, 8)], "conv_id long, turn long")
    got = [r[0] for r in rows.select(F.unix_seconds(flush_time(F.col("conv_id"), F.col("turn")))).collect()]
    assert got[1] - got[0] == 700_000 * 3600 and got[2] is None


def test_a_stream_reads_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from workload.streams import _run, _stream
    from workload.views import Tables

    rows = spark.createDataFrame([(n, n % 3, "user", f"m{n}") for n in range(12)], "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "folder" / "conversations.parquet"))
    rows.toPandas().to_parquet(str(tmp_path / "conversations.parquet"))
    for folder in (tmp_path / "folder", tmp_path):
        got = _run(Tables(spark, str(folder)), _stream(Tables(spark, str(folder)), "conversations"))
        assert sorted(r.conv_id for r in got.collect()) == list(range(12))


def test_deliveries_are_signed_and_kept_without_payloads(spark, tmp_path, monkeypatch):
    from types import SimpleNamespace

    from workload import registry, streams
    from workload.views import Tables

    events = [(n, n % 5, "click" if n == 9 else "error", None if n == 7 else "{}") for n in range(20)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    hooks = [("w1", "t0", "s1", True, ["extraction.failed"]), ("w2", "t0", "s2", False, ["extraction.failed"]),
             ("w3", "t2", "s3", None, ["extraction.failed"]), ("w4", "t2", "s4", True, ["a", "extraction.failed"]), ("w5", "t1", "s5", True, ["a"])]
    webhooks = spark.createDataFrame(hooks, "webhook_id string, tenant_id string, secret string, active boolean, events array<string>")
    kept, signed, run, sign = [], [], streams.sinks.run_available, streams.st.hmac_sha256
    monkeypatch.setattr(registry, "tables", lambda *_: SimpleNamespace(spark=Tables(spark, "").spark, folder=str(tmp_path), webhooks=webhooks))
    monkeypatch.setattr(streams.sinks, "run_available", lambda stream, path, *a, **k: (kept.append(path), run(stream, path, *a, **k)))
    monkeypatch.setattr(streams.st, "hmac_sha256", lambda *a, **k: signed.append(1) or sign(*a, **k))
    got = {tuple(r) for r in registry.QUERIES["stream_webhook_outbox"](spark, "").collect()}
    assert got == {("w1", n) for n in (0, 5, 10, 15)} | {("w4", n) for n in (2, 12, 17)} and signed
    assert set(spark.read.parquet(kept[0]).columns) == {"webhook_id", "event_id", "batch"}
