"""Structured Streaming runs over the driver tables, checked against batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from mnemoframe.operators.mutations import access_hits, decay_after
from mnemoframe.session import shared_folder
from mnemoframe.streaming import queries as st, sinks, stateful
from workload.registry import query
from workload.storage import _planned, stamp
from workload.views import NOW, Tables


def _run(t: Tables, stream, mode="append", transform=None):
    """Drain a stream into a fresh folder and read the result back."""
    base = f"{shared_folder(t.spark)}/streams/{uuid.uuid4().hex}"
    sinks.run_available(stream, f"{base}/out", f"{base}/checkpoint", mode, transform)
    return t.spark.read.parquet(f"{base}/out")


def _stream(t: Tables, table: str):
    """The table's files; a stream's path has to be a folder or a pattern, and a table is one file or a folder of them."""
    schema = t.spark.read.parquet(f"{t.folder}/{table}.parquet").schema
    return t.spark.readStream.schema(schema).parquet(f"{t.folder}/{table}.parque[t]")


@query("stream_sessions", """WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
  g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s),
  w AS (SELECT user_id, min(ts) AS a, max(ts) AS b, count(*) AS messages FROM g GROUP BY user_id, k)
  SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS last_message_at, messages FROM w WHERE b + INTERVAL 30 MINUTE <= (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR""")
def _(t):
    out = _run(t, st.sessions(_stream(t, "events"), ["user_id"]))
    return out.select("user_id", stamp("started_at"), stamp("last_message_at"), "messages")


@query("stream_monthly_usage", "SELECT 't' || (user_id % 20) AS tenant_id, strftime(date_trunc('month', ts), '%Y-%m-%d %H:%M:%S') AS period_start, count(*) AS queries, CAST(sum(CASE WHEN event_type = 'error' THEN 0 ELSE 10 END) AS BIGINT) AS tokens FROM events GROUP BY ALL")
def _(t):
    stream = _stream(t, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 20).alias("tenant_id"), "ts", F.lit(1).cast("long").alias("queries"),
        F.when(F.col("event_type") == "error", 0).otherwise(10).cast("long").alias("tokens"))
    out = _run(t, st.monthly_usage(stream, ["queries", "tokens"]), "update")
    return sinks.latest(out, "tenant_id", "period_start").select("tenant_id", stamp("period_start"), "queries", "tokens")


@query("stream_idempotent_ingest", """SELECT DISTINCT 't' || (user_id % 5) AS tenant_id, sha256('{"type":"' || event_type || '","data":' || CAST(to_json(props) AS STRING) || '}') AS input_hash FROM events""")
def _(t):
    stream = _stream(t, "events").withColumn("tenant_id", F.concat(F.lit("t"), F.col("user_id") % 5))
    return _run(t, st.idempotent(stream, "event_type", "props", delay="60 days")).select("tenant_id", "input_hash")


@query("stream_access_decay", f"""WITH h AS (SELECT user_id AS fact_id, count(*) AS n FROM events GROUP BY ALL)
  SELECT fact_id, CAST(frequency + n AS BIGINT) AS new_frequency, round(greatest(0, least(1, importance * least(1.0::DOUBLE, ln(1 + (frequency + n)::DOUBLE) / ln(51::DOUBLE)))), 6) AS new_decay_score FROM facts JOIN h USING (fact_id)""")
def _(t):
    stream = _stream(t, "events").select(F.col("user_id").alias("fact_id"))
    hits = _run(t, stream, transform=access_hits)  # one log row per batch and fact
    return decay_after(t.facts, hits, t.now).select("fact_id", F.col("new_frequency").cast("long").alias("new_frequency"), F.round("new_decay_score", 6).alias("new_decay_score"))


@query("stream_webhook_outbox", """SELECT w.webhook_id, e.event_id FROM (SELECT event_id, 't' || (user_id % 5) AS tenant_id FROM events WHERE event_type = 'error') e JOIN webhooks w ON w.tenant_id = e.tenant_id AND w.active AND list_contains(w.events, 'extraction.failed')""")
def _(t):
    stream = _stream(t, "events").where("event_type = 'error'").select(
        "event_id", F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.lit("extraction.failed").alias("event"), F.col("props").alias("payload"))
    # signed and checked as they come; what is kept of a delivery is what is asked, not its payload and signature
    return _run(t, st.outbox(stream, t.webhooks), transform=lambda rows: rows.where(
        "length(signature) = 64").select("webhook_id", "event_id")).select("webhook_id", "event_id")


def flush_time(session, turn):
    """Sessions begin an hour apart, of any number; the seconds since the first are more than an int holds."""
    seconds = turn * 5 + F.floor(turn / 7) * 40 + session.cast("long") * 3600
    return F.timestamp_micros(F.unix_micros(F.expr(NOW)) + seconds.cast("long") * 1_000_000)


@query("stream_flushes", f"""WITH m AS (SELECT conv_id AS session_id, turn, role || ': ' || text AS line, epoch({NOW}) + turn * 5 + (turn // 7) * 40 + conv_id * 3600 AS sec FROM conversations),
  g AS (SELECT *, CASE WHEN sec - lag(sec) OVER w >= 30 THEN 1 ELSE 0 END AS gap FROM m WINDOW w AS (PARTITION BY session_id ORDER BY sec, turn)),
  s AS (SELECT *, sum(gap) OVER (PARTITION BY session_id ORDER BY sec, turn ROWS UNBOUNDED PRECEDING) AS part FROM g),
  n AS (SELECT *, (row_number() OVER (PARTITION BY session_id, part ORDER BY sec, turn) - 1) // 5 AS piece FROM s),
  f AS (SELECT session_id, min(sec) AS first, max(sec) AS last, count(*) AS messages, string_agg(line, chr(10) ORDER BY sec, turn) AS text FROM n GROUP BY session_id, part, piece)
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY first) - 1 AS number, messages, CASE WHEN messages = 5 THEN 'count' ELSE 'idle' END AS cause, text FROM f
  WHERE messages = 5 OR last + 30 <= (SELECT max(sec) FROM m)""")
def _(t):
    stream = _stream(t, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_number"), "role", F.col("text").alias("content"),
        flush_time(F.col("conv_id"), F.col("turn")).alias("created_at"))
    with stateful.state_store(t.spark):
        # the sink has a folder "batch" of its own
        out = _run(t, stateful.flushes(stream, delay="0 seconds").withColumnRenamed("batch", "number"))
    return out.select("session_id", "number", "messages", "cause", "text")


@query("stream_retried_inputs", """WITH e AS (SELECT 't' || (user_id % 5) AS tenant_id, 'h' || (user_id % 1000) AS input_hash, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'input' END AS kind FROM events),
  l AS (SELECT 't' || (n_nationkey % 5) AS tenant_id, 'h' || n_nationkey AS input_hash, CASE n_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'processing' END AS before FROM nation),
  o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, input_hash ORDER BY ts, CASE kind WHEN 'input' THEN 1 ELSE 0 END) AS place FROM e),
  s AS (SELECT *, sum(CASE kind WHEN 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY tenant_id, input_hash ORDER BY place ROWS UNBOUNDED PRECEDING) AS part FROM o),
  c AS (SELECT tenant_id, input_hash, part, min(CASE kind WHEN 'input' THEN place END) AS place, arg_min(ts, place) FILTER (kind = 'input') AS ts FROM s GROUP BY ALL),
  b AS (SELECT c.*, CASE WHEN l.before = 'processing' AND c.part = 0 THEN 0 ELSE c.place END AS begun, l.before FROM c LEFT JOIN l USING (tenant_id, input_hash)),
  closed AS (SELECT b.tenant_id, b.input_hash, min(s.place) AS place FROM b JOIN s ON s.tenant_id = b.tenant_id AND s.input_hash = b.input_hash AND s.part = b.part AND s.kind = 'completed' AND s.place > b.begun GROUP BY ALL)
  SELECT b.tenant_id, b.input_hash, strftime(b.ts, '%Y-%m-%d %H:%M:%S.%f') AS at, row_number() OVER (PARTITION BY b.tenant_id, b.input_hash ORDER BY b.place) AS attempt FROM b LEFT JOIN closed x USING (tenant_id, input_hash)
  WHERE b.place IS NOT NULL AND b.begun > 0 AND coalesce(b.before, '') <> 'completed' AND (x.place IS NULL OR b.place < x.place)""")
def _(t):
    stream = _stream(t, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"), F.concat(F.lit("h"), F.col("user_id") % 1000).alias("input_hash"), "ts",
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("input").alias("kind"))
    ledger = t.nation.select(
        F.concat(F.lit("t"), F.col("n_nationkey") % 5).alias("tenant_id"), F.concat(F.lit("h"), F.col("n_nationkey")).alias("input_hash"),
        F.when(F.col("n_nationkey") % 3 == 0, "completed").when(F.col("n_nationkey") % 3 == 1, "failed").otherwise("processing").alias("status"))
    with stateful.state_store(t.spark):
        out = _run(t, stateful.accepted_inputs(stream, ledger))
    return out.select("tenant_id", "input_hash", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "attempt")


@query("stream_rates", """WITH w AS (SELECT 't' || (user_id % 20) AS tenant_id, to_timestamp(floor(epoch(ts) / 10) * 10 - 10 * k)::TIMESTAMP AS w FROM events, LATERAL (SELECT unnest(range(0, 6)) AS k))
  SELECT tenant_id, strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS requests FROM w WHERE w + INTERVAL 1 MINUTE <= (SELECT time_bucket(INTERVAL '1 millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def _(t):
    stream = _stream(t, "events").select(
        F.concat(F.lit("t"), F.col("user_id") % 20).alias("tenant_id"), F.lit("free").alias("plan"), "ts")
    return _run(t, st.rates(stream)).select("tenant_id", stamp("window_start"), "requests")
