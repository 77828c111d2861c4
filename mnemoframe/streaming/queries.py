"""Streaming forms of the stateful behaviours: sessions, flushes, usage, dedup, limits.

Each function maps a streaming DataFrame to a streaming DataFrame.  Rows later than
the watermark are dropped by the stateful operators; that is the late-data rule.
State is keyed so that it spreads: a busy session or tenant is split by flush number
or window, and is never one growing value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mnemoframe.functions import fixed_values as fv
from mnemoframe.functions.hashing import hmac_pads, hmac_sha256, input_hash
from mnemoframe.operators.grouping import salted_join

WATERMARK = "1 hour"


def event_time(stream: DataFrame, ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Set the watermark; a timestamp without zone is read as UTC."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def sessions(stream: DataFrame, keys: list[str], ts: str = "ts",
             gap_minutes: int = fv.SESSION_GAP_MINUTES, delay: str = WATERMARK) -> DataFrame:
    """Activity sessions, sent when no message can extend them any more."""
    window = F.session_window(ts, f"{gap_minutes} minutes")
    return event_time(stream, ts, delay).groupBy(*keys, window).agg(
        F.count(F.lit(1)).alias("messages")).select(
        *keys, F.col("session_window.start").alias("started_at"),
        F.expr(f"session_window.end - INTERVAL {gap_minutes} MINUTES").alias("last_message_at"),
        "messages")


def monthly_usage(stream: DataFrame, counters: list[str], ts: str = "ts") -> DataFrame:
    """Month counters per tenant for update or complete mode; state is tenants x months."""
    return stream.groupBy("tenant_id", F.date_trunc("month", F.col(ts).cast("timestamp"))
                          .alias("period_start")).agg(*[F.sum(c).alias(c) for c in counters])


def idempotent(stream: DataFrame, type_col: str, data_col: str, ts: str = "ts",
               delay: str = WATERMARK) -> DataFrame:
    """First arrival of each (tenant, input hash) within the watermark."""
    hashed = event_time(stream, ts, delay).withColumn(
        "input_hash", input_hash(F.col(type_col), F.col(data_col)))
    return hashed.dropDuplicatesWithinWatermark(["tenant_id", "input_hash"])


def rates(stream: DataFrame, window: str = "1 minute", slide: str = "10 seconds",
          ts: str = "ts", delay: str = WATERMARK) -> DataFrame:
    """Requests per tenant and plan in sliding windows."""
    return event_time(stream, ts, delay).groupBy(
        "tenant_id", "plan", F.window(ts, window, slide)).agg(
        F.count(F.lit(1)).alias("requests")).select(
        "tenant_id", "plan", F.col("window.start").alias("window_start"), "requests")


def outbox(stream: DataFrame, webhooks: DataFrame, salts: int = 16) -> DataFrame:
    """One signed delivery per (event, subscribed webhook); sending is up to the caller.

    ``stream`` holds ``tenant_id, event, payload``.  A secret is padded once, not for each
    delivery; events are spread over the tasks first, as a source file is read by few of
    them and each event grows into as many rows as its tenant has webhooks.
    """
    hooks = webhooks.where("active").select(
        "tenant_id", "webhook_id", hmac_pads(F.col("secret")).alias("_pads"), F.explode("events").alias("event"))
    tasks = stream.sparkSession.sparkContext.defaultParallelism * 4
    return salted_join(stream.repartition(tasks), hooks, ["tenant_id", "event"], "payload", salts).withColumn(
        "signature", hmac_sha256(F.col("payload"), pads=F.col("_pads"))).drop("_pads")
