"""Conversation logs: flush batches, signal turns, sessions, message text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemoframe.functions import fixed_values as fv


def flush_batches(messages: DataFrame, size: int = fv.FLUSH_MESSAGES) -> DataFrame:
    """Buffered messages of a session in flushes of ``size``, as extraction input.

    A flush is the unit of text the extractor gets; grouping by it keeps every group
    at ``size`` messages, however long the session is.
    """
    batch = F.floor(F.col("turn_number") / size).cast("long")
    line = F.concat(F.lit("["), F.col("role"), F.lit(" @ "),
                    F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.lit("]: "),
                    F.col("content"))
    return _joined(messages.withColumn("batch", batch), line, "\n\n")


def conversation_text(messages: DataFrame, size: int = fv.FLUSH_MESSAGES) -> DataFrame:
    """``role: content`` lines of each flush."""
    batch = F.floor(F.col("turn_number") / size).cast("long")
    return _joined(messages.withColumn("batch", batch),
                   F.concat(F.col("role"), F.lit(": "), F.col("content")), "\n")


def _joined(batched: DataFrame, line: Column, separator: str) -> DataFrame:
    lines = batched.withColumn("_line", F.struct("turn_number", line.alias("text")))
    grouped = lines.groupBy("session_id", "batch").agg(
        F.count(F.lit(1)).alias("messages"),
        F.array_sort(F.collect_list("_line")).alias("_lines"))
    return grouped.select("session_id", "batch", "messages", F.array_join(
        F.transform("_lines", lambda x: x["text"]), separator).alias("text"))


def signal_turns(turns: DataFrame, phrases=fv.SIGNAL_PHRASES, fallback: int = 2) -> DataFrame:
    """Turns worth keeping: those with a signal phrase and the one before each.

    A conversation without any signal keeps its last ``fallback`` turns.  The turn
    before is found by an equi-join on its number, so a long conversation spreads
    over many tasks.
    """
    lower = F.lower("content")
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | lower.contains(phrase)
    marked = turns.withColumn("_hit", hit)
    following = marked.where("_hit").select(
        "session_id", (F.col("turn_number") - 1).alias("turn_number"),
        F.lit(True).alias("_before"))
    per_session = marked.groupBy("session_id").agg(
        F.max("_hit").alias("_any"), F.max("turn_number").alias("_last"))
    joined = marked.join(following, ["session_id", "turn_number"], "left").join(
        per_session, "session_id")
    keep = F.when(F.col("_any"), F.col("_hit") | F.coalesce("_before", F.lit(False))).otherwise(
        F.col("turn_number") > F.col("_last") - fallback)
    return joined.where(keep).withColumn("is_signal", F.col("_hit")).drop(
        "_hit", "_before", "_any", "_last")


def session_windows(events: DataFrame, keys: list[str], ts: str = "ts",
                    gap_minutes: int = fv.SESSION_GAP_MINUTES) -> DataFrame:
    """Activity sessions: a gap as long as the timeout starts a new one.

    No session ends within a minute, so events are counted by minute first, before any
    shuffle.  What is then joined up per key are minutes, however many events they hold.
    """
    short = events.groupBy(*keys, F.date_trunc("minute", ts).alias("_minute")).agg(
        F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.count(F.lit(1)).alias("_n")).drop("_minute")
    in_order = Window.partitionBy(*keys).orderBy("_from")
    before = F.lag("_to").over(in_order)
    starts = before.isNull() | (
        F.col("_from") >= before + F.expr(f"INTERVAL {gap_minutes} MINUTES"))
    numbered = short.withColumn("_new", starts.cast("int")).withColumn(
        "_session", F.sum("_new").over(in_order))
    return numbered.groupBy(*keys, "_session").agg(
        F.min("_from").alias("started_at"), F.max("_to").alias("last_message_at"),
        F.sum("_n").alias("messages")).drop("_session")


def turn_count(messages: DataFrame) -> DataFrame:
    """Messages so far in each session, which is the number of the next turn."""
    return messages.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("messages"), F.max("turn_number").alias("last_turn"))


def sliding_rate(events: DataFrame, limits: dict[str, int], window: str, slide: str | None,
                 ts: str = "ts") -> DataFrame:
    """Requests per tenant in each window against the plan's limit."""
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    counted = events.groupBy("tenant_id", "plan", span).agg(F.count(F.lit(1)).alias("requests"))
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    allowed = F.coalesce(F.try_element_at(table, F.col("plan")), F.lit(limits["free"]))
    return counted.select(
        "tenant_id", "plan", F.col("window.start").alias("window_start"), "requests",
        allowed.alias("request_limit"),
        F.greatest(F.lit(0), allowed - F.col("requests")).alias("remaining"),
        (F.col("requests") > allowed).alias("limited"))


def accuracy(results: DataFrame) -> DataFrame:
    """Share of right answers and mean latency, per question type and overall."""
    return results.rollup("question_type").agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("latency_ms").alias("mean_latency_ms"))

