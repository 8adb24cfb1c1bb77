"""Streaming jobs: usage with replacement, activity, lifecycle with silence, change feed.

All of them are Spark expressions; what a job has to remember is a keyed table of versions in the store
(:mod:`tracelake.streaming.versions`), so nothing grows in executor memory, and rows of agents or messages that are
out of date leave the table when it is compacted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from tracelake.operators.changes import changed_rows
from tracelake.operators.state import IDLE_MS, LIVE_MS, STALL_MS
from tracelake.streaming import versions

# --- fixed values ---------------------------------------------------------------------------------
ACTIVITY_WATERMARK = "60 minutes"
BUDGET_WINDOW = "1 hour"
# --- end of fixed values --------------------------------------------------------------------------

_COUNTERS = ["input", "output", "cache_read", "cache_create"]
_USAGE = ["session_id", "model", "day", *_COUNTERS]


def stream_usage(usage: DataFrame, store: str, checkpoint: str, key: Sequence[str] = ("file", "epoch", "message_key"), keep_days: int | None = None, trigger: dict | None = None):
    """Usage deltas of a stream where a later line of a message replaces the earlier one.

    ``usage``: the key columns, ord, session_id, model, day and counters.  Each batch adds ``<store>/deltas/batch=n``:
    the new row of a message, and its old one negated (``messages`` is 1 and -1).  The sum of all deltas equals the batch
    result.  Late lines of a message that already was replaced change nothing.  With ``keep_days``, messages of days
    longer ago than the newest one by so many are forgotten; a still later line of one would count anew.
    """
    key = list(key)
    cols = ["ord", *_USAGE]

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*key).agg(F.max_by(F.struct(*cols), "ord").alias("new"))
        known = versions.current(spark, store, key, new.select(*key, "new.*").schema, batch_id)
        old = known.select(*key, F.struct(*cols).alias("old"))
        won = new.join(old, key, "left").where(F.col("old").isNull() | (F.col("new.ord") > F.col("old.ord"))).persist()
        plus = won.select(*[F.col(f"new.{c}").alias(c) for c in _USAGE], F.lit(1).cast("bigint").alias("messages"))
        less = won.where("old is not null").select(
            *[F.col(f"old.{c}").alias(c) for c in _USAGE[:3]], *[(-F.col(f"old.{c}")).alias(c) for c in _COUNTERS], F.lit(-1).cast("bigint").alias("messages")
        )
        plus.unionByName(less).write.mode("overwrite").parquet(f"{store}/deltas/batch={batch_id}")
        recent = None
        if keep_days is not None:
            newest = batch.agg(F.max(F.to_date("day"))).first()[0]
            recent = F.to_date("day") >= F.date_sub(F.lit(newest), keep_days)
        versions.write(won.select(*key, "new.*"), store, batch_id, key, recent)
        won.unpersist()

    return versions.start(usage.select(*key, *cols), flush, checkpoint, trigger)


def usage_deltas(spark, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/deltas").drop("batch")


def stream_latest_usage(usage: DataFrame, key: Sequence[str] = ("file", "epoch", "message_key")) -> DataFrame:
    """The latest row of every message as a streaming aggregation (update mode), for a sink that upserts by key.

    Spark keeps every key of this aggregation; where keys never end, use :func:`stream_usage`.
    """
    cols = ["session_id", "model", "day", *_COUNTERS]
    last = usage.groupBy(*key).agg(F.max_by(F.struct("ord", *cols), "ord").alias("r"))
    return last.select(*key, "r.*")


def write_versions(out: DataFrame, store: str, checkpoint: str, trigger: dict | None = None):
    """Write every batch of an update-mode stream as its own version folder; a replayed batch overwrites it."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return versions.start(out, flush, checkpoint, trigger, "update")


def latest_versions(rows: DataFrame, key: Sequence[str], batch: str = "batch") -> DataFrame:
    """The newest version of every key."""
    rest = [c for c in rows.columns if c not in (*key, batch)]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(batch).cast("bigint")).alias("r"))
    return last.select(*key, "r.*")


def stream_usage_first(usage: DataFrame, key: Sequence[str], event_time: str, delay: str = "1 day") -> DataFrame:
    """The first-wins variant: later lines of a response are dropped (inside the watermark)."""
    return usage.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(key))


def stream_activity(events: DataFrame, by: Sequence[str] = ("session_id",), ts: str = "ts", watermark: str = ACTIVITY_WATERMARK, size: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Events per window for sinks that can only append: a window comes out once the watermark has passed it, and rows
    later than the watermark are left out.  Totals that must hold every row come from :func:`stream_counts`."""
    stamped = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    window = F.window("__ts", size, slide) if slide else F.window("__ts", size)
    out = stamped.groupBy(*by, window.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.unix_millis("w.start").alias("window_start"), "n")


def stream_counts(events: DataFrame, store: str, checkpoint: str, by: Sequence[str] = ("session_id",), ts: str = "ts", size: str = "1 minute", trigger: dict | None = None):
    """Events per window with no row left out, however late, and no state: each batch adds its own counts."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(*by, F.window(F.col(ts).cast("timestamp"), size).alias("w")).agg(F.count(F.lit(1)).alias("n"))
        counts.select(*by, F.unix_millis("w.start").alias("window_start"), "n").write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return versions.start(events, flush, checkpoint, trigger)


def window_counts(spark, store: str, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """The totals of :func:`stream_counts` so far."""
    return spark.read.parquet(store).groupBy(*by, "window_start").agg(F.sum("n").alias("n"))


def stream_facts(events: DataFrame, by: Sequence[str] = ("session_id", "agent_key")) -> DataFrame:
    """Running first and last time and event count per agent (update mode); order of arrival plays no part."""
    return events.groupBy(*by).agg(F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"), F.count(F.lit(1)).alias("events"))


_AGENT = ["session_id", "agent_key"]
_LIFE = "session_id string, agent_key string, last_ts bigint, finished boolean, state string, at bigint, seen_ms bigint"


def stream_lifecycle(
    events: DataFrame, store: str, checkpoint: str, layout: str = "line_log", stall_ms: int = STALL_MS, live_ms: int = LIVE_MS, idle_ms: int = IDLE_MS,
    keep_ms: int | None = None, trigger: dict | None = None,
):
    """State changes of agents from their events and from silence, as ``<store>/changes/batch=n``.

    ``events``: session_id, agent_key, ts_ms, finished.  The newest time seen is the clock.  In the line log a silent
    agent is ``stalled``; in the other layouts it turns ``idle`` and then ``done``.  The newest line of an agent counts,
    so a late line never moves it back.  With ``keep_ms``, agents in a final state are forgotten so long after it.
    """
    line_log = layout == "line_log"
    quiet_ms, quiet = (stall_ms, "stalled") if line_log else (live_ms, "idle")

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = versions.current(spark, store, _AGENT, _LIFE, batch_id).persist()
        clock = F.greatest(F.coalesce(F.max("ts_ms"), F.lit(0)), F.coalesce(F.max("seen_ms"), F.lit(0)))
        times = batch.select("ts_ms", F.lit(None).cast("bigint").alias("seen_ms")).unionByName(known.select(F.lit(None).cast("bigint").alias("ts_ms"), "seen_ms"))
        now = times.agg(clock.alias("now")).first()["now"]
        new = batch.select(*_AGENT, "ts_ms", "finished", F.lit(1).alias("__new")).groupBy(*_AGENT).agg(F.max_by(F.struct("ts_ms", "finished"), F.struct("ts_ms", "finished")).alias("new"))
        rows = known.join(new, _AGENT, "full")
        later = F.col("last_ts").isNull() | F.coalesce(F.col("new.ts_ms") >= F.col("last_ts"), F.lit(False))
        rows = rows.withColumns({"__last": F.when(later, F.col("new.ts_ms")).otherwise(F.col("last_ts")), "__fin": F.when(later, F.col("new.finished")).otherwise(F.col("finished"))})
        silent = F.lit(now) - F.col("__last")
        state = F.when(F.col("__fin"), "done")
        if not line_log:
            state = state.when(silent >= idle_ms, "done")
        state = state.when(silent >= quiet_ms, quiet).otherwise("running")
        at = F.when(F.col("__fin") | (state == "running"), F.col("__last")).when(state == quiet, F.col("__last") + quiet_ms).otherwise(F.col("__last") + idle_ms)
        rows = rows.withColumns({"__state": state, "__at": at})
        touched = F.col("last_ts").isNull() | (F.col("__last") != F.col("last_ts")) | ~F.col("__state").eqNullSafe(F.col("state")) | (F.col("__fin") != F.col("finished"))
        next_ = rows.where(touched).persist()
        moved = next_.where(~F.col("__state").eqNullSafe(F.col("state")))
        moved.select(*_AGENT, F.col("__state").alias("state"), F.col("__at").alias("at")).write.mode("overwrite").parquet(f"{store}/changes/batch={batch_id}")
        keep = None
        if keep_ms is not None:
            keep = ~F.col("state").isin("done", "stalled") | (F.col("at") >= now - keep_ms)
        out = next_.select(*_AGENT, F.col("__last").alias("last_ts"), F.col("__fin").alias("finished"), F.col("__state").alias("state"), F.col("__at").alias("at"), F.lit(now).cast("bigint").alias("seen_ms"))
        versions.write(out, store, batch_id, _AGENT, keep)
        next_.unpersist()
        known.unpersist()

    return versions.start(events, flush, checkpoint, trigger)


def change_feed(
    snapshot: DataFrame, key: Sequence[str], signature: Sequence[str], store: str, sink: Callable[[DataFrame, int], Any], checkpoint: str, trigger: dict | None = None,
    version: str | None = None,
):
    """A coalesced feed of changed keys from a stream of snapshot rows.

    Of several rows of a key in one batch the one with the largest ``version`` (a column; without it, the largest
    signature) is the snapshot.  Each trigger compares the batch with the stored rows of its keys, hands the changed keys
    to ``sink`` and stores the changed rows only.  A replayed batch finds its own input again, so it is repeatable.
    """
    key, signature = list(key), list(signature)

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        order = F.col(version) if version else F.struct(*signature)
        cur = batch.groupBy(*key).agg(F.max_by(F.struct(*signature), order).alias("s")).select(*key, "s.*").persist()
        prev = versions.current(spark, store, key, cur.schema, batch_id).join(cur.select(*key), key, "left_semi").persist()
        changed = changed_rows(prev, cur, key, signature)
        sink(changed, batch_id)
        versions.write(cur.join(changed.select(*key), key, "left_semi"), store, batch_id, key)
        cur.unpersist()
        prev.unpersist()

    return versions.start(snapshot, flush, checkpoint, trigger or {"processingTime": "300 milliseconds"}, "update")


def hourly_budget(calls: DataFrame, ts: str = "ts", slide: str = "1 minute") -> DataFrame:
    """Calls per sliding hour of a call log."""
    return stream_activity(calls, (), ts, BUDGET_WINDOW, BUDGET_WINDOW, slide)
