"""Agent state, turn and duration rules as column expressions.

``now`` is always a parameter in epoch ms; nothing here reads the clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions.text import col, nz
from tracelake.operators.segments import previous_row, running_total
from tracelake.session import cut_lineage

# --- fixed values: time limits in ms and state names ----------------------------------------------
MINUTE = 60_000
STALL_MS = 10 * MINUTE
LIVE_MS = 2 * MINUTE
IDLE_MS = 10 * MINUTE
NOTIFY_SLACK_MS = 5_000
STATES = ("running", "idle", "done", "failed", "stopped", "stalled")
# --- end of fixed values --------------------------------------------------------------------------


def notification_outcome(status: Column | str) -> Column:
    """How a task ended, from the status word of its notification; null while it has not ended."""
    s = F.lower(F.trim(F.coalesce(col(status), F.lit(""))))
    return (
        F.when(s.rlike("^(killed|stopped|cancel|abort|interrupt)"), F.lit("stopped"))
        .when(s.rlike("^(failed|failure|error)"), F.lit("failed"))
        .when(s.rlike("^(completed|complete|done|success)"), F.lit("done"))
    )


def line_log_state(now: int, stall_ms: int = STALL_MS) -> Column:
    """Columns: is_main, alive, reg_status, note_status, note_ts, last_ts, mtime, last_role, last_stop."""
    last = F.greatest(F.coalesce(F.col("last_ts"), F.lit(0)), F.coalesce(F.col("mtime"), F.lit(0)))
    final = F.col("note_ts").isNotNull() & (F.coalesce(F.col("last_ts"), F.lit(0)) <= F.col("note_ts") + NOTIFY_SLACK_MS)
    outcome = F.when(final, notification_outcome("note_status"))
    answered = (F.col("last_role") == "assistant") & F.col("last_stop").isNotNull() & (F.col("last_stop") != "tool_use")
    main = F.when(
        F.coalesce(F.col("alive"), F.lit(False)),
        F.when(F.col("reg_status") == "busy", F.lit("running")).otherwise(F.lit("idle")),
    ).otherwise(F.lit("done"))
    sub = F.coalesce(
        outcome,
        F.when(F.coalesce(answered, F.lit(False)), F.lit("done"))
        .when(F.lit(now) - last < stall_ms, F.lit("running"))
        .otherwise(F.lit("stalled")),
    )
    return F.when(F.col("is_main"), main).otherwise(sub)


def rollout_state(now: int, stall_ms: int = STALL_MS, live_ms: int = LIVE_MS) -> Column:
    """Columns: archived, open_turns, mtime, last_turn_end."""
    age = F.lit(now) - F.coalesce(F.col("mtime"), F.lit(0))
    active = ~F.coalesce(F.col("archived"), F.lit(False))
    open_ = F.coalesce(F.col("open_turns"), F.lit(0))
    return (
        F.when(active & (open_ > 0) & (age <= stall_ms), F.lit("running"))
        .when(active & (age <= live_ms), F.lit("idle"))
        .when((F.col("last_turn_end") == "aborted") & (open_ == 0), F.lit("stopped"))
        .otherwise(F.lit("done"))
    )


def part_state(now: int, stall_ms: int = STALL_MS, live_ms: int = LIVE_MS) -> Column:
    """Columns: updated_at, has_last (an assistant message exists), completed_at, error_name."""
    age = F.lit(now) - F.col("updated_at")
    open_ = F.coalesce(F.col("has_last"), F.lit(False)) & F.col("completed_at").isNull() & F.col("error_name").isNull()
    return (
        F.when(open_ & (age <= stall_ms), F.lit("running"))
        .when(age <= live_ms, F.lit("idle"))
        .when(F.col("error_name") == "MessageAbortedError", F.lit("stopped"))
        .when(F.col("error_name").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("done"))
    )


def document_state(now: int, live_ms: int = LIVE_MS, idle_ms: int = IDLE_MS) -> Column:
    """Columns: mtime, last_type, pending_call."""
    age = F.lit(now) - F.col("mtime")
    waiting = (F.col("last_type") == "user") | (F.coalesce(F.col("pending_call"), F.lit(False)) & (F.col("last_type") == "gemini"))
    return (
        F.when((age <= live_ms) & F.coalesce(waiting, F.lit(False)), F.lit("running"))
        .when(age <= idle_ms, F.lit("idle"))
        .otherwise(F.lit("done"))
    )


def chain_state(now: int, live_ms: int = LIVE_MS, idle_ms: int = IDLE_MS) -> Column:
    """Columns: in_scope, open_turn, last_activity, terminal."""
    age = F.lit(now) - F.col("last_activity")
    return (
        F.when(~F.col("in_scope"), F.lit("done"))
        .when(F.coalesce(F.col("open_turn"), F.lit(False)) & (age <= live_ms), F.lit("running"))
        .when(age <= idle_ms, F.lit("idle"))
        .when(F.col("terminal") == "error", F.lit("failed"))
        .when(F.col("terminal") == "interrupted", F.lit("stopped"))
        .otherwise(F.lit("done"))
    )


def summary_state(now: int, live_ms: int = LIVE_MS, fresh_ms: int = STALL_MS) -> Column:
    """Columns: last_modified, status, killed, not_fully_idle; yields ``struct(state, label)``."""
    s = F.upper(F.coalesce(F.col("status"), F.lit("")))
    age = F.when(F.col("last_modified").isNotNull(), F.greatest(F.lit(0), F.lit(now) - F.col("last_modified"))).otherwise(
        F.lit(2**62)
    )
    running = s.rlike("(^|_)(RUNNING|ACTIVE|BUSY)(_|$)")
    known = (s == "") | running | s.rlike("(^|_)IDLE(_|$)")
    raw = F.lower(F.col("status"))
    fresh, recent = age <= live_ms, age <= fresh_ms
    killed, busy = F.coalesce(F.col("killed"), F.lit(False)), F.coalesce(F.col("not_fully_idle"), F.lit(False))
    state = (
        F.when(killed, F.lit("stopped"))
        .when(running, F.when(recent, F.lit("running")).otherwise(F.lit("stalled")))
        .when(busy & recent, F.lit("running"))
        .when(fresh, F.lit("idle"))
        .otherwise(F.lit("done"))
    )
    label = (
        F.when(killed, F.when(~known, raw))
        .when(running, F.when(recent, F.lit("busy")))
        .when(busy & recent, F.lit("busy"))
        .when(~known, raw)
        .when(fresh, F.lit("idle"))
    )
    return F.struct(state.alias("state"), nz(label).alias("label"))


def infer_state(facts: DataFrame, layout: str, now: int, **limits: int) -> DataFrame:
    """Add ``state`` (and ``status_label`` for the summary layout) to a facts table."""
    if layout == "summary_table":
        both = summary_state(now, **limits)
        return facts.withColumn("state", both["state"]).withColumn("status_label", both["label"])
    rules = {
        "line_log": line_log_state,
        "rollout": rollout_state,
        "part_store": part_state,
        "document": document_state,
        "chain_store": chain_state,
    }
    return facts.withColumn("state", rules[layout](now, **limits))


def end_columns(now: int, open_states: Sequence[str] = ("running",)) -> dict[str, Column]:
    """``ended_at`` and ``duration_ms`` from state, started_at and last_activity_at.

    The line log counts to ``now`` only while running; pass ``("running", "idle")`` for the others.
    """
    is_open = F.col("state").isin(*open_states)
    end = F.when(is_open, F.lit(now)).otherwise(F.coalesce(F.col("last_activity_at"), F.lit(now)))
    return {
        "ended_at": F.when(~is_open, F.col("last_activity_at")),
        "duration_ms": F.when(
            F.col("started_at").isNotNull(), F.greatest(F.lit(0), end - F.col("started_at"))
        ).otherwise(F.lit(0)).cast("bigint"),
    }


def agent_mode(is_main: Column, request_shape: Column, spawn_background: Column) -> Column:
    background = F.when(nz(request_shape).isNotNull(), request_shape == "background").otherwise(spawn_background)
    return (
        F.when(is_main, F.lit("main"))
        .when(background.isNull(), F.lit("unknown"))
        .when(background, F.lit("background"))
        .otherwise(F.lit("foreground"))
    )


# ------------------------------------------------------------------------------------ turns
#: Order values of a segment of ends, and what stands for "no start" and "no clear yet".
TURN_SPAN, _NO_START, _NO_CLEAR = 4096, -(1 << 62), -(1 << 62) + 1


def _after(steps: Column, last: Column) -> Column:
    """The last clear after a segment from the last clear before it."""
    return F.coalesce(F.try_element_at(F.filter(steps, lambda s: s["o"] < last), F.lit(1))["r"], last)


def _clears(ends: DataFrame, by: Sequence[str], order: str, opened: str = "__opened", span: int | None = None) -> DataFrame:
    """Those ends that clear all turns, as columns ``__clear_<key>``.

    All that the past says to an end is where the last clear was: the end is a clear if that is later than the start of
    its turn (no start: always), and then it is the last clear itself.  So a segment of ends maps the last clear before it
    to that after it by a step function, and such functions compose: an end that starts further back than all before it
    makes one step of all, any other end lifts the first steps, which merge.  One pass turns segments into step functions,
    one goes over the few functions of each thread, and one goes over the ends of each segment from what it then knows.
    """
    span = span or TURN_SPAN
    long = lambda c: F.col(c).cast("bigint")
    own = ends.select(*by, long(order).alias("e"), F.coalesce(long(opened), F.lit(_NO_START)).alias("o"))
    own = own.withColumn("__seg", F.floor(F.col("e") / span))
    own = own.groupBy(*by, "__seg").agg(F.array_sort(F.collect_list(F.struct("e", "o"))).alias("ends"))
    step = lambda o, r: F.array(F.struct(o.alias("o"), r.alias("r")))

    def grown(acc, x):
        lifted = F.filter(acc["steps"], lambda s: s["r"] > x["o"])
        kept = F.filter(acc["steps"], lambda s: s["r"] <= x["o"])
        steps = (
            F.when(x["o"] < acc["least"], step(x["o"], x["e"]))
            .when(F.size(lifted) > 0, F.concat(step(F.element_at(lifted, -1)["o"], x["e"]), kept))
            .otherwise(acc["steps"])
        )
        return F.struct(F.least(acc["least"], x["o"]).alias("least"), steps.alias("steps"))

    none = F.array().cast("array<struct<o:bigint,r:bigint>>")
    first = F.struct(F.col("ends")[0]["e"].alias("least"), none.alias("steps"))
    functions = own.select(*by, "__seg", F.aggregate("ends", first, grown, lambda acc: acc["steps"]).alias("steps"))
    in_order = functions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__seg", "steps"))).alias("all"))
    start = F.struct(F.lit(_NO_CLEAR).alias("last"), F.array().cast("array<struct<seg:bigint,last:bigint>>").alias("out"))
    known = F.aggregate(
        "all", start, lambda acc, x: F.struct(_after(x["steps"], acc["last"]).alias("last"), F.concat(acc["out"], F.array(F.struct(x["__seg"].alias("seg"), acc["last"].alias("last")))).alias("out")),
        lambda acc: acc["out"],
    )
    known = in_order.select(*[F.col(k).alias(f"__k_{k}") for k in by], F.explode(known).alias("s"))
    same = F.expr(" AND ".join([*(f"`{k}` <=> `__k_{k}`" for k in by), "__seg = s.seg"]))
    seen = F.struct(F.col("s.last").alias("last"), F.array().cast("array<bigint>").alias("out"))
    walked = F.aggregate(
        "ends", seen, lambda acc, x: F.when(acc["last"] > x["o"], F.struct(x["e"].alias("last"), F.concat(acc["out"], F.array(x["e"])).alias("out"))).otherwise(acc), lambda acc: acc["out"]
    )
    out = own.join(known, same).select(*[F.col(k).alias(f"__clear_{k}") for k in by], F.explode(walked).alias("__clear_e"))
    return out.withColumn(f"__clear_{order}", F.col("__clear_e")).drop("__clear_e")


def scan_turns(
    turns: DataFrame, by: Sequence[str] = ("file",), order: str = "ord", turn: str = "turn_id", started: str = "started"
) -> DataFrame:
    """Add ``is_clear`` and ``open_after`` to a table of turn starts and ends.

    A start opens its turn.  An end closes its turn when that is open, else it clears *all* open turns.
    An end is a clear when its turn has no start since the turn's last end, or when another clear lies
    between that start and it.  The second case is settled by composition (``_clears``) in a fixed number of jobs, and no
    thread is folded in a single task.
    """
    keys = list(by)
    t = turns.withColumn("__turn", F.coalesce(F.col(turn), F.when(F.col(started), F.concat(F.lit("o"), F.col(order).cast("string")))))
    t = previous_row(t, [*keys, "__turn"], order, [order, started], "__before")
    matched = F.when(F.col("__before")[started], F.col("__before")[order])
    t = t.withColumn("__opened", F.when(~F.col(started) & F.col("__turn").isNotNull(), matched)).drop("__before")
    t = cut_lineage(t)  # read twice below
    clears = _clears(t.where(~F.col(started)), keys, order)
    t = t.join(clears, F.expr(" AND ".join(f"`{k}` <=> `__clear_{k}`" for k in [*keys, order])), "left")
    t = cut_lineage(t.withColumn("is_clear", F.col(f"__clear_{order}").isNotNull()).drop(*[f"__clear_{k}" for k in [*keys, order]]))
    # within one epoch (between clears) the number of open turns is a running total
    t = running_total(t, by, order, F.col("is_clear").cast("bigint"), "__epoch")
    epoch = [*keys, "__epoch"]
    t = previous_row(t, [*epoch, "__turn"], order, [started], "__same")
    was_open = F.coalesce(F.col("__same")[started], F.lit(False))
    change = F.when(F.col(started) & ~was_open, 1).when(~F.col(started) & ~F.col("is_clear") & was_open, -1).otherwise(0)
    t = running_total(t, epoch, order, change.cast("bigint"), "open_after")
    return t.drop("__turn", "__opened", "__epoch", "__same")


def open_turns(turns: DataFrame, by: Sequence[str] = ("file",), order: str = "ord", **names: str) -> DataFrame:
    """Per thread: open turns now, turns started, how the last one ended, where the set was last emptied."""
    started = names.get("started", "started")
    scanned = scan_turns(turns, by, order, **names)
    ended = ~F.col(started)
    return scanned.groupBy(*by).agg(
        F.max_by("open_after", order).alias("open_turns"),
        F.count_if(F.col(started)).alias("turns"),
        F.max_by(F.col("outcome"), F.when(ended, F.col(order))).alias("last_turn_end")
        if "outcome" in turns.columns
        else F.lit(None).cast("string").alias("last_turn_end"),
        F.max(F.when(ended & (F.col("open_after") == 0), F.col(order))).alias("emptied_at"),
    )
