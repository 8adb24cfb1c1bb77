"""Events: call/result pairing, pending calls, pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

# --- fixed values: page sizes ---------------------------------------------------------------------
TAIL_DEFAULT = 150
# --- end of fixed values --------------------------------------------------------------------------


def pair_calls(
    events: DataFrame,
    by: Sequence[str] = ("session_id", "agent_key"),
    call_id: str = "tool_use_id",
    kind: str = "kind",
    order: str = "ord",
    orphans: bool = False,
) -> DataFrame:
    """One row per call id: the call's columns as ``use`` and its first result as ``result``.

    Both sides meet in one aggregation (no self join).  Results without a call are kept on request.
    """
    keys = [*by, call_id]
    rest = F.struct(*[c for c in events.columns if c not in keys])
    is_use, is_result = F.col(kind) == "tool_use", F.col(kind) == "tool_result"
    pairs = (
        events.where((is_use | is_result) & F.col(call_id).isNotNull())
        .groupBy(*keys)
        .agg(
            F.max_by(rest, F.when(is_use, F.col(order))).alias("use"),
            F.min_by(rest, F.when(is_result, F.col(order))).alias("result"),
        )
    )
    return pairs if orphans else pairs.where(F.col("use").isNotNull())


def pending_calls(
    events: DataFrame,
    by: Sequence[str] = ("session_id", "agent_key"),
    call_id: str = "tool_use_id",
    kind: str = "kind",
    order: str = "ord",
    emptied: DataFrame | None = None,
) -> DataFrame:
    """Calls without a result.  ``emptied`` (``by``, ``emptied_at``) drops those made before a thread's turns all ended."""
    out = pair_calls(events, by, call_id, kind, order).where(F.col("result").isNull())
    if emptied is not None:
        out = out.join(emptied.select(*by, "emptied_at"), list(by), "left")
        out = out.where(F.col("emptied_at").isNull() | (F.col(f"use.{order}") > F.col("emptied_at"))).drop("emptied_at")
    return out


def link_children(events: DataFrame, nodes: DataFrame, by: Sequence[str] = ("session_id",), call_id: str = "tool_use_id") -> DataFrame:
    """Tool calls with the key of the agent they started (``child_key``)."""
    child = nodes.where(F.col(call_id).isNotNull()).select(*by, call_id, F.col("agent_key").alias("child_key"))
    return events.where(F.col("kind") == "tool_use").join(child, [*by, call_id])


def event_page(
    events: DataFrame,
    by: Sequence[str] = ("session_id", "agent_key"),
    order: str = "ord",
    tail: int | None = None,
    before: int | Column | None = None,
    after: int | Column | None = None,
    limit: int | None = None,
) -> DataFrame:
    """A page of every log at once (``after`` gives all newer events, or the newest ``limit``), with ``page_start`` (pass it as ``before``) and ``truncated``.

    Tail mode keeps the newest events without splitting a source line: a row stays when fewer than
    ``tail`` events lie on later lines.  That is a ``rank`` limit, which Spark applies per input task
    before the shuffle, so a very long log does not arrive whole in one task.
    """
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    if after is not None:
        newer = events.where(F.col(order) >= after)
        n = newer.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
        if limit is None:
            return newer.withColumns({"truncated": F.lit(False), "page_start": F.lit(after).cast("bigint")})
        kept = newer.withColumn("__r", F.row_number().over(_tie_break(w, events, by, order))).where(F.col("__r") <= limit)
        out = kept.join(n, list(by)).withColumn("truncated", F.col("__n") > limit)
        return out.withColumn("page_start", F.lit(after).cast("bigint")).drop("__r", "__n")
    want = max(1, tail if tail is not None else TAIL_DEFAULT)
    older = events if before is None else events.where(F.col(order) < before)
    first = older.groupBy(*by).agg(F.min(order).alias("__first"))
    kept = older.withColumn("__r", F.rank().over(w)).where(F.col("__r") <= want)
    start = kept.groupBy(*by).agg(F.min(order).alias("page_start"))
    meta = start.join(first, list(by)).withColumn("truncated", F.col("page_start") > F.col("__first"))
    return kept.drop("__r").join(meta.drop("__first"), list(by))


def _tie_break(w, events: DataFrame, by: Sequence[str], order: str):
    ties = [F.col(c).desc() for c in ("pos", "event_id") if c in events.columns and c != order]
    return Window.partitionBy(*by).orderBy(F.col(order).desc(), *ties)


def part_page(
    events: DataFrame,
    by: Sequence[str] = ("session_id",),
    group: str = "created_ms",
    part: str = "part_id",
    updated: str = "updated_ms",
    tail: int | None = None,
    before: int | None = None,
    after: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Pages of a part store: whole parts, and parts of one millisecond are never split.

    The page is filled part by part from the newest; it ends before the part that would overflow it, then
    it is widened to the whole millisecond group it starts in.
    """
    if after is not None:
        changed = events.where(F.col(updated) > after)
        if limit is None:
            return changed
        parts = changed.select(*by, updated, part).distinct()
        w = Window.partitionBy(*by).orderBy(updated, part)
        first = parts.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit)
        return changed.join(first.drop("__r"), [*by, updated, part], "left_semi")
    want = max(1, tail if tail is not None else TAIL_DEFAULT)
    older = events if before is None else events.where(F.col(group) < before)
    sizes = older.groupBy(*by, group, part).agg(F.count(F.lit(1)).alias("__n"))
    # at most ``want`` parts can be on the page; the rank limit keeps the running sum below short
    recent = Window.partitionBy(*by).orderBy(F.col(group).desc(), F.col(part).desc())
    near = sizes.withColumn("__r", F.row_number().over(recent)).where(F.col("__r") <= want)
    filled = near.withColumn("__sum", F.sum("__n").over(recent.rowsBetween(Window.unboundedPreceding, 0)))
    start = filled.where(F.col("__sum") <= want).groupBy(*by).agg(F.min(group).alias("page_start"))
    # a first part larger than the page leaves an empty page, as the newest part is dropped whole
    kept = older.join(start, list(by)).where(F.col(group) >= F.col("page_start"))
    first = older.groupBy(*by).agg(F.min(group).alias("__first"))
    return kept.join(first, list(by)).withColumn("truncated", F.col("page_start") > F.col("__first")).drop("__first")


def position_page(events: DataFrame, by: Sequence[str], position: str, tail: int | None = None, before: int | None = None, after: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages addressed by event position (0-based).  ``reset`` says the cursor lies beyond the end."""
    total = events.groupBy(*by).agg((F.max(position) + 1).alias("total"))
    e = events.join(total, list(by))
    if after is not None:
        reset = F.col("total") < after
        start = F.greatest(F.when(reset, F.lit(0)).otherwise(F.lit(after)), F.lit(0))
        low = start if limit is None else F.greatest(start, F.col("total") - limit)
        out = e.where(F.col(position) >= low)
        return out.withColumns({"page_start": low, "truncated": low > start, "reset": reset})
    want = max(1, tail if tail is not None else TAIL_DEFAULT)
    end = F.col("total") if before is None else F.least(F.col("total"), F.lit(before))
    low = F.greatest(F.lit(0), end - want)
    out = e.where((F.col(position) >= low) & (F.col(position) < end))
    return out.withColumns({"page_start": low, "truncated": low > 0, "reset": F.lit(False)})


def task_prompts(events: DataFrame, by: Sequence[str] = ("session_id", "agent_key"), order: str = "ord") -> DataFrame:
    """The first user event of each sub-agent is its task."""
    user = events.where((F.col("kind") == "user") & (F.col("agent_key") != "main"))
    rest = [c for c in events.columns if c not in by]
    got = user.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("__e"))
    return got.select(*by, *[F.col(f"__e.{c}").alias(c) for c in rest])


def kind_counts(events: DataFrame, kinds: Sequence[str], by: Sequence[str] = ("session_id", "agent_key"), kind: str = "kind") -> DataFrame:
    """Events of each kind per agent, one column per kind."""
    return events.groupBy(*by).agg(*[F.count_if(F.col(kind) == k).alias(k) for k in kinds])


def search_score(text: Column, query: str) -> Column:
    """Score of a keyword query: every word must occur; 3 at the start, 2 after a space, else 1."""
    from tracelake.functions.topic_text import lower_tr

    hay = lower_tr(text)
    words = [w for w in query.replace("İ", "i").replace("I", "ı").lower().split() if w]
    if not words:
        return F.lit(1)
    score = F.lit(0)
    found = F.lit(True)
    for w in words:
        at = F.instr(hay, w)
        found = found & (at > 0)
        score = score + F.when(at == 1, 3).when(F.substr(hay, at - 1, F.lit(1)) == " ", 2).otherwise(1)
    return F.when(found, score).otherwise(F.lit(0))


def search(df: DataFrame, text: Column, query: str, limit: int = 60, ties: Sequence[Column] = ()) -> DataFrame:
    """The best ``limit`` rows for a keyword query."""
    scored = df.withColumn("score", search_score(text, query)).where(F.col("score") > 0)
    return scored.orderBy(F.col("score").desc(), *ties).limit(limit)
