"""Store tables with drifting columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def select_known(df: DataFrame, columns: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """The wanted columns only, typed; a missing optional column is null, a missing key is an error."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"unexpected table layout, missing columns: {', '.join(lacking)}")
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


SESSION = {
    "id": "string", "parent_id": "string", "title": "string", "directory": "string", "agent": "string", "model": "string", "version": "string",
    "time_created": "bigint", "time_updated": "bigint", "cost": "double", "tokens_input": "bigint", "tokens_output": "bigint",
    "tokens_reasoning": "bigint", "tokens_cache_read": "bigint", "tokens_cache_write": "bigint",
}
MESSAGE = {"id": "string", "session_id": "string", "time_created": "bigint", "time_updated": "bigint", "data": "string"}
PART = {"id": "string", "message_id": "string", "session_id": "string", "time_created": "bigint", "time_updated": "bigint", "data": "string"}
CHAIN_SESSION = {
    "session_id": "string", "session_name": "string", "committed_head_entry_id": "string", "session_json": "string", "updated_timestamp": "bigint",
    "is_transient": "boolean", "suggested_session_name": "string", "is_temporary": "boolean", "parent_session_id": "string", "companion_session_as": "string",
    "project_id": "string",
}
CHAIN_ENTRY = {"id": "string", "previous_id": "string", "entry_json": "string", "project_id": "string"}
#: ``preview`` and ``raw_summary`` are never selected.
SUMMARY = {
    "conversation_id": "string", "title": "string", "agent_name": "string", "source": "string", "step_count": "int", "last_modified_time": "string",
    "last_user_input_time": "string", "workspace_uris": "string", "status": "string", "not_fully_idle": "string", "killed": "string",
    "parent_conversation_id": "string", "nesting_depth": "int", "battle_id": "string", "winning_conversation_id": "string",
}


def read_part_store(sessions: DataFrame, messages: DataFrame, parts: DataFrame, limit: int | None = None):
    """The three part store tables.  With a ``limit``, only the newest sessions, and their messages and parts."""
    s = select_known(sessions, SESSION, ("id",)).where(F.col("id").rlike("^ses_[A-Za-z0-9]{6,64}$"))
    m, p = select_known(messages, MESSAGE, ("id", "session_id", "data")), select_known(parts, PART, ("id", "session_id", "data"))
    if limit is not None:
        s = s.orderBy(F.col("time_updated").desc(), "id").limit(limit)
        kept = s.select(F.col("id").alias("session_id"))
        m, p = m.join(kept, "session_id", "left_semi").select(*MESSAGE), p.join(kept, "session_id", "left_semi").select(*PART)
    return s, m, p


def read_chain_store(sessions: DataFrame, entries: DataFrame):
    """Chain store sessions and entries; the store of a project is told by ``project_id``."""
    return select_known(sessions, CHAIN_SESSION, ("session_id",)), select_known(entries, CHAIN_ENTRY, ("id", "entry_json"))


def read_summaries(tables: Sequence[DataFrame], previous: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The summary tables one after the other; the first table that knows an id wins.

    A table with an unexpected layout is skipped; when every table is, the previous snapshot stays.  With a
    ``limit``, only the newest rows of each table are read.
    """
    good: list[DataFrame] = []
    for i, t in enumerate(tables):
        try:
            rows = select_known(t, SUMMARY, ("conversation_id", "last_modified_time"))
        except ValueError:
            continue
        if limit is not None:
            rows = rows.orderBy(F.col("last_modified_time").desc(), "conversation_id").limit(limit)
        good.append(rows.withColumn("__source", F.lit(i)))
    if not good:
        if previous is None:
            raise ValueError("no readable summary table")
        return previous
    union = good[0]
    for g in good[1:]:
        union = union.unionByName(g)
    ok = union.where(F.col("conversation_id").rlike("(?i)^[0-9a-z][0-9a-z_-]{5,79}$"))
    rest = [c for c in SUMMARY if c != "conversation_id"]
    first = ok.groupBy("conversation_id").agg(F.min_by(F.struct(*rest), "__source").alias("__r"))
    return first.select("conversation_id", *[F.col(f"__r.{c}").alias(c) for c in rest])


def changed_since(rows: DataFrame, cursor_ms: int, updated: str = "time_updated") -> DataFrame:
    """Rows past a high-water mark (read the next mark with :func:`high_water`)."""
    return rows.where(F.col(updated) > cursor_ms)


def high_water(rows: DataFrame, cursor_ms: int, updated: str = "time_updated") -> int:
    return rows.agg(F.coalesce(F.max(updated), F.lit(cursor_ms)).cast("bigint")).first()[0]


def upsert(current: DataFrame, changes: DataFrame, key: str = "id", updated: str = "time_updated") -> DataFrame:
    """The latest version of every row."""
    both = current.unionByName(changes)
    rest = [c for c in current.columns if c != key]
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), updated).alias("__r"))
    return last.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*current.columns)
