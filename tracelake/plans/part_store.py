"""The part store: sessions, messages and parts as three tables with JSON in ``data``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions.text import clip_line, mask_secrets, ms_to_ts, nz, safe_text
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets, tick_offsets
from tracelake.operators.state import end_columns, infer_state
from tracelake.operators.tree import resolve_tree, valid_parents
from tracelake.plans.tool_calls import part_call
from tracelake.session import cut_lineage

LAYOUT = "part_store"
# --- fixed values ---------------------------------------------------------------------------------
STALE_MS = 600_000
# --- end of fixed values --------------------------------------------------------------------------
DATA = (
    "type string, text string, synthetic boolean, ignored boolean, tool string, callID string, time struct<end:double>, "
    "state struct<status:string,input:string,output:string,error:string,title:string,metadata:string>"
)
MESSAGE_DATA = (
    "role string, modelID string, time struct<created:double,completed:double>, error struct<name:string,data:struct<message:string>>"
)


def iso_text(ms: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ms_to_ts(ms), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def settled(d: Column, updated: Column, now: int) -> Column:
    """A part that will not change any more: finished, or untouched for ten minutes."""
    stale = F.lit(now) - updated > STALE_MS
    done = F.coalesce(d["state"]["status"].isin("completed", "error"), F.lit(False))
    return (
        F.when(d["type"] == "tool", done | stale)
        .when(d["type"].isin("text", "reasoning"), d["time"]["end"].isNotNull() | stale)
        .otherwise(F.lit(True))
    )


def settled_parts(parts: DataFrame, now: int) -> DataFrame:
    p = parts.withColumn("d", F.from_json("data", DATA)).where(F.col("d").isNotNull())
    return p.where(settled(F.col("d"), F.col("time_updated"), now))


def events(raw: tuple[DataFrame, DataFrame], now: int | None = None, max_text: int | None = None, max_result: int | None = None) -> DataFrame:
    """Events of (messages, parts); a finished tool part yields its call and its result.

    The join to the message brings the role only, so it moves two narrow columns.
    """
    messages, parts = raw
    p = settled_parts(parts, now) if now is not None else parts.withColumn("d", F.from_json("data", DATA))
    p = p.where(F.col("d").isNotNull() & F.col("time_created").isNotNull() & F.col("time_updated").isNotNull())
    roles = messages.select(F.col("id").alias("message_id"), nz(F.get_json_object("data", "$.role")).alias("role"))
    p = p.drop("data").join(roles, "message_id", "left")
    d = F.col("d")
    tool = F.coalesce(nz(d["tool"]), F.lit("tool"))
    is_tool = d["type"] == "tool"
    p = p.withColumn("call", F.when(is_tool, part_call(tool, d["state"]["input"])))
    call = F.col("call")
    failed = d["state"]["status"] == "error"
    raw_result = F.when(failed, F.coalesce(nz(d["state"]["error"]), nz(d["state"]["output"]), F.lit("error"))).otherwise(
        F.coalesce(nz(d["state"]["output"]), nz(d["state"]["title"]), F.lit(""))
    )
    detail = "map<string,string>"

    def ev(prefix: str, kind: Column, text: Column, error: Column, is_use: bool = False) -> Column:
        pick = lambda f, t="string": (call[f] if is_use else F.lit(None)).cast(t).alias(f)
        return F.struct(
            F.concat(F.lit(prefix + ":"), F.col("id")).alias("event_id"), kind.alias("kind"), text.alias("text"), error.alias("is_error"),
            pick("tool"), pick("kind").alias("action"), pick("target"), pick("dir"), pick("detail", detail),
        )

    no = F.lit(False)
    plain = nz(d["text"]).isNotNull() & ~F.coalesce(d["synthetic"], no) & ~F.coalesce(d["ignored"], no)
    who = F.when(F.col("role") == "user", "user").otherwise("assistant")
    rows = F.array(
        F.when((d["type"] == "text") & plain, ev("p", who, d["text"], no)),
        F.when((d["type"] == "reasoning") & nz(d["text"]).isNotNull(), ev("p", F.lit("thinking"), d["text"], no)),
        F.when(is_tool, ev("p", F.lit("tool_use"), call["summary"], no, True)),
        F.when(is_tool & d["state"]["status"].isin("completed", "error"), ev("r", F.lit("tool_result"), raw_result, failed)),
    )
    out = p.select(
        "session_id",
        F.col("id").alias("part_id"),
        F.col("time_created").alias("created_ms"),
        F.col("time_updated").alias("updated_ms"),
        F.when(is_tool, F.coalesce(nz(d["callID"]), F.col("id"))).alias("tool_use_id"),
        F.posexplode(F.filter(rows, lambda e: e.isNotNull())).alias("pos", "e"),
    )
    masked = F.when(F.col("e.kind") == "tool_result", safe_text("e.text", max_result)).otherwise(safe_text("e.text", max_text)) if max_result or max_text else safe_text("e.text")
    return out.select(
        "session_id", F.lit("main").alias("agent_key"), "part_id", "created_ms", "updated_ms", F.col("created_ms").alias("ord"), "pos", "e.event_id",
        iso_text(F.col("created_ms")).alias("timestamp"), F.col("created_ms").alias("ts_ms"), "e.kind", "e.tool", "e.action", "tool_use_id",
        F.when(F.col("e.kind") == "tool_use", F.col("e.text")).otherwise(masked).alias("text"), "e.is_error", "e.target", "e.dir", "e.detail",
        F.lit(LAYOUT).alias("layout"),
    )


def nodes(sessions: DataFrame, messages: DataFrame, parts: DataFrame, now: int) -> DataFrame:
    """Session rows as agent trees with state, usage and the store's own recorded cost."""
    m = messages.select("id", "session_id", "time_created", F.from_json("data", MESSAGE_DATA).alias("d")).where(nz("d.role").isNotNull())
    created = F.coalesce(F.col("time_created"), F.col("d.time.created").cast("bigint"), F.lit(0))
    said = m.where(F.col("d.role") == "assistant").groupBy("session_id").agg(
        F.max_by(F.struct("d.modelID", "d.time.completed", "d.error"), F.struct(created, F.col("id"))).alias("last")
    )
    # behind a generated row no filter is pushed below the parsing, which would parse once more for each condition
    row = F.struct("id", "message_id", "session_id", "time_created", "time_updated", F.from_json("data", DATA).alias("d"))
    p = parts.select(F.explode(F.filter(F.array(row), lambda x: x["d"].isNotNull())).alias("r")).select("r.*")
    is_tool = F.col("d.type") == "tool"
    pending = is_tool & ~F.coalesce(F.col("d.state.status").isin("completed", "error"), F.lit(False))
    tally = p.groupBy("session_id").agg(
        F.min("time_created").alias("first_at"),
        F.count_if(is_tool).alias("tool_calls"),
        F.max_by(F.struct(F.coalesce(nz("d.tool"), F.lit("tool")).alias("tool"), F.col("d.state.input").alias("input")), F.when(pending, F.struct("time_created", "time_updated", "id"))).alias("pending"),
    )
    roles = m.where(F.col("d.role") == "user").select(F.col("id").alias("message_id"))
    shown = (F.col("d.type") == "text") & nz("d.text").isNotNull() & ~F.coalesce("d.synthetic", F.lit(False)) & ~F.coalesce("d.ignored", F.lit(False))
    prompts = p.where(shown).join(roles, "message_id", "left_semi").groupBy("session_id").agg(
        F.max_by("d.text", F.struct("time_created", "id")).alias("last_prompt")
    )
    meta = lambda k: nz(F.get_json_object("d.state.metadata", f"$.{k}"))
    kid = F.coalesce(meta("sessionId"), meta("sessionID"))
    calls = p.where((F.col("d.tool") == "task") & kid.isNotNull() & nz("d.callID").isNotNull()).groupBy(
        F.col("session_id").alias("__owner"), kid.alias("__child")
    ).agg(F.max_by("d.callID", "time_updated").alias("tool_use_id"))
    s = sessions.withColumn("parent", nz("parent_id"))
    s = valid_parents(s, "id", "parent").withColumnRenamed("id", "native_id")
    j = s.join(said.withColumnRenamed("session_id", "native_id"), "native_id", "left")
    j = j.join(tally.withColumnRenamed("session_id", "native_id"), "native_id", "left").join(prompts.withColumnRenamed("session_id", "native_id"), "native_id", "left")
    stored = F.coalesce(nz(F.get_json_object("model", "$.id")), nz(F.get_json_object("model", "$.modelID")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    j = j.withColumns(
        {
            "layout": F.lit(LAYOUT), "updated_at": zero("time_updated"), "has_last": F.col("last").isNotNull(), "completed_at": F.col("last.completed").cast("bigint"),
            "error_name": F.when(F.col("last.error").isNotNull(), F.coalesce(nz("last.error.name"), F.lit("Error"))),
            "model": F.coalesce(nz("last.modelID"), stored), "started_at": F.coalesce("first_at", F.col("time_created")), "last_activity_at": F.col("time_updated"),
            "last_ts": F.col("time_updated"), "input": zero("tokens_input"), "output": zero("tokens_output") + zero("tokens_reasoning"),
            "cache_read": zero("tokens_cache_read"), "cache_create": zero("tokens_cache_write"), "cost_usd": F.coalesce("cost", F.lit(0.0)),
        }
    )
    total = F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_create")
    j = infer_state(j.withColumns({"total_tokens": total, "cost_partial": (total > 0) & (F.col("cost_usd") == 0)}), LAYOUT, now)
    j = j.withColumns(end_columns(now, ("running", "idle")))
    call = part_call(F.col("pending.tool"), F.col("pending.input"))
    message = F.coalesce(nz("last.error.data.message"), F.col("error_name"), F.lit("Error"))
    j = j.withColumns(
        {
            "last_action": F.when((F.col("state") == "running") & F.col("pending").isNotNull(), call),
            "end_reason": F.when(F.col("state") == "stopped", F.lit("Cancelled")).when(F.col("state") == "failed", clip_line(message)),
        }
    )
    # the tree reads its nodes several times; what the parts say of a session is worked out once
    tree = resolve_tree(cut_lineage(j), "native_id", "parent", order=[F.col("started_at")])
    tree = tree.join(calls, (tree["parent"] == calls["__owner"]) & (tree["native_id"] == calls["__child"]), "left").drop("__owner", "__child")
    main = F.col("parent").isNull()
    prompt = clip_line("last_prompt")
    out = tree.withColumns(
        {
            "session_id": F.col("root"),
            "agent_key": F.when(main, F.lit("main")).otherwise(F.col("native_id")),
            "parent_key": F.when(F.col("parent") == F.col("root"), F.lit("main")).otherwise(F.col("parent")),
            "is_main": main,
            "last_prompt": prompt,
            "label": mask_secrets(F.coalesce(nz(F.trim("title")), nz(prompt), F.substring("native_id", 1, 12))),
            "agent_type": F.when(main, F.lit("main")).otherwise(F.coalesce(nz("agent"), F.lit("build"))),
        }
    )
    starts = out.select("native_id", "started_at")
    ticks = p.where(is_tool).select(F.col("session_id").alias("native_id"), F.col("time_created").alias("ts_ms")).join(starts, "native_id")
    return out.join(tick_offsets(ticks, ["native_id"]), "native_id", "left").drop("last", "pending", "cost", "data")


def sessions(tree: DataFrame, parts: DataFrame, now: int) -> DataFrame:
    """Summaries of listed session trees; text, reasoning and tool parts count as activity."""
    kind = F.get_json_object("data", "$.type")
    stamps = parts.where(kind.isin("text", "reasoning", "tool")).select(F.col("session_id").alias("native_id"), F.col("time_created").alias("ts_ms"))
    line = activity_buckets(stamps.join(tree.select("native_id", "session_id"), "native_id"), ["session_id"], "ts_ms", now)
    main = tree.where("is_main").select("session_id", F.col("label").alias("session_name"), mask_secrets("directory").alias("cwd"), "last_prompt", "version")
    fields = main.join(line.select("session_id", F.struct("end", "counts").alias("activity")), "session_id", "left")
    return S.session_summary(tree, fields)


