"""The append-only line log: raw lines to events, usage, agent trees and sessions.

Raw rows are ``file, session_id, agent_key, ord, value, mtime`` (see ``tracelake.sources``); ``ord`` is the
order of the line in its file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import iso_ms, js_trim, local_day, mask_secrets, nz, safe_text
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets, tick_offsets
from tracelake.operators.state import agent_mode, end_columns, infer_state
from tracelake.operators.tree import cut_cycles, resolve_tree
from tracelake.operators.usage import dedup_usage, normalise_usage, with_carried_model
from tracelake.plans.tool_calls import line_log_call

LAYOUT = "line_log"
USAGE = (
    "struct<input_tokens:double,output_tokens:double,cache_read_input_tokens:double,cache_creation_input_tokens:double,"
    "cache_creation:struct<ephemeral_1h_input_tokens:double>>"
)
LINE = (
    "type string, uuid string, timestamp string, sessionId string, cwd string, gitBranch string, slug string, version string, "
    "entrypoint string, customTitle string, agentName string, lastPrompt string, operation string, content string, "
    "isApiErrorMessage boolean, isMeta boolean, toolUseResult string, "
    f"message struct<role:string,id:string,model:string,stop_reason:string,content:string,usage:{USAGE}>"
)
BLOCK = "type string, text string, thinking string, name string, id string, input string, tool_use_id string, content string, is_error boolean"
NO_BLOCKS = "array<struct<type:string,text:string,thinking:string,name:string,id:string,input:string,tool_use_id:string,content:string,is_error:boolean>>"
KEYS = ["file", "session_id", "agent_key", "ord"]


def _is_list(line: Column, content: Column, path: str) -> Column:
    """JSON lists and texts look alike once read as text; only a list has an item 0."""
    return F.startswith(content, F.lit("[")) & ((content == "[]") | F.get_json_object(line, path + "[0]").isNotNull())


def parse_lines(raw: DataFrame) -> DataFrame:
    """One row per well-formed line, with its header fields and its content blocks."""
    ok = raw.where(J.is_object_text("value")).withColumn("j", F.from_json("value", LINE))
    kind = F.coalesce(nz("j.type"), F.lit("unknown"))
    spoken = kind.isin("assistant", "user")
    role = F.col("j.message.role")
    model = nz("j.message.model")
    content = F.col("j.message.content")
    items = J.blocks(content, _is_list(F.col("value"), content, "$.message.content"), BLOCK)
    usage = normalise_usage("direct", F.col("j.message.usage"))
    head = ok.select(
        *KEYS,
        *([F.col("mtime")] if "mtime" in raw.columns else []),
        kind.alias("type"),
        nz("j.timestamp").alias("timestamp"),
        iso_ms("j.timestamp").alias("ts_ms"),
        nz("j.uuid").alias("uuid"),
        nz("j.sessionId").alias("log_session_id"),
        nz("j.cwd").alias("cwd"),
        nz("j.gitBranch").alias("git_branch"),
        nz("j.slug").alias("slug"),
        nz("j.version").alias("version"),
        nz("j.entrypoint").alias("entrypoint"),
        F.when(kind == "custom-title", nz("j.customTitle")).alias("custom_title"),
        F.when(kind == "agent-name", nz("j.agentName")).alias("agent_name"),
        F.when(kind == "last-prompt", safe_text(nz("j.lastPrompt"))).alias("last_prompt"),
        F.when(spoken & role.isin("assistant", "user"), role).alias("role"),
        F.when(spoken, nz("j.message.id")).alias("message_id"),
        F.when(spoken & (model != "<synthetic>"), model).alias("model"),
        F.when(spoken, F.col("j.message.stop_reason")).alias("stop_reason"),
        F.when(spoken, usage).alias("usage"),
        (spoken & F.coalesce(F.col("j.isApiErrorMessage"), F.lit(False))).alias("is_api_error"),
        F.coalesce(F.col("j.isMeta"), F.lit(False)).alias("is_meta"),
        F.col("j.operation").alias("operation"),
        F.when(kind == "queue-operation", F.col("j.content")).alias("queued"),
        F.when(kind == "user", nz(F.get_json_object(F.col("j.toolUseResult"), "$.agentId"))).alias("result_agent_id"),
        F.when(spoken, items).alias("blocks"),
    )
    return head.withColumn("blocks", F.coalesce("blocks", F.array().cast(NO_BLOCKS)))


def _tool_blocks() -> Column:
    return F.filter("blocks", lambda b: b["type"] == "tool_use")


def plain_text() -> Column:
    spoken = F.array_join(
        F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "\n"
    )
    return F.when(F.col("type") == "queue-operation", F.coalesce("queued", F.lit(""))).otherwise(spoken)


def notifications(lines: DataFrame) -> DataFrame:
    """Task notifications found in user lines and enqueued operations, one row each."""
    where = (F.col("type") == "user") | ((F.col("type") == "queue-operation") & (F.col("operation") == "enqueue"))
    text = plain_text()
    bodies = F.regexp_extract_all(text, F.lit("<task-notification>([\\s\\S]*?)</task-notification>"), F.lit(1))
    rows = lines.where(where & F.contains(text, F.lit("<task-notification>"))).select(
        *KEYS, "type", "uuid", "timestamp", "ts_ms", F.explode(bodies).alias("body")
    )
    tag = lambda name: nz(js_trim(F.regexp_extract("body", f"<{name}>([\\s\\S]*?)</{name}>", 1)))
    out = rows.select(
        *KEYS,
        "type",
        "uuid",
        "timestamp",
        "ts_ms",
        tag("task-id").alias("task_id"),
        tag("tool-use-id").alias("tool_use_id"),
        tag("status").alias("status"),
        safe_text(tag("summary")).alias("summary"),
    )
    return out.where(F.col("task_id").isNotNull())


def result_text(content: Column) -> Column:
    """Tool result content as text: images and other blocks become a bracketed word."""
    items = F.from_json(content, "array<string>")
    word = lambda b: F.get_json_object(b, "$.type")
    shown = F.transform(
        F.filter(items, lambda b: F.startswith(b, F.lit("{"))),
        lambda b: F.when(word(b) == "text", F.coalesce(F.get_json_object(b, "$.text"), F.lit("")))
        .when(word(b) == "image", F.lit("[image]"))
        .otherwise(F.concat(F.lit("["), F.coalesce(nz(word(b)), F.lit("block")), F.lit("]"))),
    )
    listed = F.array_join(F.filter(shown, lambda t: t != ""), "\n")
    is_list = F.startswith(content, F.lit("[")) & items.isNotNull()
    return F.coalesce(F.when(is_list, listed).when(~F.startswith(content, F.lit("{")), content), F.lit(""))


EVENT = "struct<pos:int,kind:string,tool:string,action:string,tool_use_id:string,text:string,is_error:boolean,detail:map<string,string>>"


def events(lines: DataFrame, max_text: int | None = None, max_result: int | None = None) -> DataFrame:
    """Neutral events: one row per visible block, or per notification for lines that carry some."""
    spoken = lines.where(F.col("type").isin("assistant", "user"))
    noted = (F.col("type") == "user") & F.regexp_like(
        plain_text(), F.lit("<task-notification>[\\s\\S]*?<task-id>\\s*\\S[\\s\\S]*?</task-id>[\\s\\S]*?</task-notification>")
    )
    b = spoken.where(~noted).select(*KEYS, "type", "uuid", "timestamp", "ts_ms", "is_meta", F.posexplode("blocks").alias("pos", "b"))
    body = js_trim(F.coalesce("b.text", F.lit("")))
    thought = js_trim(F.coalesce("b.thinking", F.lit("")))
    tool = F.coalesce(nz("b.name"), F.lit("tool"))
    a, u, bt = F.col("type") == "assistant", F.col("type") == "user", F.col("b.type")
    kind = (
        F.when(a & (bt == "text") & (body != ""), "assistant")
        .when(a & (bt == "thinking") & (thought != ""), "thinking")
        .when(a & (bt == "tool_use"), "tool_use")
        .when(u & (bt == "text") & (body != "") & ~F.startswith(body, F.lit("<system-reminder>")) & ~F.col("is_meta"), "user")
        .when(u & (bt == "tool_result"), "tool_result")
        .when(u & (bt == "image"), "user")
    )
    shown = b.withColumn("kind", kind).where(F.col("kind").isNotNull())
    use = F.col("kind") == "tool_use"
    call = line_log_call(tool, F.col("b.input"))
    shown = shown.withColumn("call", F.when(use, call))
    text = (
        F.when(use, F.col("call.summary"))
        .when(F.col("kind") == "thinking", safe_text(thought, max_text))
        .when(F.col("kind") == "tool_result", safe_text(result_text(F.col("b.content")), max_result))
        .when(bt == "image", F.lit("[image]"))
        .otherwise(safe_text(body, max_text))
    )
    rows = shown.select(
        *KEYS,
        "pos",
        F.concat_ws(":", F.coalesce("uuid", F.lit("")), F.col("pos").cast("string")).alias("event_id"),
        "timestamp",
        "ts_ms",
        "kind",
        F.when(use, tool).alias("tool"),
        F.col("call.kind").alias("action"),
        F.when(use, nz("b.id")).when(F.col("kind") == "tool_result", nz("b.tool_use_id")).alias("tool_use_id"),
        text.alias("text"),
        ((F.col("kind") == "tool_result") & F.coalesce("b.is_error", F.lit(False))).alias("is_error"),
        F.col("call.target").alias("target"),
        F.col("call.dir").alias("dir"),
        F.col("call.detail").alias("detail"),
    )
    notes = notifications(spoken.where(noted))
    # the position of a notification is its rank on the line; a line holds few
    order = F.monotonically_increasing_id()
    notes = notes.withColumn("__o", order)
    from pyspark.sql import Window

    w = Window.partitionBy(*KEYS).orderBy("__o")
    tail = F.concat(F.lit(" - "), F.col("summary"))
    noted_rows = notes.withColumn("pos", F.row_number().over(w) - 1).select(
        *KEYS,
        "pos",
        F.concat_ws(":", F.coalesce("uuid", F.lit("")), F.col("pos").cast("string")).alias("event_id"),
        "timestamp",
        "ts_ms",
        F.lit("notification").alias("kind"),
        F.concat(F.lit("task "), "task_id", F.lit(" "), F.coalesce("status", F.lit("update")), F.coalesce(tail, F.lit(""))).alias("text"),
        F.lit(False).alias("is_error"),
    )
    return rows.unionByName(noted_rows, allowMissingColumns=True).withColumn("layout", F.lit(LAYOUT))


def tool_calls(lines: DataFrame, detail: bool = False) -> DataFrame:
    """One row per tool call with its kind, target and folder (and detail fields on request)."""
    calls = lines.where(F.col("type") == "assistant").select(*KEYS, "ts_ms", "cwd", F.posexplode(_tool_blocks()).alias("pos", "b"))
    tool = F.coalesce(nz("b.name"), F.lit("tool"))
    out = calls.withColumn("call", line_log_call(tool, F.col("b.input"), detail))
    fields = ["tool", "kind", "target", "dir", "summary"] + (["detail"] if detail else [])
    return out.select(
        *KEYS, "ts_ms", "cwd", "pos", nz("b.id").alias("tool_use_id"), F.col("b.input").alias("input"), *[f"call.{c}" for c in fields]
    )


def spawns(lines: DataFrame) -> DataFrame:
    """Calls that start an agent: session_id, tool_use_id, owner_key, spawn, ord."""
    rows = lines.where((F.col("type") == "assistant") & F.col("role").isNotNull()).select(*KEYS, F.explode(_tool_blocks()).alias("b"))
    m = J.obj("b.input")
    rows = rows.where(F.col("b.name").isin("Agent", "Task") & nz("b.id").isNotNull())
    spawn = F.struct(
        safe_text(J.text(m, "description")).alias("description"),
        J.text(m, "subagent_type").alias("subagent_type"),
        J.text(m, "model").alias("model"),
        F.get_json_object("b.input", "$.run_in_background").cast("boolean").alias("background"),
        J.text(m, "isolation").alias("isolation"),
    )
    return rows.select("session_id", F.col("b.id").alias("tool_use_id"), F.col("agent_key").alias("owner_key"), spawn.alias("spawn"), "ord")


def agent_links(lines: DataFrame) -> DataFrame:
    """Results that name the agent a call started (only lines with exactly one result)."""
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    rows = lines.where(F.col("result_agent_id").isNotNull() & F.col("role").isNotNull() & (F.size(results) == 1))
    out = rows.select(
        "session_id", F.col("result_agent_id").alias("agent_key"), nz(F.element_at(results, 1)["tool_use_id"]).alias("tool_use_id"), "ord"
    )
    return out.where(F.col("tool_use_id").isNotNull())


def usage(lines: DataFrame, now: int, tz: str = "UTC") -> DataFrame:
    """One row per message: session_id, agent_key, model, day and counters; the last line of a message wins."""
    assistant = F.col("role") == "assistant"
    spoken = lines.where(assistant).select("file", "session_id", "agent_key", "ord", "ts_ms", "uuid", "message_id", "model", "usage", "is_api_error")
    filled = with_carried_model(spoken, partition=["file"])
    key = F.coalesce("message_id", F.concat(F.lit("uuid:"), "uuid"))
    counted = filled.where(F.col("usage").isNotNull() & ~F.col("is_api_error")).select(
        "file",
        key.alias("message_key"),
        "ord",
        "session_id",
        "agent_key",
        "model",
        local_day(F.coalesce("ts_ms", F.lit(now)), tz).alias("day"),
        "usage.*",
    )
    won = dedup_usage(counted, "message_key", "ord", "last", ["file"])
    return won.withColumn("layout", F.lit(LAYOUT)).drop("file", "ord")


def facts(lines: DataFrame) -> DataFrame:
    """Per agent: times, last role and stop reason, model, tool calls, last action, file time."""
    last = F.element_at(_tool_blocks(), -1)
    with_tools = lines.withColumns(
        {
            "tool_calls": F.size(_tool_blocks()),
            "__last": F.when((F.col("type") == "assistant") & (F.size(_tool_blocks()) > 0), F.struct(last["name"].alias("name"), last["input"].alias("input"))),
        }
    )
    base = with_tools.withColumns({"last_tool": F.col("__last.name"), "last_action": F.to_json("__last")})
    out = S.agent_facts(base)
    # the last call is described once per agent, not once per line
    a = F.from_json("last_action", "name string, input string")
    call = line_log_call(F.coalesce(nz(a["name"]), F.lit("tool")), a["input"], detail=False)
    act = F.when(F.col("last_action").isNotNull(), F.struct(call["tool"].alias("tool"), call["kind"].alias("kind"), call["target"].alias("target"), call["dir"].alias("dir")))
    out = out.withColumn("last_action", act)
    mtime = lines.groupBy("session_id", "agent_key").agg(F.max("mtime").alias("mtime") if "mtime" in lines.columns else F.lit(None).cast("bigint").alias("mtime"))
    return out.join(mtime, ["session_id", "agent_key"])


REGISTRY = (
    "pid bigint, sessionId string, cwd string, startedAt bigint, version string, kind string, entrypoint string, name string, "
    "status string, statusUpdatedAt bigint, updatedAt bigint"
)


def nodes(
    lines: DataFrame,
    now: int,
    registry: DataFrame | None = None,
    meta: DataFrame | None = None,
    prices: DataFrame | None = None,
    stall_ms: int = 600_000,
    tz: str = "UTC",
) -> DataFrame:
    """The agent tree of every session as a flat table.

    ``registry``: session_id, alive, status, ... (one row per session).  ``meta``: session_id, agent_key,
    agent_type, description, tool_use_id, request_shape, model, worktree_branch, ...
    """
    f = facts(lines)
    meta_cols = {
        "agent_type": "string", "description": "string", "tool_use_id": "string", "spawn_depth": "int", "request_shape": "string",
        "model": "string", "worktree_branch": "string", "workflow": "string",
    }
    if meta is not None:
        m = meta.select(
            "session_id",
            "agent_key",
            *[(F.col(c) if c in meta.columns else F.lit(None).cast(t)).alias(f"meta_{c}") for c, t in meta_cols.items()],
        )
        f = f.join(m, ["session_id", "agent_key"], "left")
    else:
        f = f.withColumns({f"meta_{c}": F.lit(None).cast(t) for c, t in meta_cols.items()})
    a = S.resolve_parents(f, spawns(lines), agent_links(lines))
    notes = notifications(lines).where(F.col("status").isNotNull() & F.col("ts_ms").isNotNull())
    a = S.notification_asof(a, notes.select("session_id", F.col("task_id").alias("agent_key"), "ts_ms", "ord", "status", "summary"))
    if registry is not None:
        a = a.join(registry.select("session_id", "alive", F.col("status").alias("reg_status")), "session_id", "left")
    else:
        a = a.withColumns({"alive": F.lit(False), "reg_status": F.lit(None).cast("string")})
    a = a.withColumn("is_main", F.col("agent_key") == "main")
    a = infer_state(a, LAYOUT, now, stall_ms=stall_ms)
    running = F.col("state") == "running"
    a = a.withColumns(
        {
            "layout": F.lit(LAYOUT),
            "started_at": F.col("first_ts"),
            "last_activity_at": F.coalesce("last_ts", "mtime"),
            "model": F.coalesce("model", nz("meta_model"), "spawn.model"),
            "mode": agent_mode(F.col("is_main"), F.col("meta_request_shape"), F.col("spawn.background")),
            "label": F.coalesce(nz("meta_description"), "spawn.description", F.concat(F.lit("agent "), F.substring("agent_key", 1, 8))),
            "agent_type": F.when(F.col("is_main"), F.lit("main")).otherwise(
                F.coalesce(nz("meta_agent_type"), "spawn.subagent_type", F.lit("unknown"))
            ),
            "last_action": F.when(running, F.col("last_action")),
            "last_tool": F.when(running, F.col("last_tool")),
            "end_reason": F.when(F.col("state").isin("failed", "stopped"), F.col("note_summary")),
        }
    )
    a = a.withColumns(end_columns(now))
    a = cut_cycles(a, "agent_key", "parent_key", ["session_id"], mode="main")
    # a parent that has no log of its own means the main agent, even when that has no lines either
    tree = resolve_tree(
        a, "agent_key", "parent_key", ["session_id"], order=[F.col("started_at").isNull(), F.col("started_at")]
    )
    u = usage(lines, now, tz)
    msgs = u.groupBy("session_id", "agent_key").agg(F.count(F.lit(1)).alias("messages"))
    tree = tree.join(msgs, ["session_id", "agent_key"], "left").fillna(0, subset=["messages"])
    used = lines.where((F.col("type") == "assistant") & (F.size(_tool_blocks()) > 0)).select("session_id", "agent_key", "ts_ms")
    starts = f.select("session_id", "agent_key", F.col("first_ts").alias("started_at"))
    ticks = tick_offsets(used.join(starts, ["session_id", "agent_key"]), ["session_id", "agent_key"])
    tree = tree.join(ticks, ["session_id", "agent_key"], "left")
    tree = tree.withColumn("ticks", F.coalesce("ticks", F.array().cast("array<bigint>")))
    if prices is not None:
        tree = S.node_usage(tree, u, prices)
    drop = [c for c in tree.columns if c.startswith("meta_") and c not in ("meta_workflow", "meta_worktree_branch", "meta_spawn_depth")]
    out = tree.drop(*drop, "spawn", "note_ts", "note_status", "note_summary", "first_ts", "alive", "reg_status")
    return out.withColumnsRenamed({"meta_workflow": "workflow", "meta_worktree_branch": "worktree_branch", "meta_spawn_depth": "spawn_depth"})


def sessions(lines: DataFrame, tree: DataFrame, now: int, registry: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """Session summaries; ``titles``: session_id, title (from side files)."""
    main = lines.where(F.col("agent_key") == "main")
    fields = S.session_fields(
        main, ["cwd"], ["git_branch", "slug", "version", "entrypoint", "custom_title", "agent_name", "last_prompt"]
    )
    spoken = lines.where(F.col("type").isin("assistant", "user") & F.col("ts_ms").isNotNull())
    spark_line = activity_buckets(spoken, ["session_id"], "ts_ms", now).select("session_id", F.struct("end", "counts").alias("activity"))
    if titles is not None:
        fields = fields.join(titles.select("session_id", F.col("title").alias("file_title")), "session_id", "full_outer")
    else:
        fields = fields.withColumn("file_title", F.lit(None).cast("string"))
    fields = fields.join(spark_line, "session_id", "left")
    # the file time of an agent counts as activity
    timed = tree.withColumn("last_activity_at", F.greatest(F.coalesce("last_ts", F.lit(0)), F.coalesce("mtime", F.lit(0))))
    out = S.session_summary(timed, fields, registry)
    reg_name = nz("reg_name") if registry is not None else F.lit(None).cast("string")
    name = F.coalesce(reg_name, "custom_title", nz("file_title"), "agent_name", "slug", F.substring("session_id", 1, 8))
    out = out.withColumn("session_name", mask_secrets(name))
    if registry is not None:
        live_cwd = F.when(F.col("live"), nz("reg_cwd"))
        out = out.withColumn("cwd", mask_secrets(F.coalesce(live_cwd, "cwd", nz("reg_cwd"))))
        out = out.withColumns(
            {"version": F.coalesce(nz("reg_version"), "version"), "entrypoint": F.coalesce(nz("reg_entrypoint"), "entrypoint")}
        )
    else:
        out = out.withColumn("cwd", mask_secrets("cwd"))
    return out
