"""Rollout logs: one append-only file per thread plus a thread index and spawn edges.

Raw rows are ``file, thread_id, ord, value, mtime, archived``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import clean_stored_title, clip_line, iso_ms, js_trim, let, local_day, mask_secrets, nz, one_line, safe_text
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets, tick_offsets
from tracelake.operators.state import end_columns, infer_state, open_turns
from tracelake.operators.tree import resolve_tree
from tracelake.operators.usage import choose_usage, dedup_usage, normalise_usage, usage_from_totals, with_carried_model
from tracelake.plans.tool_calls import rollout_call

LAYOUT = "rollout"
# --- fixed values ---------------------------------------------------------------------------------
#: Lines that no aggregate reads anything of but their time.
SKIP_TYPES = ("world_state", "compacted")
THREAD_ID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
KIND_LABELS = {"desktop": "desktop app", "cli": "CLI", "exec": "exec", "subagent": "sub-agent", "other": "other"}
# --- end of fixed values --------------------------------------------------------------------------

_COUNTS = "struct<input_tokens:double,output_tokens:double,cached_input_tokens:double,cache_write_input_tokens:double>"
PAYLOAD = (
    "struct<type:string,id:string,role:string,name:string,namespace:string,call_id:string,arguments:string,input:string,output:string,"
    "content:string,summary:string,turn_id:string,response_id:string,model:string,cwd:string,effort:string,reasoning_effort:string,"
    f"usage:{_COUNTS},info:struct<total_token_usage:{_COUNTS}>,duration_ms:double,reason:string,goal:string,source:string,"
    "parent_thread_id:string,originator:string,cli_version:string,thread_source:string,agent_nickname:string,agent_path:string,"
    "model_provider:string,timestamp:string>"
)
KEYS = ["file", "thread_id", "ord"]


def peek(raw: DataFrame) -> DataFrame:
    """Timestamp, type and payload type of a line, wherever they stand in it; the rest is skipped unparsed."""
    head = F.from_json("value", "timestamp string, type string, payload struct<type:string>")
    out = raw.withColumn("__head", F.when(J.is_object_text(F.col("value")), head))
    return out.withColumns(
        {"ts_ms": iso_ms("__head.timestamp"), "head_type": nz("__head.type"), "head_ptype": nz("__head.payload.type")}
    ).drop("__head")


def worth_parsing() -> Column:
    return ~F.coalesce(F.col("head_type").isin(*SKIP_TYPES), F.lit(False))


def parse_lines(raw: DataFrame, for_events: bool = False) -> DataFrame:
    """Parsed lines.  For aggregates, lines of irrelevant types keep their time but are not parsed."""
    p = peek(raw)
    value = F.col("value") if for_events else F.when(worth_parsing(), F.col("value"))
    ok = J.is_object_text(value)
    j = F.when(ok, F.from_json(value, f"timestamp string, ordinal bigint, type string, payload {PAYLOAD}"))
    return p.withColumn("j", j).select(
        *KEYS,
        *[c for c in ("mtime", "archived") if c in raw.columns],
        "ts_ms",
        "head_type",
        nz("j.timestamp").alias("timestamp"),
        F.col("j.ordinal").alias("ordinal"),
        F.when(F.col("j").isNotNull(), F.coalesce(nz("j.type"), F.lit("unknown"))).alias("type"),
        F.col("j.payload").alias("p"),
        nz("j.payload.type").alias("ptype"),
    )


def block_texts(content: Column, types: tuple[str, ...]) -> Column:
    """Texts of the wanted blocks; images become a bracketed word; plain text is one block."""

    def listed(items: Column) -> Column:
        kind = lambda b: F.coalesce(F.get_json_object(b, "$.type"), F.lit(""))
        return F.filter(
            F.transform(
                F.filter(items, lambda b: F.startswith(b, F.lit("{"))),
                lambda b: F.when(kind(b).isin(*types), nz(F.get_json_object(b, "$.text"))).when(
                    kind(b).isin("input_image", "image"), F.lit("[image]")
                ),
            ),
            lambda t: t.isNotNull(),
        )

    empty = F.array().cast("array<string>")
    return let(
        F.when(F.startswith(content, F.lit("[")), F.from_json(content, "array<string>")),
        lambda items: F.when(items.isNotNull(), listed(items)).when(content.isNotNull(), F.array(content)).otherwise(empty),
    )


def is_plumbing(t: Column) -> Column:
    """Injected context such as ``<environment_context>``; images are not."""
    s = F.regexp_replace(t, "^\\s+", "")
    return s.rlike("(?i)^<[a-z_][\\w-]*[\\s>]") & ~s.rlike("(?i)^<image")


def output_text(output: Column) -> Column:
    """``struct(text, is_error)`` of a call output: plain text, a JSON envelope, an object or blocks."""
    blocks = lambda v: F.array_join(block_texts(v, ("input_text", "output_text", "text")), "\n")

    def build(m: Column) -> Column:
        text_out = F.get_json_object(output, "$.output")
        is_text = F.schema_of_variant(F.try_element_at(m, F.lit("output"))) == "STRING"
        code = F.get_json_object(output, "$.metadata.exit_code").cast("double")
        inner = F.coalesce(F.get_json_object(output, "$.content"), text_out)
        failed = F.get_json_object(output, "$.success") == "false"
        as_obj = F.when(F.coalesce(is_text, F.lit(False)) & ~F.coalesce(failed, F.lit(False)), F.struct(text_out.alias("text"), F.coalesce(code != 0, F.lit(False)).alias("is_error"))).otherwise(
            F.struct(F.coalesce(blocks(inner), F.lit("")).alias("text"), F.coalesce(failed, F.lit(False)).alias("is_error"))
        )
        listed = let(blocks(output), lambda t: F.struct(t.alias("text"), t.rlike("(?i)^Script (failed|error|threw)").alias("is_error")))
        plain = F.struct(F.coalesce(output, F.lit("")).alias("text"), F.lit(False).alias("is_error"))
        return (
            F.when(m.isNotNull() & (is_text | F.get_json_object(output, "$.content").isNotNull() | failed.isNotNull()), as_obj)
            .when(F.startswith(output, F.lit("[{")), listed)
            .otherwise(plain)
        )

    return let(J.obj(output), build)


def _seconds(ms: Column) -> Column:
    s = F.round(ms / 1000).cast("bigint")
    return let(s, lambda x: F.when(x < 60, F.concat(x.cast("string"), F.lit(" s"))).otherwise(
        F.concat(F.floor(x / 60).cast("string"), F.lit(" min "), F.lpad((x % 60).cast("string"), 2, "0"), F.lit(" s"))))


def events(raw: DataFrame, max_text: int | None = None, max_result: int | None = None) -> DataFrame:
    """Neutral events: at most one per line, with id ``b<ord>:0``."""
    lines = parse_lines(raw, for_events=True)
    p, pt, t = F.col("p"), F.col("ptype"), F.col("type")
    is_call = (t == "response_item") & pt.isin("function_call", "custom_tool_call")
    is_out = (t == "response_item") & pt.isin("function_call_output", "custom_tool_call_output")
    para = lambda parts: js_trim(F.array_join(parts, "\n\n"))
    said = para(block_texts(p["content"], ("output_text", "text")))
    asked = para(F.filter(block_texts(p["content"], ("input_text", "text")), lambda x: ~is_plumbing(x)))
    handed = para(block_texts(p["content"], ("input_text", "output_text", "text")))
    thought = para(
        F.filter(F.transform(F.from_json(p["summary"], "array<string>"), lambda b: nz(F.get_json_object(b, "$.text"))), lambda x: x.isNotNull())
    )
    spoken = (
        F.when((pt == "message") & (p["role"] == "assistant"), said)
        .when((pt == "message") & (p["role"] == "user"), asked)
        .when(pt == "agent_message", handed)
        .when(pt == "reasoning", thought)
    )
    goal = F.coalesce(nz(F.get_json_object(p["goal"], "$.objective")), nz(F.get_json_object(p["goal"], "$.title")), F.when(~F.startswith(p["goal"], F.lit("{")), nz(p["goal"])))
    tail = lambda sep, c: F.coalesce(F.concat(F.lit(sep), c), F.lit(""))
    noted = (
        F.when((t == "event_msg") & (pt == "task_complete"), F.concat(F.lit("Turn completed"), tail(" · ", _seconds(p["duration_ms"]))))
        .when((t == "event_msg") & (pt == "turn_aborted"), F.concat(F.lit("Turn aborted"), tail(" · ", clip_line(nz(p["reason"])))))
        .when((t == "event_msg") & (pt == "thread_goal_updated"), F.concat(F.lit("Goal updated"), tail(": ", clip_line(goal))))
        .when(t == "compacted", F.lit("Context compacted"))
    )
    staged = lines.withColumns(
        {
            "call": F.when(is_call, rollout_call(pt, p["name"], p["namespace"], p["arguments"], p["input"])),
            "out": F.when(is_out, output_text(p["output"])),
            "spoken": F.when(t == "response_item", nz(spoken)),
            "noted": noted,
        }
    )
    kind = (
        F.when(F.col("call").isNotNull(), "tool_use")
        .when(F.col("out").isNotNull(), "tool_result")
        .when(F.col("noted").isNotNull(), "notification")
        .when(F.col("spoken").isNotNull(), F.when(pt == "reasoning", "thinking").when((pt == "message") & (p["role"] == "assistant"), "assistant").otherwise("user"))
    )
    shown = staged.withColumn("kind", kind).where(F.col("kind").isNotNull())
    text = (
        F.when(F.col("kind") == "tool_use", F.coalesce(nz("call.summary"), F.col("call.target")))
        .when(F.col("kind") == "tool_result", safe_text(F.col("out.text"), max_result))
        .when(F.col("kind") == "notification", F.col("noted"))
        .otherwise(safe_text("spoken", max_text))
    )
    return shown.select(
        "file",
        F.col("thread_id").alias("session_id"),
        F.lit("main").alias("agent_key"),
        "ord",
        F.lit(0).alias("pos"),
        F.concat(F.lit("b"), F.col("ord").cast("string"), F.lit(":0")).alias("event_id"),
        "timestamp",
        "ts_ms",
        "kind",
        F.col("call.tool").alias("tool"),
        F.col("call.kind").alias("action"),
        F.when(F.col("kind").isin("tool_use", "tool_result"), nz("p.call_id")).alias("tool_use_id"),
        text.alias("text"),
        F.coalesce("out.is_error", F.lit(False)).alias("is_error"),
        F.col("call.target").alias("target"),
        F.col("call.dir").alias("dir"),
        F.col("call.detail").alias("detail"),
        F.lit(LAYOUT).alias("layout"),
    )


def parse_source(c: Column) -> Column:
    """Thread source: a word, or an object that names the parent of a sub-agent."""
    spawn = lambda k: F.coalesce(F.get_json_object(c, f"$.subagent.thread_spawn.{k}"), F.get_json_object(c, f"$.subagent.{k}"))
    parent = F.lower(spawn("parent_thread_id"))
    is_sub = F.get_json_object(c, "$.subagent").isNotNull()
    kind = (
        F.when(is_sub, "subagent").when(c == "vscode", "desktop").when(c == "cli", "cli").when(c == "exec", "exec").otherwise("other")
    )
    return F.struct(
        kind.alias("kind"),
        F.when(parent.rlike(THREAD_ID), parent).alias("parent_id"),
        spawn("depth").cast("int").alias("depth"),
        nz(spawn("agent_nickname")).alias("nickname"),
        nz(spawn("agent_path")).alias("agent_path"),
        nz(spawn("agent_role")).alias("role"),
    )


def user_prompt(p: Column) -> Column:
    parts = F.filter(block_texts(p["content"], ("input_text", "text")), lambda x: ~is_plumbing(x) & (x != "[image]"))
    return nz(safe_text(one_line(F.array_join(parts, " "))))


def thread_facts(lines: DataFrame) -> DataFrame:
    """Per thread: times, header fields, model, folder, counts, last prompt and last call."""
    p, t, pt = F.col("p"), F.col("type"), F.col("ptype")
    when = lambda cond: F.when(cond, F.col("ord"))
    meta = (t == "session_meta") & (nz(p["id"]).isNull() | (F.lower(p["id"]) == F.col("thread_id")))
    turn = t == "turn_context"
    item = t == "response_item"
    call = item & pt.isin("function_call", "custom_tool_call")
    ask = item & (pt == "message") & (F.coalesce(p["role"], F.lit("")) != "assistant")
    rows = lines.withColumn("__prompt", F.when(ask & (p["role"] == "user"), user_prompt(p)))
    args = F.struct(pt.alias("ptype"), p["name"].alias("name"), p["namespace"].alias("namespace"), p["arguments"].alias("arguments"), p["input"].alias("input"), p["call_id"].alias("call_id"))
    out = rows.groupBy("thread_id").agg(
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        F.max("mtime").alias("mtime") if "mtime" in lines.columns else F.max("ts_ms").alias("mtime"),
        F.bool_or("archived").alias("file_archived") if "archived" in lines.columns else F.lit(False).alias("file_archived"),
        F.max_by(p, when(meta)).alias("meta"),
        F.max_by(F.col("p.model"), when(turn & nz(p["model"]).isNotNull())).alias("turn_model"),
        F.max_by(F.col("p.cwd"), when(turn & nz(p["cwd"]).isNotNull())).alias("turn_cwd"),
        F.max_by(F.coalesce(nz(p["effort"]), nz(p["reasoning_effort"])), when(turn & F.coalesce(nz(p["effort"]), nz(p["reasoning_effort"])).isNotNull())).alias("effort"),
        F.count_if(call).alias("tool_calls"),
        F.count_if(item & (pt == "message") & (p["role"] == "assistant")).alias("messages"),
        F.max_by("__prompt", when(F.col("__prompt").isNotNull())).alias("last_prompt"),
        F.max_by(args, when(call)).alias("__call"),
    )
    c = F.col("__call")
    described = rollout_call(c["ptype"], c["name"], c["namespace"], c["arguments"], c["input"])
    src = parse_source(F.col("meta.source"))
    return out.withColumns(
        {
            "last_call": F.when(c.isNotNull(), described),
            "last_call_id": nz("__call.call_id"),
            "meta_source": F.when(F.col("meta").isNotNull(), src),
            "cwd": F.coalesce("turn_cwd", nz("meta.cwd")),
        }
    ).drop("__call")


def turn_events(lines: DataFrame) -> DataFrame:
    t = lines.where((F.col("type") == "event_msg") & F.col("ptype").isin("task_started", "task_complete", "turn_aborted"))
    outcome = F.when(F.col("ptype") == "task_complete", "complete").when(F.col("ptype") == "turn_aborted", "aborted")
    return t.select("thread_id", "ord", (F.col("ptype") == "task_started").alias("started"), nz("p.turn_id").alias("turn_id"), outcome.alias("outcome"))


def usage(lines: DataFrame, threads: DataFrame | None, now: int, tz: str = "UTC") -> DataFrame:
    """Usage rows per thread: per-response records (first wins), else deltas of the running totals.

    The model is the latest turn's, else the index row's, else ``unknown``.
    """
    turn = (F.col("type") == "turn_context") & nz("p.model").isNotNull()
    keep = lines.where(turn | (F.col("type") == "token_usage_record") | (F.col("ptype") == "token_count"))
    slim = keep.select(
        "thread_id", "ord", "ts_ms", "type", "ordinal", F.when(turn, F.col("p.model")).alias("model"), F.col("p.response_id").alias("response_id"),
        F.col("p.turn_id").alias("turn_id"), F.col("p.usage").alias("u"), F.col("p.info.total_token_usage").alias("total"),
    )
    if threads is not None:
        slim = slim.join(threads.select(F.col("id").alias("thread_id"), nz("model").alias("__row_model")), "thread_id", "left")
    else:
        slim = slim.withColumn("__row_model", F.lit(None).cast("string"))
    filled = with_carried_model(slim, partition=["thread_id"], fallback=F.col("__row_model"))
    base = ["thread_id", "ord", "model", local_day(F.coalesce("ts_ms", F.lit(now)), tz).alias("day")]
    counters = ["input", "output", "cache_read", "cache_create"]
    key = F.coalesce(nz("response_id"), F.concat(F.coalesce("turn_id", F.lit("")), F.lit(":"), F.coalesce(F.col("ordinal"), F.col("ord")).cast("string")))
    rec = filled.where(F.col("type") == "token_usage_record").select(*base, key.alias("message_key"), normalise_usage("inclusive", F.col("u")).alias("n"))
    rec = rec.where(F.col("n").isNotNull()).select("thread_id", "ord", "model", "day", "message_key", *[F.col(f"n.{c}").alias(c) for c in counters])
    rec = dedup_usage(rec, "message_key", "ord", "first", ["thread_id"]).drop("message_key")
    tot = filled.where(F.col("type") == "event_msg").select(*base, normalise_usage("inclusive", F.col("total")).alias("n"))
    tot = tot.where(F.col("n").isNotNull()).select("thread_id", "ord", "model", "day", *[F.col(f"n.{c}").alias(c) for c in counters])
    tot = usage_from_totals(tot, counters, ["thread_id"], "ord")
    out = choose_usage(rec.select("thread_id", "ord", "model", "day", *counters), tot, ["thread_id"])
    return out.drop("ord").withColumn("layout", F.lit(LAYOUT))


THREAD_COLUMNS = {
    "id": "string", "rollout_path": "string", "created_at": "bigint", "created_at_ms": "bigint", "updated_at": "bigint", "updated_at_ms": "bigint",
    "source": "string", "model_provider": "string", "model": "string", "reasoning_effort": "string", "cwd": "string", "title": "string",
    "first_user_message": "string", "tokens_used": "bigint", "archived": "int", "git_branch": "string", "agent_nickname": "string", "agent_role": "string",
    "agent_path": "string", "thread_source": "string", "originator": "string", "cli_version": "string",
}


def nodes(lines: DataFrame, now: int, threads: DataFrame | None = None, edges: DataFrame | None = None, prices: DataFrame | None = None, tz: str = "UTC") -> DataFrame:
    """Threads as agent trees: parent from spawn edge, index source, then the log's own header."""
    f = thread_facts(lines)
    if threads is not None:
        src = parse_source(F.col("source"))
        row = threads.select(F.lower("id").alias("thread_id"), F.struct(*[c for c in threads.columns if c != "id"], src.alias("src")).alias("row"))
        f = f.join(row, "thread_id", "left")
    else:
        cols = [F.lit(None).cast(t).alias(c) for c, t in THREAD_COLUMNS.items() if c != "id"]
        f = f.withColumn("row", F.struct(*cols, parse_source(F.lit(None).cast("string")).alias("src")))
    if edges is not None:
        e = edges.select(F.lower("child_thread_id").alias("thread_id"), F.lower("parent_thread_id").alias("edge_parent"))
        f = f.join(e.groupBy("thread_id").agg(F.max("edge_parent").alias("edge_parent")), "thread_id", "left")
    else:
        f = f.withColumn("edge_parent", F.lit(None).cast("string"))
    f = f.join(open_turns(turn_events(lines), ["thread_id"]), "thread_id", "left")
    own = F.lower(nz("meta.parent_thread_id"))
    f = f.withColumns(
        {
            "archived": F.col("file_archived") | (F.coalesce(F.col("row.archived"), F.lit(0)) != 0),
            "index_parent": F.col("row.src.parent_id"),
            "meta_parent": F.coalesce(F.when(own.rlike(THREAD_ID), own), "meta_source.parent_id"),
            "layout": F.lit(LAYOUT),
        }
    )
    f = S.first_known_parent(f, ["edge_parent", "index_parent", "meta_parent"], "thread_id")
    f = infer_state(f, LAYOUT, now)
    created = F.coalesce("row.created_at_ms", F.col("row.created_at") * 1000)
    f = f.withColumns({"started_at": F.coalesce("first_ts", created), "last_activity_at": F.greatest(F.coalesce("last_ts", F.lit(0)), F.coalesce("mtime", F.lit(0)))})
    f = f.withColumns(end_columns(now, ("running", "idle")))
    tree = resolve_tree(f, "thread_id", "parent", order=[F.col("started_at").isNull(), F.col("started_at")])
    nick = F.coalesce(nz("row.agent_nickname"), "row.src.nickname", nz("meta.agent_nickname"), "meta_source.nickname")
    path = F.coalesce(nz("row.agent_path"), "row.src.agent_path", nz("meta.agent_path"), "meta_source.agent_path")
    task = F.try_element_at(F.filter(F.split(path, "/"), lambda x: x != ""), F.lit(-1))
    main = F.col("parent").isNull()
    short = F.substring("thread_id", 1, 8)
    name = F.coalesce(clean_stored_title(F.col("row.title")), clean_stored_title(F.col("row.first_user_message")), clean_stored_title("last_prompt"), nick, short)
    ends = F.coalesce(F.col("emptied_at"), F.lit(-1).cast("bigint"))
    out = tree.withColumns(
        {
            "session_id": F.col("root"),
            "is_main": main,
            "agent_key": F.when(main, F.lit("main")).otherwise(F.col("thread_id")),
            "parent_key": F.when(F.col("parent") == F.col("root"), F.lit("main")).otherwise(F.col("parent")),
            "task": task,
            "label": F.when(main, mask_secrets(name)).otherwise(mask_secrets(F.coalesce(task, nick, F.concat(F.lit("agent "), short)))),
            "agent_type": F.when(main, F.lit("main")).otherwise(mask_secrets(F.coalesce(nz("row.agent_role"), "row.src.role", nick, F.lit("sub-agent")))),
            "model": F.coalesce(nz("turn_model"), nz("row.model")),
            "end_reason": F.when(F.col("state") == "stopped", F.lit("Turn aborted")),
            "cwd": mask_secrets(F.coalesce("cwd", nz("row.cwd"))),
            "git_branch": mask_secrets(nz("row.git_branch")),
            "version": F.coalesce(nz("row.cli_version"), nz("meta.cli_version")),
            "kind": F.coalesce("row.src.kind", "meta_source.kind", F.lit("other")),
            "emptied_at": ends,
        }
    )
    # the current action shows only while its call waits for an answer
    answered = lines.where(F.col("ptype").isin("function_call_output", "custom_tool_call_output")).select("thread_id", nz("p.call_id").alias("last_call_id")).distinct()
    asked = lines.where(F.col("ptype").isin("function_call", "custom_tool_call")).groupBy("thread_id", nz("p.call_id").alias("last_call_id")).agg(F.max("ord").alias("__asked"))
    out = out.join(answered.withColumn("__answered", F.lit(True)), ["thread_id", "last_call_id"], "left").join(asked, ["thread_id", "last_call_id"], "left")
    pending = F.col("__answered").isNull() & F.col("last_call_id").isNotNull() & (F.col("__asked") > F.col("emptied_at"))
    out = out.withColumn("last_action", F.when((F.col("state") == "running") & pending, F.col("last_call"))).drop("__answered", "__asked", "last_call")
    spawned = spawn_calls(lines)
    out = out.join(spawned, (out["parent"] == spawned["__owner"]) & (out["task"] == spawned["__task"]), "left").drop("__owner", "__task")
    ticks = lines.where((F.col("type") == "response_item") & F.col("ptype").isin("function_call", "custom_tool_call"))
    starts = out.select("thread_id", "started_at")
    out = out.join(tick_offsets(ticks.select("thread_id", "ts_ms").join(starts, "thread_id"), ["thread_id"]), "thread_id", "left")
    if prices is not None:
        ids = out.select("thread_id", "session_id", "agent_key")
        u = usage(lines, threads, now, tz).join(ids, "thread_id")
        out = S.node_usage(out, u, prices)
    drop = ["meta", "row", "meta_source", "edge_parent", "index_parent", "meta_parent", "file_archived", "turn_model", "turn_cwd", "emptied_at", "last_call_id"]
    return out.drop(*drop)


def spawn_calls(lines: DataFrame) -> DataFrame:
    """Calls that start an agent, by owner thread and task name (the latest one)."""
    # a filter on parsed columns would be pushed below the parsing and repeat it for each of its conditions; one behind a
    # generated row is not
    line = F.struct("thread_id", "ord", "ptype", F.col("p.name").alias("name"), F.col("p.call_id").alias("call_id"), F.col("p.arguments").alias("arguments"))
    starts = lambda x: (x["ptype"] == "function_call") & F.endswith(x["name"], F.lit("spawn_agent")) & nz(x["call_id"]).isNotNull()
    calls = lines.select(F.explode(F.filter(F.array(line), starts)).alias("c"))
    task = let(J.obj(F.col("c.arguments")), lambda m: J.text(m, "task_name", "agent_nickname", "name"))
    named = calls.select(F.col("c.thread_id").alias("__owner"), F.explode(F.filter(F.array(task), lambda t: t.isNotNull())).alias("__task"), F.col("c.call_id").alias("tool_use_id"), F.col("c.ord").alias("ord"))
    return named.groupBy("__owner", "__task").agg(F.max_by("tool_use_id", "ord").alias("tool_use_id"))


def sessions(tree: DataFrame, raw: DataFrame, now: int) -> DataFrame:
    """Session summaries of thread trees."""
    p = peek(raw).where(F.col("head_type") == "response_item").join(tree.select("thread_id", "session_id"), "thread_id")
    line = activity_buckets(p, ["session_id"], "ts_ms", now).select("session_id", F.struct("end", "counts").alias("activity"))
    main = tree.where("is_main")
    fields = main.select(
        "session_id", F.col("label").alias("session_name"), "cwd", "git_branch", "version", "last_prompt", "kind", F.col("started_at").alias("main_started_at")
    )
    out = S.session_summary(tree, fields.join(line, "session_id", "left"))
    return out.withColumn("started_at", F.when(F.col("live"), F.col("main_started_at"))).drop("main_started_at")


def read_threads(threads: DataFrame, since_ms: int, edges: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Index rows updated since a time (of these the newest ``limit``, if given), plus all ancestors they lack."""
    from tracelake.operators.tree import add_missing_ancestors
    from tracelake.sources.tables import select_known

    t = select_known(threads, THREAD_COLUMNS, ("id", "rollout_path"))
    t = t.withColumn("id", F.lower("id")).where(F.col("id").rlike(THREAD_ID) & nz("rollout_path").isNotNull())
    updated = F.coalesce(F.col("updated_at_ms"), F.col("updated_at") * 1000)
    recent = t.where(updated >= since_ms)
    if limit is not None:
        recent = recent.orderBy(updated.desc(), "id").limit(limit)
    src = t.withColumn("__parent", parse_source(F.col("source"))["parent_id"])
    if edges is not None:
        e = edges.groupBy(F.lower("child_thread_id").alias("id")).agg(F.max(F.lower("parent_thread_id")).alias("__edge"))
        src = src.join(e, "id", "left").withColumn("__parent", F.coalesce("__edge", "__parent")).drop("__edge")
    return add_missing_ancestors(recent, src, "id", "__parent").drop("__parent")


