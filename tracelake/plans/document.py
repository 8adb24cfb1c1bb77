"""Whole-document sessions: one JSON file per session, rewritten on each change.

Raw rows are ``file, mtime, value`` (the whole text of each file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import clip_line, iso_ms, let, local_day, mask_secrets, nz, safe_text
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets, tick_offsets
from tracelake.operators.state import end_columns, infer_state
from tracelake.operators.usage import normalise_usage, with_carried_model
from tracelake.plans.part_store import iso_text
from tracelake.plans.tool_calls import document_call

LAYOUT = "document"
# --- fixed values ---------------------------------------------------------------------------------
TYPES = ("user", "gemini", "info", "error", "warning")
PENDING = ("validating", "scheduled", "awaiting_approval", "executing")
PATH_KEYS = ("file_path", "absolute_path", "dir_path", "path", "directory")
# --- end of fixed values --------------------------------------------------------------------------
_TOKENS = "struct<input:double,output:double,cached:double,thoughts:double,tool:double,total:double>"
MESSAGE = f"id string, timestamp string, type string, content string, toolCalls array<string>, thoughts array<string>, tokens {_TOKENS}, model string"
CALL = "id string, name string, args string, result string, status string, timestamp string, resultDisplay string"


def latest_documents(raw: DataFrame) -> DataFrame:
    """The newest *readable* version of every session: ``session_id, project_hash, mtime, messages``.

    A half-written file is not readable, so the previous version stays.
    """
    head = raw.select("file", "mtime", "value", F.from_json("value", "sessionId string, projectHash string, messages array<string>").alias("j"))
    ok = head.where(J.is_object_text("value") & F.col("j.messages").isNotNull() & nz("j.sessionId").isNotNull())
    best = F.max_by(F.struct("mtime", nz("j.projectHash").alias("project_hash"), F.col("j.messages").alias("messages")), "mtime")
    return ok.groupBy(F.col("j.sessionId").alias("session_id")).agg(best.alias("d")).select("session_id", "d.*")


def messages(docs: DataFrame) -> DataFrame:
    """One row per message of a known type; ``m`` is its position."""
    known = F.filter(F.transform("messages", lambda x: F.when(F.startswith(x, F.lit("{")), F.from_json(x, MESSAGE))), lambda m: m["type"].isin(*TYPES))
    return docs.select("session_id", "project_hash", "mtime", F.posexplode(known).alias("m", "msg"))


def content_text(c: Column) -> Column:
    """Plain text of a text, a part or a list of parts."""

    def part(p: Column) -> Column:
        kind = lambda path: F.get_json_object(p, path)
        as_obj = F.coalesce(
            kind("$.text"),
            nz(kind("$.functionResponse.response.output")),
            nz(kind("$.functionResponse.response.error")),
            F.when(kind("$.functionResponse").isNull() & (kind("$.inlineData").isNotNull() | kind("$.fileData").isNotNull()), F.lit("[file]")),
            F.lit(""),
        )
        return F.when(F.startswith(p, F.lit("{")), as_obj).otherwise(p)

    def build(items: Column) -> Column:
        listed = F.array_join(F.filter(F.transform(items, part), lambda x: x != ""), "\n")
        return F.coalesce(F.when(items.isNotNull(), listed).otherwise(part(c)), F.lit(""))

    return let(F.when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")), build)


def tool_calls(msgs: DataFrame) -> DataFrame:
    """One row per tool call; ``k`` is its position in the message."""
    rows = msgs.where(F.col("msg.type") == "gemini").select(
        "session_id", "project_hash", "m", F.col("msg.timestamp").alias("msg_time"), F.posexplode(F.filter("msg.toolCalls", lambda x: F.startswith(x, F.lit("{")))).alias("k", "c")
    )
    j = F.from_json("c", CALL)
    rows = rows.withColumn("j", j)
    return rows.select(
        "session_id", "project_hash", "m", "k", "msg_time", F.coalesce(nz("j.id"), F.concat(F.lit("call-"), F.col("k").cast("string"))).alias("call_id"),
        F.coalesce(nz("j.name"), F.lit("tool")).alias("tool"), F.col("j.args").alias("args"), F.col("j.result").alias("result"),
        F.coalesce(nz("j.status"), F.lit("success")).alias("status"), iso_ms("j.timestamp").alias("call_ms"), nz("j.resultDisplay").alias("shown"),
    )


def events(raw: DataFrame, max_text: int | None = None, max_result: int | None = None) -> DataFrame:
    """Neutral events in document order (``ord`` is the message, ``pos`` the place inside it)."""
    msgs = messages(latest_documents(raw)).where(F.col("msg").isNotNull())
    msg = F.col("msg")
    base = F.concat(F.lit("m"), F.col("m").cast("string"))
    text = content_text(msg["content"])
    t = msg["type"]
    plain = msgs.select("session_id", F.col("m").alias("ord"), msg["timestamp"].alias("timestamp"), t.alias("t"), base.alias("event_id"), text.alias("body"))
    plain = plain.where((F.col("t") != "gemini") | (F.trim("body") != ""))
    kind = F.when(F.col("t") == "user", "user").when(F.col("t") == "gemini", "assistant").otherwise("notification")
    spoken = plain.select(
        "session_id", "ord", F.lit(100_000).alias("pos"), "event_id", "timestamp", kind.alias("kind"), safe_text("body", max_text).alias("text"), (F.col("t") == "error").alias("is_error")
    )
    thought = msgs.where(t == "gemini").select("session_id", F.col("m").alias("ord"), msg["timestamp"].alias("timestamp"), base.alias("b"), F.posexplode("msg.thoughts").alias("i", "th"))
    said = F.concat_ws(": ", nz(F.get_json_object("th", "$.subject")), nz(F.get_json_object("th", "$.description")))
    thinking = thought.withColumn("said", said).where(F.col("said") != "").select(
        "session_id", "ord", F.col("i").alias("pos"), F.concat("b", F.lit("t"), F.col("i").cast("string")).alias("event_id"), "timestamp",
        F.lit("thinking").alias("kind"), safe_text("said", max_text).alias("text"), F.lit(False).alias("is_error"),
    )
    calls = tool_calls(msgs)
    calls = calls.withColumn("call", document_call(F.col("tool"), F.col("args")))
    b = F.concat(F.lit("m"), F.col("m").cast("string"))
    stamp = F.when(F.col("call_ms").isNotNull(), iso_text(F.col("call_ms"))).otherwise(F.col("msg_time"))
    uses = calls.select(
        "session_id", F.col("m").alias("ord"), (F.col("k") * 2 + 200_000).alias("pos"), F.concat(b, F.lit("c"), F.col("k").cast("string")).alias("event_id"), stamp.alias("timestamp"),
        F.lit("tool_use").alias("kind"), F.coalesce(nz("call.summary"), F.col("call.target")).alias("text"), F.lit(False).alias("is_error"), "tool",
        F.col("call.kind").alias("action"), F.col("call_id").alias("tool_use_id"), F.col("call.target").alias("target"), F.col("call.dir").alias("dir"), F.col("call.detail").alias("detail"),
    )
    body = F.coalesce("shown", nz(content_text(F.col("result"))), F.when(F.col("status") == "cancelled", F.lit("Cancelled")), F.lit(""))
    results = calls.where(~F.col("status").isin(*PENDING)).select(
        "session_id", F.col("m").alias("ord"), (F.col("k") * 2 + 200_001).alias("pos"), F.concat(b, F.lit("r"), F.col("k").cast("string")).alias("event_id"), F.col("msg_time").alias("timestamp"),
        F.lit("tool_result").alias("kind"), safe_text(body, max_result).alias("text"), F.col("status").isin("error", "cancelled").alias("is_error"), F.col("call_id").alias("tool_use_id"),
    )
    out = spoken.unionByName(thinking, allowMissingColumns=True).unionByName(uses, allowMissingColumns=True).unionByName(results, allowMissingColumns=True)
    return out.withColumns({"agent_key": F.lit("main"), "ts_ms": iso_ms("timestamp"), "layout": F.lit(LAYOUT)})


def usage(raw: DataFrame, tz: str = "UTC") -> DataFrame:
    """Usage rows of the model's messages; a missing model is the latest earlier one of the session."""
    msgs = messages(latest_documents(raw))
    g = msgs.where(F.col("msg.type") == "gemini").select("session_id", F.col("m").cast("bigint").alias("ord"), nz("msg.model").alias("model"), "msg.tokens", "msg.timestamp")
    filled = with_carried_model(g, partition=["session_id"]).where(F.col("tokens").isNotNull())
    day = local_day(F.coalesce(iso_ms("timestamp"), F.lit(0)), tz)
    rows = filled.select("session_id", F.lit("main").alias("agent_key"), "model", day.alias("day"), normalise_usage("thoughts", F.col("tokens")).alias("n"))
    return rows.select("session_id", "agent_key", "model", "day", "n.*").withColumn("layout", F.lit(LAYOUT))


def nodes(raw: DataFrame, now: int, prices: DataFrame | None = None) -> DataFrame:
    """One node per session, with state, counts and the project folder proved by its hash."""
    docs = latest_documents(raw)
    msgs = messages(docs)
    calls = tool_calls(msgs)
    ts = iso_ms("msg.timestamp")
    prompt = F.when((F.col("msg.type") == "user"), nz(F.trim(content_text(F.col("msg.content")))))
    m = msgs.withColumns({"ts": ts, "prompt": prompt})
    facts = m.groupBy("session_id").agg(
        F.max("mtime").alias("mtime"), F.min("ts").alias("first_ts"), F.max("ts").alias("__last"), F.max_by("msg.type", "m").alias("last_type"),
        F.max(F.when(F.col("msg.type") == "gemini", F.col("m"))).alias("__model_at"), F.count(F.lit(1)).alias("messages"),
        F.max_by("msg.model", F.when(nz("msg.model").isNotNull(), F.col("m"))).alias("model"),
        F.min_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("m"))).alias("name"), F.max_by("prompt", F.when(F.col("prompt").isNotNull(), F.col("m"))).alias("last_prompt"),
    )
    at = F.coalesce("call_ms", iso_ms("msg_time"))
    waiting = F.when(F.col("status").isin(*PENDING), F.struct("m", "k"))
    tools = calls.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("tool_calls"), F.max(at).alias("__last_call"), F.max_by(F.struct("m", "tool", "args"), waiting).alias("__pending")
    )
    f = facts.join(tools, "session_id", "left")
    pending = F.col("__pending.m") == F.col("__model_at")
    call = document_call(F.col("__pending.tool"), F.col("__pending.args"))
    paths = calls.select("session_id", "project_hash", "m", "k", F.explode(F.array(*[F.get_json_object("args", f"$.{k}") for k in PATH_KEYS])).alias("path"))
    cwd = S.resolve_project_dir(paths.where(F.col("path").isNotNull()), ["session_id"], order=["m", "k"])
    f = f.join(cwd.withColumnRenamed("project_dir", "cwd"), "session_id", "left")
    f = f.withColumns(
        {
            "layout": F.lit(LAYOUT), "agent_key": F.lit("main"), "is_main": F.lit(True), "pending_call": F.coalesce(pending, F.lit(False)),
            "last_ts": F.greatest("__last", "__last_call"), "started_at": F.col("first_ts"), "tool_calls": F.coalesce("tool_calls", F.lit(0)),
        }
    )
    f = f.withColumn("last_activity_at", F.greatest(F.col("mtime"), F.coalesce("last_ts", F.lit(0))))
    f = infer_state(f, LAYOUT, now).withColumns(end_columns(now, ("running", "idle")))
    f = f.withColumns(
        {
            "last_action": F.when((F.col("state") == "running") & F.col("pending_call"), call),
            "label": mask_secrets(F.coalesce(nz(clip_line("name")), F.concat(F.lit("session "), F.substring("session_id", 1, 8)))),
            "last_prompt": clip_line("last_prompt"),
        }
    )
    ticks = calls.select("session_id", at.alias("ts_ms")).join(f.select("session_id", "started_at"), "session_id")
    f = f.join(tick_offsets(ticks, ["session_id"]), "session_id", "left").drop("__last", "__last_call", "__model_at", "__pending")
    if prices is None:
        return f
    return S.node_usage(f, usage(raw), prices)


def sessions(tree: DataFrame, raw: DataFrame, now: int) -> DataFrame:
    msgs = messages(latest_documents(raw))
    stamps = msgs.select("session_id", iso_ms("msg.timestamp").alias("ts_ms"))
    calls = tool_calls(msgs).select("session_id", F.coalesce("call_ms", iso_ms("msg_time")).alias("ts_ms"))
    line = activity_buckets(stamps.unionByName(calls), ["session_id"], "ts_ms", now).select("session_id", F.struct("end", "counts").alias("activity"))
    fields = tree.select("session_id", F.col("label").alias("session_name"), mask_secrets("cwd").alias("cwd"), "last_prompt")
    return S.session_summary(tree, fields.join(line, "session_id", "left"))
