"""The chain store: sessions whose entries are linked from a head through ``previous_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import clip_line, mask_secrets, nz, safe_text
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets, tick_offsets
from tracelake.operators.state import end_columns, infer_state
from tracelake.operators.tree import accept_links, resolve_tree, valid_parents, walk_chain
from tracelake.plans.part_store import iso_text
from tracelake.plans.tool_calls import chain_call
from tracelake.session import cut_lineage

LAYOUT = "chain_store"
# --- fixed values ---------------------------------------------------------------------------------
SIGNIFICANT = ("message", "turnSummary", "error", "interrupted", "elicitationRequest", "elicitationResponse")
# --- end of fixed values --------------------------------------------------------------------------
ENTRY = (
    "id string, type string, createdTimestamp double, hidden boolean, sessionId string, doneTitle string, workingTitle string, errorCode string, "
    "durationMs double, files array<string>, context struct<total:double>, message string"
)
PART = "type string, text string, name string, parameters string, uniqueToolCallId string, result string"
CONFIG = (
    "modelSpecifier struct<model:string>, sessionParams struct<working_directory:string>, inferenceConfig struct<reasoningLevel:string>, "
    "sessionConfig struct<shellMode:string>, contextEstimation struct<total:double>"
)


def session_config(c: Column) -> Column:
    """Model, folder, reasoning level, shell mode and context estimate of a session row."""
    j = F.from_json(c, CONFIG)
    return F.struct(
        nz(j["modelSpecifier"]["model"]).alias("model"), nz(j["sessionParams"]["working_directory"]).alias("cwd"), nz(j["inferenceConfig"]["reasoningLevel"]).alias("reasoning"),
        nz(j["sessionConfig"]["shellMode"]).alias("shell_mode"), j["contextEstimation"]["total"].alias("ctx_total"),
    )


def chains(sessions: DataFrame, entries: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Parsed entries of every session, oldest first by ``pos``; corrupt entries are skipped after the walk."""
    heads = sessions.where(nz("committed_head_entry_id").isNotNull()).select("project_id", "session_id", F.col("committed_head_entry_id").alias("head"))
    walked = walk_chain(entries, heads, "id", "previous_id", "head", ["project_id"], max_hops)
    length = walked.groupBy("project_id", "head").agg(F.max("hops").alias("__len"))
    placed = walked.join(length, ["project_id", "head"]).withColumn("pos", F.col("__len") - F.col("hops"))
    rows = placed.join(heads, ["project_id", "head"]).join(entries.select("project_id", "id", "entry_json"), ["project_id", "id"])
    ok = rows.where(J.is_object_text("entry_json"))
    parts = F.filter(F.from_json(F.get_json_object("entry_json", "$.message.parts"), "array<string>"), lambda p: F.startswith(p, F.lit("{")))
    return ok.select(
        F.lower("session_id").alias("session_id"), "pos", F.from_json("entry_json", ENTRY).alias("e"), nz(F.get_json_object("entry_json", "$.message.role")).alias("role"),
        F.transform(parts, lambda p: F.from_json(p, PART)).alias("parts"),
    )


def analysis(chain: DataFrame) -> DataFrame:
    """Per session: counts, times, prompts, last call, open turn and how it ended."""
    e, t = F.col("e"), F.col("e.type")
    msg = t == "message"
    order = lambda cond: F.when(cond, F.col("pos"))
    requests = F.filter("parts", lambda p: p["type"] == "toolCallRequest")
    spoken = F.filter("parts", lambda p: p["type"].isin("text", "reasoning") & nz(p["text"]).isNotNull())
    user_text = F.when(msg & (F.col("role") == "user") & ~F.coalesce(e["hidden"], F.lit(False)), nz(F.array_join(F.transform(spoken, lambda p: p["text"]), "\n")))
    rows = chain.withColumns({"asked": user_text, "calls": F.when(msg, F.size(requests)).otherwise(0), "last_call": F.when(msg, F.try_element_at(requests, F.lit(-1)))})
    out = rows.groupBy("session_id").agg(
        F.count_if(msg & F.col("role").isin("user", "assistant")).alias("messages"),
        F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint").alias("tool_calls"),
        F.count_if(t == "turnSummary").alias("turns"),
        F.count_if((t == "subSessionReference") & nz(e["sessionId"]).isNotNull()).alias("sub_refs"),
        F.min(F.when(msg, e["createdTimestamp"])).cast("bigint").alias("first_ts"),
        F.max(F.when(msg, e["createdTimestamp"])).cast("bigint").alias("last_ts"),
        F.min_by("asked", order(F.col("asked").isNotNull())).alias("first_user"),
        F.max_by("asked", order(F.col("asked").isNotNull())).alias("last_prompt"),
        F.max_by(e["context"]["total"], order(msg & e["context"]["total"].isNotNull())).alias("ctx_total"),
        F.max_by("last_call", order(F.col("last_call").isNotNull())).alias("last_call"),
        F.max_by(F.struct(t.alias("type"), F.col("role"), (F.size(requests) > 0).alias("asks"), e["errorCode"].alias("error_code")), order(t.isin(*SIGNIFICANT))).alias("sig"),
    )
    s = F.col("sig")
    open_turn = F.when(s["type"] == "message", s["role"].isin("user", "tool") | ((s["role"] == "assistant") & s["asks"])).otherwise(s["type"] == "elicitationResponse")
    answers = chain.where(msg).select("session_id", F.explode("parts").alias("p")).where(F.col("p.type") == "toolCallResult")
    answered = answers.select("session_id", F.col("p.uniqueToolCallId").alias("__call")).where(nz("__call").isNotNull()).distinct().withColumn("__done", F.lit(True))
    out = out.withColumn("__call", nz("last_call.uniqueToolCallId")).join(answered, ["session_id", "__call"], "left")
    return out.withColumns(
        {
            "open_turn": F.coalesce(open_turn, F.lit(False)),
            "terminal": F.when(s["type"].isin("error", "interrupted"), s["type"]),
            "error_code": F.when(s["type"] == "error", nz(s["error_code"])),
            "last_call_pending": F.col("__call").isNotNull() & F.col("__done").isNull(),
        }
    ).drop("sig", "__call", "__done")


def sub_references(chain: DataFrame) -> DataFrame:
    rows = chain.where((F.col("e.type") == "subSessionReference") & nz("e.sessionId").isNotNull())
    title = F.coalesce(nz("e.doneTitle"), nz("e.workingTitle"))
    return rows.select("session_id", "pos", F.lower("e.sessionId").alias("child_id"), title.alias("title"))


def result_text(c: Column) -> Column:
    items = F.filter(F.from_json(c, "array<string>"), lambda x: F.startswith(x, F.lit("{")))
    kind = lambda x: F.concat(F.lit("["), F.coalesce(nz(F.get_json_object(x, "$.type")), F.lit("?")), F.lit("]"))
    listed = F.array_join(F.transform(items, lambda x: F.coalesce(nz(F.get_json_object(x, "$.text")), kind(x))), "\n")
    return F.coalesce(F.when(F.startswith(c, F.lit("[")), listed).when(~F.startswith(c, F.lit("{")), c), F.lit(""))


def _seconds(ms: Column) -> Column:
    s = F.floor(ms / 1000 + 0.5).cast("bigint")
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit(" min "), (s % 60).cast("string"), F.lit(" s"))).otherwise(F.concat(s.cast("string"), F.lit(" s")))


def events(raw: tuple[DataFrame, DataFrame], max_hops: int | None = None) -> DataFrame:
    """Neutral events of (sessions, entries); parts get a ``:<i>`` suffix to the entry id."""
    return chain_events(chains(*raw, max_hops))


def chain_events(chain: DataFrame, max_text: int | None = None, max_result: int | None = None) -> DataFrame:
    e, t = F.col("e"), F.col("e.type")
    eid = F.coalesce(nz(e["id"]), F.lit("?"))
    msg = chain.where((t == "message") & ~((F.col("role") == "user") & F.coalesce(e["hidden"], F.lit(False))))
    b = msg.select("session_id", "pos", eid.alias("eid"), e["createdTimestamp"].cast("bigint").alias("ts_ms"), "role", F.posexplode("parts").alias("i", "p"))
    pt = F.col("p.type")
    kind = (
        F.when((pt == "text") & nz("p.text").isNotNull() & F.col("role").isin("user", "assistant"), F.col("role"))
        .when((pt == "reasoning") & nz("p.text").isNotNull(), "thinking").when(pt == "image", "user").when(pt == "toolCallRequest", "tool_use").when(pt == "toolCallResult", "tool_result")
    )
    b = b.withColumn("kind", kind).where(F.col("kind").isNotNull())
    b = b.withColumn("call", F.when(F.col("kind") == "tool_use", chain_call(F.col("p.name"), F.col("p.parameters"))))
    body = F.when(pt == "image", F.lit("[image]")).when(F.col("kind") == "tool_result", result_text(F.col("p.result"))).otherwise(F.col("p.text"))
    masked = F.when(F.col("kind") == "tool_result", safe_text(body, max_result)).otherwise(safe_text(body, max_text)) if max_result or max_text else safe_text(body)
    parts = b.select(
        "session_id", F.col("pos").alias("ord"), F.col("i").alias("pos"), F.concat("eid", F.lit(":"), F.col("i").cast("string")).alias("event_id"), "ts_ms", "kind",
        F.when(F.col("kind") == "tool_use", F.coalesce(nz("call.summary"), F.col("call.target"))).otherwise(masked).alias("text"),
        F.lit(False).alias("is_error"), F.col("call.tool").alias("tool"), F.col("call.kind").alias("action"),
        F.when(F.col("kind").isin("tool_use", "tool_result"), nz("p.uniqueToolCallId")).alias("tool_use_id"),
        F.col("call.target").alias("target"), F.col("call.dir").alias("dir"), F.col("call.detail").alias("detail"),
    )
    tail = lambda sep, c: F.coalesce(F.concat(F.lit(sep), c), F.lit(""))
    files = F.when(F.size(e["files"]) > 0, F.concat(F.size(e["files"]).cast("string"), F.lit(" files")))
    note = (
        F.when(t == "turnSummary", F.concat(F.lit("Turn completed"), tail(" · ", _seconds(e["durationMs"])), tail(" · ", files)))
        .when(t == "subSessionReference", F.concat(F.lit("Sub-session"), tail(": ", clip_line(F.coalesce(nz(e["doneTitle"]), nz(e["workingTitle"]))))))
        .when(t == "error", F.concat(F.lit("Error"), tail(": ", clip_line(F.when(~F.startswith(e["message"], F.lit("{")), nz(e["message"]))))))
        .when(t == "interrupted", F.lit("Turn interrupted"))
        .when(t == "elicitationRequest", F.lit("Waiting for the user's approval or answer"))
    )
    notes = chain.withColumn("note", note).where(F.col("note").isNotNull()).select(
        "session_id", F.col("pos").alias("ord"), F.lit(0).alias("pos"), F.concat(eid, F.lit(":0")).alias("event_id"), e["createdTimestamp"].cast("bigint").alias("ts_ms"),
        F.lit("notification").alias("kind"), F.col("note").alias("text"), (t == "error").alias("is_error"),
    )
    out = parts.unionByName(notes, allowMissingColumns=True)
    return out.withColumns({"timestamp": iso_text(F.col("ts_ms")), "agent_key": F.lit("main"), "layout": F.lit(LAYOUT)})


def nodes(sessions: DataFrame, entries: DataFrame, now: int, recent_ms: int = 86_400_000, projects: DataFrame | None = None) -> DataFrame:
    """Sessions as agent trees.  Entries are walked only for sessions of trees updated inside the window."""
    low = lambda c: F.lower(nz(c))
    s = sessions.select(
        low("session_id").alias("native_id"), low("parent_session_id").alias("parent"), "project_id", nz("session_name").alias("session_name"),
        nz("suggested_session_name").alias("suggested"), nz("committed_head_entry_id").alias("head"), "updated_timestamp", F.coalesce("is_transient", F.lit(False)).alias("transient"),
        F.coalesce("is_temporary", F.lit(False)).alias("temporary"), nz("companion_session_as").alias("companion"), session_config(F.col("session_json")).alias("cfg"),
    )
    s = valid_parents(s, "native_id", "parent", ["project_id"])
    first = resolve_tree(s, "native_id", "parent", ["project_id"])
    newest = first.groupBy("project_id", "root").agg(F.max("updated_timestamp").alias("__newest"))
    scoped = first.join(newest, ["project_id", "root"]).withColumn(
        "in_scope", F.col("head").isNotNull() & ~F.col("temporary") & (F.col("__newest") >= now - recent_ms)
    )
    live = scoped.where("in_scope").select("project_id", F.col("native_id").alias("session_id"), F.col("head").alias("committed_head_entry_id"))
    chain = cut_lineage(chains(live, entries))
    an = analysis(chain).withColumnRenamed("session_id", "native_id")
    refs = sub_references(chain)
    owner = scoped.select(F.col("native_id").alias("session_id"), F.col("root").alias("__owner_root"), F.col("project_id").alias("__project"))
    named = refs.join(owner, "session_id").where(F.col("session_id") != F.col("child_id"))
    title = named.groupBy(F.col("child_id").alias("native_id")).agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.struct("session_id", "pos"))).alias("ref_title"))
    # references are taken in the order of (session, position); one sets the parent of a root, unless the owner hangs under
    # that root already, also by a reference taken before
    roots = scoped.where(F.col("native_id") == F.col("root")).select(F.col("native_id").alias("child_id"), F.col("project_id").alias("__project"))
    loose = named.where(F.col("__owner_root") != F.col("child_id")).join(roots, ["child_id", "__project"], "left_semi")
    loose = loose.select("child_id", F.col("__owner_root").alias("target"), F.struct("session_id", "pos", "__project").alias("order"))
    taken = accept_links(loose, "child_id")
    adopt = taken.select(F.col("child_id").alias("native_id"), F.col("order.__project").alias("project_id"), F.col("order.session_id").alias("__adopter"))
    linked = scoped.drop("root", "depth", "path").join(title, "native_id", "left").join(adopt, ["native_id", "project_id"], "left")
    linked = linked.withColumn("parent", F.coalesce("parent", "__adopter")).drop("__adopter", "__newest").join(an, "native_id", "left")
    linked = linked.withColumns(
        {
            "layout": F.lit(LAYOUT), "last_activity": F.greatest("updated_timestamp", F.coalesce("last_ts", F.lit(0))), "started_at": F.col("first_ts"),
        }
    )
    linked = infer_state(linked, LAYOUT, now).withColumn("last_activity_at", F.col("last_activity")).withColumns(end_columns(now, ("running", "idle")))
    tree = resolve_tree(linked, "native_id", "parent", ["project_id"], order=[F.col("started_at").isNull(), F.col("started_at")])
    main = F.col("parent").isNull()
    clip = lambda c: nz(clip_line(c))
    call = chain_call(F.col("last_call.name"), F.col("last_call.parameters"))
    out = tree.withColumns(
        {
            "session_id": F.col("root"), "is_main": main, "agent_key": F.when(main, F.lit("main")).otherwise(F.col("native_id")),
            "parent_key": F.when(F.col("parent") == F.col("root"), F.lit("main")).otherwise(F.col("parent")),
            "label": mask_secrets(F.coalesce(clip("session_name"), clip("suggested"), clip("ref_title"), clip("first_user"), F.substring("native_id", 1, 8))),
            "agent_type": F.when(main, F.lit("main")).when(F.endswith(F.col("companion"), F.lit("approvalReviewer")), F.lit("approval reviewer")).otherwise(F.lit("sub-session")),
            "model": mask_secrets("cfg.model"), "cwd": mask_secrets("cfg.cwd"),
            "end_reason": F.when(F.col("state") == "failed", F.concat(F.lit("Error"), F.coalesce(F.concat(F.lit(": "), "error_code"), F.lit("")))).when(F.col("state") == "stopped", F.lit("Turn interrupted")),
            "last_action": F.when((F.col("state") == "running") & F.col("last_call_pending"), call),
            "input": F.lit(0).cast("bigint"), "total_tokens": F.lit(0).cast("bigint"), "cost_usd": F.lit(0.0), "cost_partial": F.lit(False),
        }
    )
    if projects is not None:
        out = out.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id", "left")
    ticks = chain.where(F.col("e.type") == "message").select(F.col("session_id").alias("native_id"), F.col("e.createdTimestamp").cast("bigint").alias("ts_ms"), F.explode("parts").alias("p"))
    ticks = ticks.where(F.col("p.type") == "toolCallRequest").join(out.select("native_id", "started_at"), "native_id")
    return out.join(tick_offsets(ticks, ["native_id"]), "native_id", "left").drop("last_call", "session_json")


def sessions(tree: DataFrame, chain: DataFrame | None, now: int) -> DataFrame:
    """Listed sessions: roots in scope; a transient root only while live."""
    main = tree.where("is_main").select(
        "session_id", F.col("label").alias("session_name"), "cwd", clip_line("last_prompt").alias("last_prompt"), "in_scope", "transient"
    )
    if chain is not None:
        said = chain.where((F.col("e.type") == "message") & (F.coalesce("role", F.lit("")) != "tool")).select(F.col("session_id").alias("native_id"), F.col("e.createdTimestamp").cast("bigint").alias("ts_ms"))
        line = activity_buckets(said.join(tree.select("native_id", "session_id"), "native_id"), ["session_id"], "ts_ms", now)
        main = main.join(line.select("session_id", F.struct("end", "counts").alias("activity")), "session_id", "left")
    out = S.session_summary(tree, main)
    return out.where(F.col("in_scope") & (~F.col("transient") | F.col("live")))
