"""Rollouts, part store, documents, chain store and summary table on small synthetic inputs."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.fixtures import iso
from tracelake.operators import sessions as S
from tracelake.operators.pricing import price_table
from tracelake.plans import chain_store, document, part_store, rollout, summary_table
from tracelake.sources import tables

NOW = 1_767_270_000_000
R, C, G, T = (f"0000000{i}-0000-4000-8000-000000000000" for i in range(1, 5))


def line(sec, type_, ordinal=None, **payload):
    return json.dumps({"timestamp": iso(NOW - sec * 1000), "ordinal": ordinal, "type": type_, "payload": payload}, separators=(",", ":"))


def usage(inp, out, cached=0, cw=0):
    return {"input_tokens": inp, "cached_input_tokens": cached, "cache_write_input_tokens": cw, "output_tokens": out}


@pytest.fixture(scope="module")
def rollouts(spark):
    call = dict(type="function_call", name="exec_command", call_id="c1", arguments=json.dumps({"cmd": ["bash", "-lc", "cd /w && make"], "workdir": "/x"}))
    logs = {
        R: [
            line(90, "session_meta", id=R, cwd="/meta", source="cli", originator="o"),
            line(89, "turn_context", model="gpt-5.5", cwd="/turn"),
            line(88, "event_msg", type="task_started", turn_id="t1"),
            line(87, "response_item", type="message", role="user", content=[{"type": "input_text", "text": "<environment_context>x"}, {"type": "input_text", "text": "Do it"}]),
            line(86, "response_item", type="function_call", name="spawn_agent", call_id="s1", arguments='{"task_name":"probe"}'),
            line(85, "token_usage_record", response_id="r1", usage=usage(100, 10, 40, 10)),
            line(84, "token_usage_record", response_id="r1", usage=usage(900, 90)),
            line(83, "world_state", big="x" * 300_000),
            line(30, "response_item", **call),
        ],
        C: [
            line(80, "session_meta", id=C, source={"subagent": {"thread_spawn": {"parent_thread_id": R, "depth": 1, "agent_path": "/root/probe", "agent_role": "worker"}}}),
            line(79, "event_msg", type="task_started", turn_id="u"),
            line(78, "event_msg", type="turn_aborted", turn_id="other", reason="user"),
            line(77, "turn_context", model="mystery"),
            line(76, "token_usage_record", turn_id="u", usage=usage(5, 5)),
        ],
        G: [line(70, "session_meta", id=G, parent_thread_id=C, source="exec"), line(69, "response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "hi"}])],
        T: [
            line(60, "turn_context", model="openai/gpt-5"),
            *[line(59 - i, "event_msg", type="token_count", info={"total_token_usage": usage(n, n // 10)}) for i, n in enumerate((100, 100, 250, 40))],
        ],
    }
    rows = [(k, k, i, v, NOW - (30_000 if k == R else 700_000), False) for k, ls in logs.items() for i, v in enumerate(ls)]
    return spark.createDataFrame(rows, "file string, thread_id string, ord bigint, value string, mtime bigint, archived boolean")


def test_rollout_usage(rollouts):
    u = rollout.usage(rollout.parse_lines(rollouts), None, NOW)
    got = {r.thread_id: (r.model, r.input, r.output, r.cache_read, r.cache_create) for r in S.usage_totals(u, ["thread_id", "model"]).collect()}
    assert got[R] == ("gpt-5.5", 50, 10, 40, 10)
    assert got[C] == ("mystery", 5, 5, 0, 0)
    assert got[T] == ("openai/gpt-5", 290, 29, 0, 0)  # 100 + 0 + 150, restart 40


def test_rollout_tree(spark, rollouts):
    lines = rollout.parse_lines(rollouts).cache()
    tree = rollout.nodes(lines, NOW, prices=price_table(spark)).cache()
    n = {r.thread_id: r for r in tree.collect()}
    assert {k: n[k].state for k in n} == {R: "running", C: "stopped", G: "done", T: "done"}
    assert n[C].parent_key == "main" and n[G].path == [R, C, G] and n[G].parent_key == C
    assert (n[C].label, n[C].agent_type, n[C].tool_use_id) == ("probe", "sub-agent", "s1")
    assert n[C].cost_partial and not n[R].cost_partial and n[R].cwd == "/turn" and n[R].label == "Do it"
    assert (n[R].last_action.kind, n[R].last_action.target, n[R].last_action.dir) == ("bash", "make", "/w")
    s = {r.session_id: r for r in rollout.sessions(tree, rollouts, NOW).collect()}
    assert (s[R].agent_count, s[R].total_tokens, s[R].status, s[R].live) == (2, 120, "busy", True)


def test_rollout_events(rollouts):
    ev = {(e.session_id, e.ord): e for e in rollout.events(rollouts).collect()}
    assert ev[(R, 3)].text == "Do it" and ev[(R, 3)].event_id == "b3:0"
    assert ev[(R, 8)].action == "bash" and ev[(R, 8)].detail["workdir"] == "/x"
    assert ev[(C, 2)].text == "Turn aborted · user" and ev[(G, 1)].kind == "assistant"


def test_rollout_calls(spark):
    patch = "*** Begin Patch\n*** Update File: /a/b/c/d.py\n@@\n-x\n+y\n*** Add File: e.md\n+z\n*** End Patch"
    rows = [
        ("custom_tool_call", "apply_patch", None, None, patch),
        ("custom_tool_call", "exec", None, None, "await tools.apply_patch(" + json.dumps(patch) + ")"),
        ("custom_tool_call", "exec", None, None, 'tools.exec_command({cmd: "cd /q && ls\\n", workdir: "/w"}); tools.exec_command({cmd: \'pwd\'})'),
        ("custom_tool_call", "exec", None, None, "tools.web__run({})"),
        ("function_call", "query", "mcp__db", '{"query":"select 1"}', None),
        ("function_call", "send_message", None, '{"target":"bob","message":"gAAAA"}', None),
        ("function_call", "sleep", None, '{"duration_ms": 4000}', None),
    ]
    df = spark.createDataFrame(rows, "t string, n string, ns string, a string, i string")
    got = [r[0] for r in df.select(rollout.rollout_call(F.col("t"), F.col("n"), F.col("ns"), F.col("a"), F.col("i"))).collect()]
    assert [(g.tool, g.kind, g.target) for g in got] == [
        ("apply_patch", "edit", "d.py, e.md"), ("apply_patch", "edit", "d.py, e.md"), ("exec_command", "bash", "ls (+1 commands)"),
        ("web__run", "web", "web__run"), ("mcp__db__query", "mcp", "db · query: select 1"), ("send_message", "message", "→ bob"), ("sleep", "other", "waiting 4 s"),
    ]
    assert got[1].detail["file_path"] == "/a/b/c/d.py" and got[2].dir == "/q"


def test_rollout_index(spark):
    cols = "id string, rollout_path string, updated_at bigint, source string"
    rows = [(R, "/r", 1, "cli"), (C, "/c", 50, json.dumps({"subagent": {"parent_thread_id": R}})), (G, "/g", 60, None), ("bad", "/b", 99, None), (T, None, 99, None)]
    edges = spark.createDataFrame([(C, G)], "parent_thread_id string, child_thread_id string")
    got = rollout.read_threads(spark.createDataFrame(rows, cols), 60_000, edges)
    assert {r.id for r in got.collect()} == {R, C, G}
    with pytest.raises(ValueError):
        rollout.read_threads(spark.createDataFrame([(1,)], "x int"), 0)


# ------------------------------------------------------------------------------------------------ part store
def test_part_store(spark):
    cols = "id string, parent_id string, title string, directory string, agent string, model string, time_created bigint, time_updated bigint, cost double, tokens_input bigint, tokens_output bigint, tokens_reasoning bigint"
    ses = [
        ("ses_aaaaaa", None, " Top ", "/d", "build", None, NOW - 90_000, NOW - 5_000, 0.5, 10, 5, 2),
        ("ses_bbbbbb", "ses_aaaaaa", "", "/d", "explore", '{"id":"m-x"}', NOW - 80_000, NOW - 300_000, 0.25, 1, 1, 0),
        ("nope", None, "x", "/d", "build", None, NOW, NOW, 0.0, 0, 0, 0),
    ]
    msg = lambda i, s, c, **d: (i, s, NOW - c * 1000, NOW - c * 1000, json.dumps(d))
    messages = [
        msg("m1", "ses_aaaaaa", 88, role="user"),
        msg("m2", "ses_aaaaaa", 80, role="assistant", modelID="big", time={"created": 1}),
        msg("m3", "ses_bbbbbb", 70, role="assistant", modelID="small", error={"name": "MessageAbortedError"}),
    ]
    part = lambda i, m, s, c, d: (i, m, s, NOW - c * 1000, NOW - c * 1000, json.dumps(d))
    done = {"status": "completed", "input": {"command": "cd /z && ls"}, "output": "ok", "metadata": {}}
    spawn = {"status": "completed", "input": {"description": "look"}, "output": "fine", "metadata": {"sessionId": "ses_bbbbbb"}}
    parts = [
        part("p1", "m1", "ses_aaaaaa", 87, {"type": "text", "text": "Please TOKEN=abc", "time": {"end": 1}}),
        part("p2", "m2", "ses_aaaaaa", 79, {"type": "tool", "tool": "bash", "callID": "c1", "state": done}),
        part("p3", "m2", "ses_aaaaaa", 78, {"type": "tool", "tool": "task", "callID": "c2", "state": spawn}),
        part("p4", "m2", "ses_aaaaaa", 6, {"type": "tool", "tool": "read", "callID": "c3", "state": {"status": "running", "input": {"filePath": "/a/b/c/d"}}}),
        part("p5", "m2", "ses_aaaaaa", 5, {"type": "text", "text": "stream"}),
    ]
    pc = "id string, message_id string, session_id string, time_created bigint, time_updated bigint, data string"
    s, m, p = tables.read_part_store(
        spark.createDataFrame(ses, cols),
        spark.createDataFrame(messages, "id string, session_id string, time_created bigint, time_updated bigint, data string"),
        spark.createDataFrame(parts, pc),
    )
    tree = part_store.nodes(s, m, p, NOW).cache()
    n = {r.native_id: r for r in tree.collect()}
    assert set(n) == {"ses_aaaaaa", "ses_bbbbbb"}
    a, b = n["ses_aaaaaa"], n["ses_bbbbbb"]
    assert (a.state, a.label, a.output, a.model, a.last_action.target) == ("running", "Top", 7, "big", "…/b/c/d")
    assert (b.state, b.end_reason, b.tool_use_id, b.agent_type) == ("stopped", "Cancelled", "c2", "explore")
    out = part_store.sessions(tree, p, NOW).first()
    assert (out.cost_usd, out.total_tokens, out.agent_count, out.last_prompt) == (0.75, 19, 1, "Please TOKEN=[REDACTED]")
    ev = [(e.event_id, e.kind, e.text) for e in part_store.events((m, p), NOW).orderBy("created_ms", "pos").collect()]
    assert ev == [
        ("p:p1", "user", "Please TOKEN=[REDACTED]"), ("p:p2", "tool_use", "cd /z && ls"), ("r:p2", "tool_result", "ok"),
        ("p:p3", "tool_use", "look"), ("r:p3", "tool_result", "fine"),
    ]


# ------------------------------------------------------------------------------------------------ documents
def test_documents(spark):
    root = "/home/me/proj"
    h = hashlib.sha256(root.encode()).hexdigest()
    call = {"id": "c1", "name": "read_file", "args": {"file_path": root + "/src/a.py"}, "status": "success", "resultDisplay": "shown"}
    wait = {"id": "c2", "name": "run_shell_command", "args": {"command": "cd /w && make"}, "status": "executing"}
    msgs = [
        {"type": "user", "timestamp": iso(NOW - 50_000), "content": [{"text": "Hello"}, {"inlineData": {}}]},
        {"type": "junk"},
        {"type": "gemini", "timestamp": iso(NOW - 40_000), "content": "Sure", "model": "g-1", "thoughts": [{"subject": "S", "description": "D"}], "toolCalls": [call], "tokens": {"input": 100, "cached": 30, "output": 5, "thoughts": 2, "tool": 1, "total": 0}},
        {"type": "gemini", "timestamp": iso(NOW - 20_000), "content": "", "toolCalls": [wait], "tokens": {"input": 1, "output": 1, "cached": 5, "thoughts": 0, "tool": 0, "total": 0}},
    ]
    doc = json.dumps({"sessionId": "s1", "projectHash": h, "messages": msgs})
    rows = [("f1", NOW - 30_000, doc), ("f1b", NOW - 10_000, doc[:-20]), ("f0", NOW - 90_000, json.dumps({"sessionId": "s1", "messages": []}))]
    raw = spark.createDataFrame(rows, "file string, mtime bigint, value string")
    (n,) = document.nodes(raw, NOW).collect()
    assert (n.state, n.cwd, n.label, n.tool_calls, n.last_action.target, n.last_action.dir) == ("running", root, "Hello [file]", 2, "make", "/w")
    u = S.usage_totals(document.usage(raw), ["model"]).first()
    assert (u.model, u.input, u.output, u.cache_read) == ("g-1", 71, 8, 35)
    ev = [(e.event_id, e.kind, e.text) for e in document.events(raw).orderBy("ord", "pos").collect()]
    assert ev == [
        ("m0", "user", "Hello\n[file]"), ("m1t0", "thinking", "S: D"), ("m1", "assistant", "Sure"), ("m1c0", "tool_use", "…/proj/src/a.py"),
        ("m1r0", "tool_result", "shown"), ("m2c0", "tool_use", "make"),
    ]


# ------------------------------------------------------------------------------------------------ chain store
def test_chain_store(spark):
    a, b, t = (f"0000000{i}-0000-4000-8000-00000000000a" for i in "abf")
    entry = lambda i, prev, **e: (i, prev, json.dumps({"id": i, **e}), "p")
    msg = lambda i, prev, sec, role, *parts: entry(i, prev, type="message", createdTimestamp=NOW - sec * 1000, message={"role": role, "parts": list(parts)})
    txt = lambda s: {"type": "text", "text": s}
    req = {"type": "toolCallRequest", "name": "shell_command", "uniqueToolCallId": "k1", "parameters": {"command": "ls"}}
    entries = [
        msg("1", None, 60, "user", txt("hi there")),
        ("2", "1", "{broken", "p"),
        msg("3", "2", 50, "assistant", txt("ok"), req),
        entry("4", "3", type="subSessionReference", sessionId=b.upper(), workingTitle="Helper"),
        msg("9", None, 3700, "user", txt("sub")),
        entry("10", "9", type="error", message="boom", errorCode="E7"),
    ]
    ses = [
        (a, None, "4", json.dumps({"modelSpecifier": {"model": "m"}, "sessionParams": {"working_directory": "/w"}}), NOW - 1000, False, None, None, "p"),
        (b, None, "10", None, NOW - 3_600_000, False, None, None, "p"),
        (t, None, None, None, NOW, False, None, None, "p"),
    ]
    cols = "session_id string, session_name string, committed_head_entry_id string, session_json string, updated_timestamp bigint, is_transient boolean, suggested_session_name string, parent_session_id string, project_id string"
    s, e = tables.read_chain_store(spark.createDataFrame(ses, cols), spark.createDataFrame(entries, "id string, previous_id string, entry_json string, project_id string"))
    tree = chain_store.nodes(s, e, NOW).cache()
    n = {r.native_id: r for r in tree.collect()}
    assert (n[a].state, n[a].messages, n[a].tool_calls, n[a].last_action.target, n[a].label, n[a].model) == ("running", 2, 1, "ls", "hi there", "m")
    assert (n[b].path, n[b].state, n[b].label, n[b].end_reason, n[b].parent_key) == ([a, b], "failed", "Helper", "Error: E7", "main")
    assert [r.session_id for r in chain_store.sessions(tree, None, NOW).collect()] == [a]
    ev = [(x.event_id, x.kind, x.text) for x in chain_store.events((s, e)).orderBy("session_id", "ord", "pos").collect()]
    assert ev == [
        ("1:0", "user", "hi there"), ("3:0", "assistant", "ok"), ("3:1", "tool_use", "ls"), ("4:0", "notification", "Sub-session: Helper"),
        ("9:0", "user", "sub"), ("10:0", "notification", "Error: boom"),
    ]


# ------------------------------------------------------------------------------------------------ summary table
def test_summary_table(spark):
    cols = "conversation_id string, title string, last_modified_time string, workspace_uris string, status string, killed int, parent_conversation_id string, battle_id string, winning_conversation_id string, raw_summary binary"
    row = lambda i, sec, status="", killed=0, parent=None, battle=None, win=None, title=None: (i, title, iso(NOW - sec * 1000), '["file:///Users/me/x"]', status, killed, parent, battle, win, b"secret")
    rows = [
        row("root-1", 30, "RUN_RUNNING", title="Fix &amp; go"), row("child-1", 40, "STATUS_IDLE", parent="root-1"), row("grand-1", 5000, parent="child-1", killed=1),
        row("battle-a", 100, battle="b1"), row("battle-b", 200, battle="b1", win="battle-b"), row("old-row", 200_000), row("weird-1", 30, "Paused"), row("x", 1),
    ]
    t = tables.read_summaries([spark.createDataFrame([(1,)], "other int"), spark.createDataFrame(rows, cols)])
    assert "raw_summary" not in t.columns and "preview" not in t.columns
    tree = summary_table.nodes(t, NOW, "/Users/me").cache()
    n = {r.id: r for r in tree.collect()}
    assert {k: n[k].state for k in n} == {"root-1": "running", "child-1": "idle", "grand-1": "stopped", "battle-a": "idle", "battle-b": "done", "weird-1": "idle"}
    assert n["grand-1"].path == ["root-1", "child-1", "grand-1"] and n["battle-a"].parent_key == "main" and n["battle-b"].is_winner
    assert n["root-1"].label == "Fix & go" and n["root-1"].cwd == "~/x"
    s = {r.session_id: r for r in summary_table.sessions(tree, NOW).collect()}
    assert (s["root-1"].status, s["weird-1"].status, s["battle-b"].agent_count) == ("busy", "paused", 1)
