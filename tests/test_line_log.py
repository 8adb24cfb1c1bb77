"""The line log end to end: golden usage, tree, states, events and pages."""

import pytest
from pyspark.sql import functions as F

from tests import fixtures as fx
from tracelake.operators import events as E
from tracelake.operators import sessions as S
from tracelake.operators.pricing import price_table
from tracelake.operators.state import infer_state
from tracelake.plans import line_log as L


@pytest.fixture(scope="module")
def lines(spark):
    return L.parse_lines(spark.createDataFrame(fx.line_log_rows(), fx.LINE_SCHEMA)).cache()


@pytest.fixture(scope="module")
def tree(spark, lines):
    reg = spark.createDataFrame(fx.REGISTRY, fx.REG_SCHEMA)
    meta = spark.createDataFrame(fx.META, fx.META_SCHEMA)
    return L.nodes(lines, fx.NOW, reg, meta, price_table(spark)).cache()


def by_key(df):
    return {r.agent_key: r for r in df.collect()}


def test_lines_skip_broken_rows(lines):
    assert lines.where("agent_key = 'main'").count() == 10


def test_usage_last_line_wins(lines):
    u = L.usage(lines, fx.NOW)
    total = S.usage_totals(u, ["session_id"]).first()
    assert (total.input, total.output, total.cache_read, total.cache_create, total.total_tokens) == (82, 47, 772, 60, 961)
    per = by_key(S.usage_totals(u, ["agent_key"]))
    assert (per["main"].input, per["main"].output, per["main"].cache_read, per["main"].cache_create) == (20, 10, 210, 20)
    assert (per["a2"].input, per["a2"].output, per["a2"].cache_read) == (7, 7, 12)
    assert u.where("agent_key = 'a2'").count() == 1


def test_usage_is_invariant_to_a_duplicated_line(spark):
    rows = fx.line_log_rows()
    twice = rows + [(f, s, a, o + 500, v, m) for f, s, a, o, v, m in rows]
    u = L.usage(L.parse_lines(spark.createDataFrame(twice, fx.LINE_SCHEMA)), fx.NOW)
    assert S.usage_totals(u, ["session_id"]).first().total_tokens == 961


def test_tree_and_states(tree):
    n = by_key(tree)
    assert {k: n[k].state for k in n} == {"main": "running", "a1": "done", "a2": "running", "a3": "done", "w1": "stopped"}
    assert {k: n[k].parent_key for k in n} == {"main": None, "a1": "main", "a2": "a1", "a3": "main", "w1": "main"}
    order = [r.agent_key for r in tree.orderBy("order_path").collect()]
    assert order == ["main", "a3", "a1", "a2", "w1"]
    assert n["a2"].path == ["main", "a1", "a2"] and n["a2"].depth == 2
    assert n["a1"].duration_ms == 60_000 and n["a1"].ticks == [10] and n["a2"].ticks == [5]
    assert (n["a1"].mode, n["a2"].mode, n["a3"].mode, n["w1"].mode) == ("background", "foreground", "foreground", "unknown")
    assert (n["a3"].label, n["a3"].agent_type) == ("Quick check", "Explore")
    assert n["w1"].end_reason == "Workflow agent killed" and n["a1"].end_reason is None
    assert n["a2"].last_action.kind == "bash" and n["a2"].last_action.dir == "/x" and "abcdefghijklmnop" not in n["a2"].last_action.target
    assert n["w1"].workflow == "wf_demo" and n["a2"].messages == 1 and n["a2"].tool_calls == 2


def test_costs(tree):
    n = by_key(tree)
    main = (20 * 4 + 10 * 20 + 20 * 5 + 210 * 0.2) / 1e6
    assert n["main"].cost_usd == pytest.approx(main) and n["main"].cost_partial is False


def test_failed_and_resumed_agents(spark):
    failed = fx.say("user", 190, fx.note("a2", "failed", "API error"), "n1")
    resumed = fx.say("assistant", 230, [fx.use("z", "Bash", command="ls")], "z9", "m99", "claude-haiku-4-5", "tool_use", (1, 1, 0, 0))

    def renamed(rows, sid):
        return [(f"{sid}/{k}", sid, k, o, v, m) for _, _, k, o, v, m in rows]

    rows = (
        renamed(fx.line_log_rows([("main", failed)]), "failed") + renamed(fx.line_log_rows([("main", failed), ("a2", resumed)]), "resumed") + renamed(fx.line_log_rows(), "plain")
    )
    tree = L.nodes(L.parse_lines(spark.createDataFrame(rows, fx.LINE_SCHEMA)), fx.NOW)
    got = {r.session_id: (r.state, r.end_reason) for r in tree.where("agent_key = 'a2'").collect()}
    assert got == {"failed": ("failed", "API error"), "resumed": ("running", None), "plain": ("running", None)}
    facts = tree.where("session_id = 'plain'").select("*", F.lit(False).alias("alive"), *[F.lit(None).cast(t).alias(c) for c, t in (("reg_status", "string"), ("note_status", "string"), ("note_ts", "bigint"))])
    late = infer_state(facts.drop("state"), "line_log", fx.NOW + 3 * 3_600_000)
    assert by_key(late)["a2"].state == "stalled"


def test_parent_cycle_hangs_under_main(spark):
    m = [(fx.S1, "a1", None, None, "tN1", 1, None, None, None, None), (fx.S1, "a2", None, None, "x", 1, None, None, None, None)]
    loop = fx.say("assistant", 200, [fx.use("x", "Agent", description="loop")], "l1", "ml", "claude-haiku-4-5", "end_turn", (1, 1, 0, 0))
    rows = [r for r in fx.line_log_rows([("a1", loop)])]
    # a1 is started by a call of a2, a2 by a call of a1
    nested = fx.say("assistant", 201, [fx.use("tN1", "Agent", description="loop")], "l2", "mk", "claude-haiku-4-5", "end_turn", (1, 1, 0, 0))
    rows.append((f"{fx.S1}/a2", fx.S1, "a2", 2000, nested, fx.T_LAST))
    n = by_key(L.nodes(L.parse_lines(spark.createDataFrame(rows, fx.LINE_SCHEMA)), fx.NOW, meta=spark.createDataFrame(m, fx.META_SCHEMA)))
    assert n["a1"].parent_key == "main" and n["a2"].path == ["main", "a1", "a2"]


def test_sessions(spark, lines, tree):
    reg = spark.createDataFrame(fx.REGISTRY, fx.REG_SCHEMA)
    out = S.order_sessions(L.sessions(lines, tree, fx.NOW, reg)).collect()
    assert [(r.session_id[-1], r.live, r.has_transcript) for r in out] == [("a", True, True), ("b", True, False)]
    s = out[0]
    assert (s.session_name, s.status, s.agent_count, s.running_agents, s.total_tokens, s.cwd) == ("Demo Live", "busy", 4, 1, 961, "/w/demo")
    assert sum(s.activity.counts) == 18 and len(s.activity.counts) == 30 and s.activity.end == fx.NOW // 60000 * 60000
    dead = L.sessions(lines, tree, fx.NOW).first()
    assert dead.session_name == "Demo Session"


def test_machine(spark, lines, tree):
    reg = spark.createDataFrame(fx.REGISTRY, fx.REG_SCHEMA)
    m = S.machine_summary(tree, L.usage(lines, fx.NOW), price_table(spark), fx.NOW, registry=reg)
    total = m.where("layout is null").first()
    assert (total.live_sessions, total.running_agents, total.finished_today, total.output_today) == (2, 2, 3, 47)


def test_events(lines):
    ev = L.events(lines).orderBy("agent_key", "ord", "pos").collect()
    main = [(e.kind, e.text) for e in ev if e.agent_key == "main"]
    assert main[0] == ("user", "Run the build. My TOKEN=[REDACTED] is in env")
    assert ("tool_use", "Build things") in main and ("tool_result", "Found 3 files") in main
    assert ("notification", "task w1 killed - Workflow agent killed") in main
    assert [e.event_id for e in ev if e.agent_key == "a3"] == ["v1:0", "v2:0"]
    bash = [e for e in ev if e.tool == "Bash"]
    assert bash[0].detail == {"command": "ls -la /tmp"} and bash[0].action == "bash"


def test_event_blocks(spark):
    content = [
        {"type": "thinking", "thinking": " hm "},
        "stray",
        {"type": "tool_use", "id": "t", "name": "MultiEdit", "input": {"file_path": "/a/b/c/d/e.ts", "edits": [{"old_string": "x", "new_string": "y"}, {"old_string": "q"}]}},
        {"type": "tool_use", "id": "u", "name": "mcp__srv__do", "input": {"n": 1, "q": "find me"}},
        {"type": "tool_use", "id": "v", "name": "Custom", "input": {"n": 1, "list": [1]}},
        {"type": "tool_use", "id": "w", "name": "Grep", "input": {"pattern": "foo", "path": "/a/b/c"}},
    ]
    user = [
        {"type": "text", "text": "<system-reminder>no</system-reminder>"},
        {"type": "image"},
        {"type": "tool_result", "tool_use_id": "t", "is_error": True, "content": [{"type": "text", "text": "bad"}, {"type": "image"}, {"type": "doc"}]},
    ]
    rows = [
        ("f", "s", "main", 0, fx.say("assistant", 0, content, "x"), 0),
        ("f", "s", "main", 1, fx.say("user", 1, user, "y"), 0),
        ("f", "s", "main", 2, fx.say("user", 2, "meta", "z", isMeta=True), 0),
        ("f", "s", "main", 3, fx.say("user", 3, "[not a list", "w"), 0),
    ]
    ev = L.events(L.parse_lines(spark.createDataFrame(rows, fx.LINE_SCHEMA))).orderBy("ord", "pos").collect()
    got = [(e.event_id, e.kind, e.text, e.action, e.target, e.is_error) for e in ev]
    assert got == [
        ("x:0", "thinking", "hm", None, None, False),
        ("x:1", "tool_use", "/a/b/c/d/e.ts", "edit", "…/c/d/e.ts", False),
        ("x:2", "tool_use", "find me", "mcp", "srv · do: find me", False),
        ("x:3", "tool_use", '{"n":1,"list":[1]}', "other", '{"n":1,"list":[1]}', False),
        ("x:4", "tool_use", "foo", "search", "foo · …/b/c", False),
        ("y:1", "user", "[image]", None, None, False),
        ("y:2", "tool_result", "bad\n[image]\n[doc]", None, None, True),
        ("w:0", "user", "[not a list", None, None, False),
    ]
    assert ev[1].detail == {"file_path": "/a/b/c/d/e.ts", "edits": "2", "old_string": "x", "new_string": "y"}


def test_pairs_and_pending(lines):
    ev = L.events(lines)
    pairs = {r.tool_use_id: r for r in E.pair_calls(ev).collect()}
    assert pairs["tA3"].result.text == "Found 3 files" and pairs["tA1"].result is None
    assert {r.tool_use_id for r in E.pending_calls(ev).collect()} == {"tA1", "tN1", "tB1", "tB2", "tW1"}


def test_pages_have_no_gaps(spark):
    rows = [("s", "main", i // 3, i % 3, f"e{i}") for i in range(100)]
    ev = spark.createDataFrame(rows, "session_id string, agent_key string, ord bigint, pos int, event_id string")
    seen, before = [], None
    for _ in range(50):
        page = E.event_page(ev, tail=7, before=before).collect()
        if not page:
            break
        seen = [r.event_id for r in sorted(page, key=lambda r: (r.ord, r.pos))] + seen
        before = page[0].page_start
        if not page[0].truncated:
            break
    assert seen == [f"e{i}" for i in range(100)]
    after = E.event_page(ev, after=32).collect()
    assert len(after) == 4 and not after[0].truncated
