"""Queries whose work must not grow faster than their rows: batches, repeated parsing, tasks of one key."""

import datetime
import json

from tracelake.operators import topics as TP
from tracelake.plans import part_store, queries_stream, rollout


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_chunks_come_in_a_fixed_number_of_batches(spark, tmp_path, monkeypatch):
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, at, k * 5, "view", 1.0, "{}") for k in range(13500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(queries_stream, "_run_dir", lambda spark: f"{tmp_path}/run")
    got = {(r.file, r.epoch): (r.n, r.ids) for r in queries_stream.stream_chunks(spark, str(tmp_path)).collect()}
    want = {}
    for k in range(13500):
        n, ids = want.get((f"u{k * 5 % 7}", int(k >= 6000)), (0, 0))
        want[f"u{k * 5 % 7}", int(k >= 6000)] = (n + 1, ids + k)
    assert got == want
    assert len([f for f in (tmp_path / "run" / "ck" / "commits").iterdir() if f.name.isdigit()]) == queries_stream.BATCHES


def test_spawn_lines_are_parsed_once(spark):
    def line(tool, call, **given):
        return json.dumps({"type": "response_item", "payload": {"type": "function_call", "name": tool, "call_id": call, "arguments": json.dumps(given)}})

    rows = [("f", "t", 1, line("collab.spawn_agent", "c1", task_name="a")), ("f", "t", 2, line("spawn_agent", "c2", name="a")), ("f", "t", 3, line("spawn_agent", "", name="b")),
            ("f", "t", 4, line("shell", "c4", name="b")), ("f", "u", 1, line("spawn_agent", "c5", task_name="", agent_nickname="z")), ("f", "u", 2, line("spawn_agent", "c6")), ("f", "u", 3, None)]
    calls = rollout.spawn_calls(rollout.parse_lines(spark.createDataFrame(rows, "file string, thread_id string, ord long, value string")))
    assert {tuple(r) for r in calls.collect()} == {("t", "a", "c2"), ("u", "z", "c5")}
    assert plan(calls).count("from_json(") <= 3  # the head, the line and the arguments


def test_agents_of_one_word_are_dealt_to_many_tasks(spark):
    schema = "session_id string, agent_key long, is_main boolean, label string, kind string, slot string, project string, title string"
    rows = [("s", k, False, "kubernetes item" + "abcdefghij"[k] if k < 5 else "lonely thing" + "abcdefghij"[k], "other", "o|p", "p", "") for k in range(10)]
    out = TP.cluster_loose(spark.createDataFrame(rows, schema))
    assert {r.agent_key: (r.slot, r.title) for r in out.collect() if r.agent_key < 5} == {k: ("c|p|kuber", "Kubernetes") for k in range(5)}
    assert sum("Join" in x and "__salt" in x for x in plan(out).splitlines()) >= 2
    assert not [x for x in plan(out).splitlines() if "Join" in x and "label" in x]


def test_parts_are_parsed_once_a_use(spark):
    sessions = spark.createDataFrame([("s1", None, "one", 5, 9)], "id string, parent_id string, title string, time_created long, time_updated long")
    messages = spark.createDataFrame([("m1", "s1", 5, '{"role":"user"}')], "id string, session_id string, time_created long, data string")
    parts = spark.createDataFrame(
        [("p1", "m1", "s1", 6, 6, '{"type":"text","text":"hello"}'), ("p2", "m1", "s1", 7, 7, '{"type":"tool","tool":"read","state":{"status":"completed"}}'), ("p3", "m1", "s1", 8, 8, "x")],
        "id string, message_id string, session_id string, time_created long, time_updated long, data string",
    )
    from tracelake.sources.tables import read_part_store

    out = part_store.nodes(*read_part_store(sessions, messages, parts), 100)
    r = out.select("native_id", "last_prompt", "tool_calls", "ticks").first()
    assert plan(out).count("from_json(") <= 2  # the calls that start sessions, and the ticks
