"""File sources on a small home folder, adapters and sinks."""

import json
import os

from pyspark.sql import functions as F

from tests import fixtures as fx
from tracelake.plans import line_log as L
from tracelake.sources import files as S
from tracelake.sources import tables


def home(tmp_path):
    proj = tmp_path / "projects" / "-w-demo"
    sub = proj / fx.S1 / "subagents"
    (sub / "workflows" / "wf_demo").mkdir(parents=True)
    logs = {}
    for _, _, key, _, line, _ in fx.line_log_rows():
        logs.setdefault(key, []).append(line)
    where = {"main": proj / f"{fx.S1}.jsonl", "w1": sub / "workflows" / "wf_demo" / "agent-w1.jsonl"}
    for key, lines in logs.items():
        where.get(key, sub / f"agent-{key}.jsonl").write_text("\r\n".join(lines) + "\n")
    old = tmp_path / "projects" / "-w-copy"
    old.mkdir()
    (old / f"{fx.S1}.jsonl").write_text('{"type":"user"}\n')
    os.utime(old / f"{fx.S1}.jsonl", (1, 1))
    (sub / "agent-a1.meta.json").write_text(json.dumps({"agentType": "worker", "toolUseId": "tA1", "spawnDepth": 1}))
    (proj / fx.S1 / "custom-title.json").write_text('{"customTitle":"From file"}')
    reg = tmp_path / "sessions"
    reg.mkdir()
    (reg / "1.json").write_text(json.dumps({"pid": 1, "sessionId": fx.S1, "status": "busy", "cwd": "/w"}))
    (reg / "2.json").write_text(json.dumps({"pid": 2, "sessionId": fx.S1, "status": "idle"}))
    (reg / "3.json").write_text("{ not json")
    (reg / "1.key").write_text("secret")
    return tmp_path


def test_line_log_home(spark, tmp_path):
    root = home(tmp_path)
    projects = str(root / "projects")
    raw = S.read_line_log(spark, projects, [projects]).cache()
    assert {(r.agent_key, r["count"]) for r in raw.groupBy("agent_key").count().collect()} == {("main", 11), ("a1", 3), ("a2", 3), ("a3", 2), ("w1", 2)}
    first = raw.where("agent_key = 'main'").orderBy("ord").first()
    assert "custom-title" in first.value
    u = L.usage(L.parse_lines(raw), fx.NOW)
    assert u.agg(F.sum(F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_create"))).first()[0] == 961
    agents = {r.agent_key: r.workflow for r in S.discover_agents(spark, projects).collect()}
    assert agents == {"a1": None, "a2": None, "a3": None, "w1": "wf_demo"}
    meta = S.read_agent_meta(spark, projects).first()
    assert (meta.agent_key, meta.agent_type, meta.spawn_depth) == ("a1", "worker", 1)
    assert S.read_title_files(spark, projects).first().title == "From file"
    alive = spark.createDataFrame([(1,)], "pid bigint")
    reg = S.read_registry(spark, str(root / "sessions"), alive).collect()
    assert [(r.pid, r.alive, r.status) for r in reg] == [(1, True, "busy")]


def test_line_order_over_many_splits(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"n": i, "pad": "x" * 900}) + "\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = S.read_lines(spark, str(tmp_path)).select(F.get_json_object("value", "$.n").cast("int").alias("n"), "ord")
        assert rows.rdd.getNumPartitions() > 1
        assert [r.n for r in rows.orderBy("ord").collect()] == list(range(4000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_offsets_are_bytes_whatever_lies_beside(spark, tmp_path):
    body = "".join(f"{i} " + "é" * (i % 7) + ("\r\n" if i % 3 else "\n") for i in range(500)) + "last, no line end"
    (tmp_path / "one.jsonl").write_bytes(body.encode())
    want, at = [], 0
    for line in body.encode().split(b"\n"):
        want.append((at, line.decode().removesuffix("\r")))
        at += len(line) + 1

    def read():
        return [(r.ord, r.value) for r in S.read_lines(spark, str(tmp_path)).where("file like '%/one.jsonl'").orderBy("ord").collect()]

    assert read() == want
    for name in ("a", "z"):
        (tmp_path / f"{name}.jsonl").write_text("x\n" * 700)
    assert read() == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        assert read() == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rollout_folders_may_be_absent(spark, tmp_path):
    now = 1_767_270_000_000
    globs = S.rollout_globs(str(tmp_path), now)
    assert S.read_rollouts(spark, globs).count() == 0
    for day in ("2025/12/31", "2026/01/01"):
        folder = tmp_path / "sessions" / day
        folder.mkdir(parents=True)
        tid = f"00000000-0000-4000-8000-0000000000{day[-2:]}"
        (folder / f"rollout-x-{tid}.jsonl").write_text('{"type":"session_meta"}\n')
    assert S.read_rollouts(spark, globs).count() == 2


def test_documents_rollouts_tables_and_sinks(spark, tmp_path):
    (tmp_path / "chats").mkdir()
    (tmp_path / "chats" / "session-a.json").write_text('{"sessionId":"a",\n"messages":[]}')
    (tmp_path / "chats" / "session-old.json").write_text('{"sessionId":"o","messages":[]}')
    os.utime(tmp_path / "chats" / "session-old.json", (1, 1))
    now = int(os.path.getmtime(tmp_path / "chats" / "session-a.json") * 1000) + 1000
    docs = S.read_doc_sessions(spark, str(tmp_path / "chats"), now).collect()
    assert [d.value for d in docs] == ['{"sessionId":"a",\n"messages":[]}']
    assert S.rollout_globs("/r", 1_767_270_000_000)[0] == "/r/sessions/2025/12/30" and len(S.rollout_globs("/r", 1_767_270_000_000)) == 4
    day = tmp_path / "sessions" / "2026" / "01" / "01"
    day.mkdir(parents=True)
    (day / "rollout-2026-01-01T00-00-00-0000000A-0000-4000-8000-000000000000.jsonl").write_text("{}\n{}\n")
    (day / "rollout-auth-x.jsonl").write_text("{}\n")
    r = S.read_rollouts(spark, [str(day)], roots=[str(tmp_path)]).collect()
    assert {x.thread_id for x in r} == {"0000000a-0000-4000-8000-000000000000"} and len(r) == 2
    cur = spark.createDataFrame([("a", 1), ("b", 1)], "id string, time_updated bigint")
    new = spark.createDataFrame([("a", 5), ("c", 7)], "id string, time_updated bigint")
    got = {x.id: x.time_updated for x in tables.upsert(cur, tables.changed_since(new, 1)).collect()}
    assert got == {"a": 5, "b": 1, "c": 7} and tables.high_water(new, 0) == 7
    S.write_table(cur, str(tmp_path / "out"), fmt="json")
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    raw = spark.createDataFrame(fx.line_log_rows(), fx.LINE_SCHEMA)
    assert S.normalize_events(raw, "line_log").count() == 18


def test_chain_store_allow_list(spark, tmp_path):
    pid = "0000000a-0000-4000-8000-000000000000"
    for folder in (pid, "not-a-project"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "project.json").write_text('{"name":"Demo"}')
    got = S.read_project_names(spark, str(tmp_path)).collect()
    assert [(r.project_id, r.name) for r in got] == [(pid, "Demo")]
    paths = [f"/r/{pid}/.internal/ng-sessions.sqlite", f"/r/{pid}/settings.json", f"/x/{pid}/project.json"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r[0] for r in df.orderBy("i").select(S.allowed_store_file("p", "/r")).collect()] == [True, False, False]
