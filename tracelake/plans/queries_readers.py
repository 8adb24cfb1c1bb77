"""Readers over files and store tables: the driver tables are landed as logs of each layout in the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.plans import rollout
from tracelake.plans.binding import table
from tracelake.session import shared_folder
from tracelake.sources import files, tables

QUERIES: dict = {}
ORACLES: dict = {}
#: Modification times that the landed files get, and "now" of the readers that look at age.
_AT = 1_704_326_400_000  # 2024-01-04T00:00:00Z
_HOUR = 3_600_000
_THREAD = "00000000-0000-4000-8000-"


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


def land(spark: SparkSession, rows: DataFrame, target: Callable[[int], str], mtime: Callable[[int], int] = lambda k: _AT) -> str:
    """``f, ord, value`` as one text file for each ``f`` (nations: a few dozen), under the name and with the time given for it.

    The lines of a file are written by one task, as a file of a session is; the driver only renames what Spark has written.
    The result is the folder, named as the readers name paths.
    """
    run = f"{shared_folder(spark)}/readers-{uuid.uuid4().hex}"
    rows.repartition("f").sortWithinPartitions("f", "ord").select("f", "value").write.partitionBy("f").text(f"{run}/landed")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(run).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in fs.listStatus(path(f"{run}/landed")):
        if not folder.isDirectory():
            continue
        k = int(folder.getPath().getName().removeprefix("f="))
        to = path(f"{run}/home/{target(k)}")
        fs.mkdirs(to.getParent())
        for part in fs.listStatus(folder.getPath()):
            fs.rename(part.getPath(), to)
        fs.setTimes(to, mtime(k), -1)
    home = fs.makeQualified(path(f"{run}/home")).toString()
    return "/" + home.removeprefix("file:").lstrip("/") if home.startswith("file:") else home


# ---------------------------------------------------------------------------------------------- line logs
#: Customers of a nation are a main log; suppliers are a second log of the same id for every third nation, and a sub-agent's log.
_LOG = """b AS (SELECT c_nationkey AS n, 0 AS what, c_custkey AS id, CAST(c_custkey AS VARCHAR) || ',' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' é' ELSE '' END AS body FROM customer
    UNION ALL SELECT s_nationkey, 100, s_suppkey, CAST(s_suppkey AS VARCHAR) || ',' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' é' ELSE '' END FROM supplier WHERE s_nationkey % 3 = 0
    UNION ALL SELECT s_nationkey, 200, s_suppkey, CAST(s_suppkey AS VARCHAR) || ',' || s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' é' ELSE '' END FROM supplier),
  z AS (SELECT *, octet_length(encode(body)) + 1 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS size FROM b),
  l AS (SELECT *, CAST(sum(size) OVER (PARTITION BY n, what ORDER BY id) - size AS BIGINT) AS ord FROM z),
  newest AS (SELECT n, what, what = 100 AS is_copy, CAST(sum(size) AS BIGINT) AS length,
      1704326400000 + CASE WHEN what = 0 THEN 0 WHEN n % 2 = 0 THEN 3600000 ELSE -3600000 END AS mtime
    FROM z WHERE what < 200 GROUP BY n, what QUALIFY row_number() OVER (PARTITION BY n ORDER BY mtime DESC) = 1)"""
_SESSION = "'session-' || lpad(CAST(n AS VARCHAR), 4, '0')"


def _line_logs(spark: SparkSession, sf: str) -> str:
    def lines(name: str, key: str, label: str, nation: str, what: int) -> DataFrame:
        id = F.col(key)
        body = F.concat(id.cast("string"), F.lit(","), F.col(label), F.when(id % 3 == 0, F.lit(" é")).otherwise(""), F.when(id % 2 == 0, F.lit("\r")).otherwise(""))
        return table(spark, sf, name).select((F.col(nation) + what).alias("f"), id.alias("ord"), body.alias("value"))

    sup = lambda what: lines("supplier", "s_suppkey", "s_name", "s_nationkey", what)
    rows = lines("customer", "c_custkey", "c_name", "c_nationkey", 0).unionByName(sup(100).where("f % 100 % 3 = 0")).unionByName(sup(200))

    def target(k: int) -> str:
        what, n = divmod(k, 100)
        own = f"session-{n:04d}"
        deep = f"workflows/wf_{n % 3}/" if n % 2 else ""
        return (f"main/{own}.jsonl", f"copy/{own}.jsonl", f"main/{own}/subagents/{deep}agent-s{n}.jsonl")[what]

    return land(spark, rows, target, lambda k: _AT + (0 if k // 100 != 1 else _HOUR if k % 2 == 0 else -_HOUR))


@query(f"WITH {_LOG} SELECT n, what, id, ord FROM l")
def line_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every log with the byte at which it begins, line ends of both kinds."""
    lines = files.read_lines(spark, _line_logs(spark, sf))
    n = F.coalesce(F.regexp_extract("file", r"session-(\d+)", 1).cast("int"), F.lit(-1))
    what = F.when(F.contains("file", F.lit("/subagents/")), 200).when(F.contains("file", F.lit("/copy/")), 100).otherwise(0)
    return lines.select(n.alias("n"), what.alias("what"), F.split("value", ",")[0].cast("bigint").alias("id"), "ord")


@query(f"WITH {_LOG} SELECT {_SESSION} AS session_id, is_copy, length, mtime FROM newest")
def session_files(spark: SparkSession, sf: str) -> DataFrame:
    """Main logs by session; where two folders have one id the newer file wins."""
    found = files.discover_sessions(spark, _line_logs(spark, sf))
    return found.select("session_id", F.contains("path", F.lit("/copy/")).alias("is_copy"), "length", "mtime")


@query(
    f"WITH {_LOG} SELECT {_SESSION} AS session_id, CASE WHEN what = 200 THEN 's' || CAST(n AS VARCHAR) ELSE 'main' END AS agent_key, count(*) AS n_lines, CAST(sum(ord) AS BIGINT) AS offsets, "
    "CAST(sum(id) AS BIGINT) AS ids, CAST(sum(length(body)) AS BIGINT) AS chars FROM l WHERE what = 200 OR (n, what) IN (SELECT (n, what) FROM newest) GROUP BY 1, 2"
)
def session_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of all main and sub-agent logs; of a session in two folders only those of the newer file."""
    raw = files.read_line_log(spark, _line_logs(spark, sf))
    return raw.groupBy("session_id", "agent_key").agg(
        F.count("*").alias("n_lines"), F.sum("ord").alias("offsets"), F.sum(F.split("value", ",")[0].cast("bigint")).alias("ids"), F.sum(F.length("value")).alias("chars")
    )


@query(
    f"SELECT DISTINCT 'session-' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS session_id, 's' || CAST(s_nationkey AS VARCHAR) AS agent_key, "
    f"CASE WHEN s_nationkey % 2 = 1 THEN 'wf_' || CAST(s_nationkey % 3 AS VARCHAR) END AS workflow, CAST({_AT} AS BIGINT) AS mtime FROM supplier"
)
def agent_files(spark: SparkSession, sf: str) -> DataFrame:
    return files.discover_agents(spark, _line_logs(spark, sf)).select("session_id", "agent_key", "workflow", "mtime")


@query(
    "SELECT 'session-' || lpad(CAST(s_nationkey AS VARCHAR), 4, '0') AS session_id, 's' || CAST(s_nationkey AS VARCHAR) AS agent_key, max(s_name) AS agent_type, "
    "CASE WHEN s_nationkey % 2 = 0 THEN min(s_name) END AS tool_use_id, CAST(count(*) AS INTEGER) AS spawn_depth FROM supplier GROUP BY s_nationkey"
)
def agent_meta_files(spark: SparkSession, sf: str) -> DataFrame:
    """Side files of sub-agents; an empty field is none."""
    by = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("f")).agg(F.max("s_name").alias("agentType"), F.min("s_name").alias("tool"), F.count("*").alias("spawnDepth"))
    value = F.to_json(F.struct("agentType", F.when(F.col("f") % 2 == 0, F.col("tool")).otherwise("").alias("toolUseId"), "spawnDepth"))
    home = land(spark, by.select("f", F.lit(0).alias("ord"), value.alias("value")), lambda k: f"main/session-{k:04d}/subagents/agent-s{k}.meta.json")
    return files.read_agent_meta(spark, home).select("session_id", "agent_key", "agent_type", "tool_use_id", "spawn_depth")


# ---------------------------------------------------------------------------------------------- rollouts
@query(
    f"""WITH c AS (SELECT c_nationkey AS n, c_mktsegment AS seg, c_custkey AS id FROM customer)
    SELECT '{_THREAD}' || lpad(CAST(n AS VARCHAR), 12, '0') AS thread_id, n % 6 = 5 AS archived, CASE WHEN id % 4 = 0 THEN 'event_msg' ELSE 'response_item' END AS head_type, seg AS head_ptype,
      count(*) AS n_lines, max(1704067200000 + id) AS last_ms, CAST(sum(id) AS BIGINT) AS ids
    FROM c WHERE n % 6 = 5 OR n % 6 BETWEEN 1 AND 4 GROUP BY ALL"""
)
def rollout_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Thread logs of the day folders inside the window and of the archive; what a line is, is told without parsing all of it."""
    c = table(spark, sf, "customer")
    at = F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("c_custkey")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    kind = F.when(F.col("c_custkey") % 4 == 0, "event_msg").otherwise("response_item")
    value = F.to_json(F.struct(at.alias("timestamp"), F.col("c_custkey").alias("ordinal"), kind.alias("type"), F.struct(F.col("c_mktsegment").alias("type")).alias("payload")))

    def target(k: int) -> str:  # day 1 of the month lies before the window
        name = f"rollout-2024-01-01T00-00-00-{_THREAD}{k:012d}.jsonl"
        return f"archive/{name}" if k % 6 == 5 else f"sessions/2024/01/{k % 6 + 1:02d}/{name}"

    home = land(spark, c.select(F.col("c_nationkey").alias("f"), F.col("c_custkey").alias("ord"), value.alias("value")), target)
    raw = files.read_rollouts(spark, files.rollout_globs(home, _AT), f"{home}/archive")
    told = rollout.peek(raw).withColumn("id", F.get_json_object("value", "$.ordinal").cast("bigint"))
    return told.groupBy("thread_id", "archived", "head_type", "head_ptype").agg(F.count("*").alias("n_lines"), F.max("ts_ms").alias("last_ms"), F.sum("id").alias("ids"))


@query(
    f"""WITH RECURSIVE t AS (SELECT p_partkey AS k, p_partkey // 3 AS up, p_size FROM part),
    got AS (SELECT k, up FROM t WHERE p_size >= 40 UNION SELECT t.k, t.up FROM got JOIN t ON t.k = got.up AND got.up <> got.k)
    SELECT DISTINCT '{_THREAD}' || lpad(CAST(k AS VARCHAR), 12, '0') AS id, p_name AS title FROM got JOIN part ON p_partkey = k"""
)
def thread_index(spark: SparkSession, sf: str) -> DataFrame:
    """Index rows updated since a time, and every ancestor they lack."""
    thread = lambda c: F.concat(F.lit(_THREAD), F.lpad(c.cast("string"), 12, "0"))
    k, up = F.col("p_partkey"), F.expr("p_partkey div 3")
    source = F.to_json(F.struct(F.struct(F.when(k != up, thread(up)).alias("parent_thread_id")).alias("subagent")))
    rows = table(spark, sf, "part").select(
        F.upper(thread(k)).alias("id"), F.concat(F.lit("/r/"), k.cast("string")).alias("rollout_path"), F.col("p_size").cast("bigint").alias("updated_at"), source.alias("source"), F.col("p_name").alias("title")
    )
    return rollout.read_threads(rows, 40_000).select("id", "title")


# ---------------------------------------------------------------------------------------------- documents and stores
@query(
    f"SELECT 'session-' || CAST(c_nationkey AS VARCHAR) AS name, CAST({_AT} - c_nationkey * {_HOUR} * 2 AS BIGINT) AS mtime, count(*) AS n_members, CAST(sum(c_custkey) AS BIGINT) AS ids "
    "FROM customer WHERE c_nationkey <= 12 GROUP BY c_nationkey"
)
def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Whole-document sessions; files older than a day are left in the listing."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("f"), F.col("c_custkey").alias("ord"), F.to_json(F.struct("c_custkey")).alias("value"))
    first, last = (c.groupBy("f").agg(F.lit(k).cast("bigint").alias("ord"), F.lit(v).alias("value")) for k, v in ((-1, '{"members":['), (2**62, "null]}")))
    body = c.withColumn("value", F.concat("value", F.lit(",")))
    home = land(spark, body.unionByName(first).unionByName(last), lambda k: f"chats/session-{k}.json", lambda k: _AT - k * 2 * _HOUR)
    docs = files.read_doc_sessions(spark, home, _AT)
    members = F.filter(F.from_json("value", "members array<struct<c_custkey:bigint>>")["members"], lambda m: m.isNotNull())
    return docs.select(
        F.regexp_extract("file", r"(session-\d+)\.json", 1).alias("name"), "mtime", F.size(members).cast("bigint").alias("n_members"),
        F.aggregate(members, F.lit(0).cast("bigint"), lambda s, m: s + m["c_custkey"]).alias("ids"),
    )


@query(
    """WITH s AS (SELECT 'ses_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_custkey AS k FROM customer WHERE c_custkey % 10 <> 0),
    o AS (SELECT o_custkey AS k, count(*) AS messages FROM orders GROUP BY 1), p AS (SELECT o_custkey AS k, count(*) AS parts FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
    SELECT id, CAST(NULL AS VARCHAR) AS parent_id, coalesce(messages, 0) AS messages, coalesce(parts, 0) AS parts FROM s LEFT JOIN o USING (k) LEFT JOIN p USING (k)"""
)
def part_store_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The three tables of a part store: foreign ids go, absent columns are null."""
    name = lambda c: F.concat(F.when(c % 10 == 0, "old_").otherwise("ses_"), F.lpad(c.cast("string"), 8, "0"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey"), name(F.col("o_custkey")).alias("session_id"))
    messages = o.select(F.col("o_orderkey").cast("string").alias("id"), "session_id", F.lit("{}").alias("data"))
    li = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "session_id", F.lit("{}").alias("data"))
    sessions = table(spark, sf, "customer").select(name(F.col("c_custkey")).alias("id"), F.col("c_name").alias("title"))
    s, m, p = tables.read_part_store(sessions, messages, parts)
    per = lambda t, n: t.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias(n))
    return s.select("id", "parent_id").join(per(m, "messages"), "id", "left").join(per(p, "parts"), "id", "left").fillna(0, ["messages", "parts"])


@query(
    "SELECT 'conv-' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS conversation_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS title, "
    "CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS step_count FROM customer"
)
def summary_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Summary tables in turn: the first that knows an id wins, one of another layout is skipped."""
    c = table(spark, sf, "customer").withColumns({"conversation_id": F.concat(F.lit("conv-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")), "last_modified_time": F.lit("2024-01-01")})
    first = c.where("c_custkey % 3 = 0").select("conversation_id", "last_modified_time", F.col("c_name").alias("title"))
    second = c.select("conversation_id", "last_modified_time", F.col("c_mktsegment").alias("title"), F.col("c_nationkey").alias("step_count"))
    strange = c.select("conversation_id", F.lit("x").alias("title"))
    return tables.read_summaries([strange, first, second]).select("conversation_id", "title", "step_count")


@query(
    f"""SELECT '{_THREAD}' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS session_id, n_name AS project_name
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 5 <> 0"""
)
def chain_store_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a chain store with the names of their projects, where a project file gives one."""
    uid = lambda c: F.concat(F.lit(_THREAD), F.lpad(c.cast("string"), 12, "0"))
    c = table(spark, sf, "customer").select(uid(F.col("c_custkey")).alias("session_id"), uid(F.col("c_nationkey")).alias("project_id"))
    value = F.to_json(F.struct(F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("name")))
    named = table(spark, sf, "nation").select(F.col("n_nationkey").alias("f"), F.lit(0).alias("ord"), value.alias("value"))
    home = land(spark, named, lambda k: f"{_THREAD}{k:012d}/project.json")
    names = files.read_project_names(spark, home)
    sessions, _ = tables.read_chain_store(c, c.select(F.col("session_id").alias("id"), F.lit("{}").alias("entry_json")))
    return sessions.join(names, "project_id", "left").select("session_id", F.col("name").alias("project_name"))


# ---------------------------------------------------------------------------------------------- spawn calls
@query(
    f"""WITH calls AS (SELECT o_custkey % 50 AS own, o_custkey % 7 AS task, o_orderkey AS k FROM orders)
    SELECT '{_THREAD}' || lpad(CAST(own AS VARCHAR), 12, '0') AS thread_id, 'task' || CAST(task AS VARCHAR) AS task, 'call' || CAST(max(k) AS VARCHAR) AS tool_use_id FROM calls GROUP BY ALL"""
)
def spawn_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The latest call of a thread that starts an agent of a task."""
    k, own = F.col("o_orderkey"), F.col("o_custkey") % 50
    given = F.to_json(F.struct(F.concat(F.lit("task"), (F.col("o_custkey") % 7).cast("string")).alias("task_name")))
    payload = F.struct(F.lit("function_call").alias("type"), F.lit("collab.spawn_agent").alias("name"), F.concat(F.lit("call"), k.cast("string")).alias("call_id"), given.alias("arguments"))
    raw = table(spark, sf, "orders").select(
        F.lit("f").alias("file"), F.concat(F.lit(_THREAD), F.lpad(own.cast("string"), 12, "0")).alias("thread_id"), k.alias("ord"), F.to_json(F.struct(F.lit("response_item").alias("type"), payload.alias("payload"))).alias("value")
    )
    calls = rollout.spawn_calls(rollout.parse_lines(raw))
    return calls.select(F.col("__owner").alias("thread_id"), F.col("__task").alias("task"), "tool_use_id")
