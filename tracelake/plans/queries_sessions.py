"""Trees, states, sessions, activity, changes and pages over the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelake.operators import activity as A
from tracelake.operators import changes as C
from tracelake.operators import churn as H
from tracelake.operators import events as E
from tracelake.operators import sessions as S
from tracelake.operators import tree as T
from tracelake.operators.pricing import price_table
from tracelake.operators.state import infer_state, open_turns
from tracelake.plans.binding import DAY_MS, EVENTS_SQL, NOW, event_lines, part_nodes, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------------------------------------- trees
_TREE = """RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey // 3 <> p_partkey THEN p_partkey // 3 END AS parent, p_size,
      CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part),
    t AS (SELECT id, id AS root, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL
      UNION ALL SELECT n.id, t.root, t.depth + 1, list_append(t.path, n.id) FROM n JOIN t ON n.parent = t.id)"""


@query(f"WITH {_TREE} SELECT id, root, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path FROM t")
def tree_resolve(spark, sf):
    t = T.resolve_tree(part_nodes(spark, sf).select("id", "parent"))
    return t.select("id", "root", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def _loops(spark: SparkSession, sf: str) -> DataFrame:
    """Orders point at each other through customer and date, which yields cycles, tails and self links."""
    p = table(spark, sf, "part")
    hop = F.when(F.col("p_size") > 47, F.lit(None)).otherwise(F.expr("(p_partkey * 31 + p_size) % 4999"))
    return p.select(F.col("p_partkey").alias("id"), hop.cast("bigint").alias("parent"))


@query(
    """WITH RECURSIVE raw AS (SELECT p_partkey AS id, CASE WHEN p_size <= 47 THEN (p_partkey * 31 + p_size) % 4999 END AS p FROM part),
    n AS (SELECT raw.id, CASE WHEN raw.p <> raw.id THEN k.id END AS parent FROM raw LEFT JOIN raw k ON k.id = raw.p),
    reach AS (SELECT id AS s, parent AS x FROM n WHERE parent IS NOT NULL
      UNION SELECT r.s, n.parent FROM reach r JOIN n ON n.id = r.x WHERE n.parent IS NOT NULL),
    cyc AS (SELECT s, min(x) AS low FROM reach WHERE s IN (SELECT s FROM reach WHERE s = x) GROUP BY 1)
    SELECT n.id, CASE WHEN cyc.low = n.id THEN NULL ELSE n.parent END AS parent FROM n LEFT JOIN cyc ON cyc.s = n.id"""
)
def tree_cycles(spark, sf):
    return T.cut_cycles(_loops(spark, sf))


@query(
    f"""WITH {_TREE}, u AS (SELECT unnest(path) AS ancestor, id FROM t)
    SELECT ancestor, CAST(count(*) AS BIGINT) AS nodes, CAST(sum(cents) AS BIGINT) AS cents, CAST(max(p_size) AS INTEGER) AS max_size,
      bool_or(p_size > 48) AS live FROM u JOIN n USING (id) GROUP BY 1"""
)
def subtree_rollup(spark, sf):
    t = T.resolve_tree(part_nodes(spark, sf))
    return T.subtree_rollup(
        t,
        [
            F.count(F.lit(1)).alias("nodes"), F.sum("cents").alias("cents"), F.max("p_size").alias("max_size"),
            F.bool_or(F.col("p_size") > 48).alias("live"),
        ],
    )


@query(f"WITH {_TREE} SELECT DISTINCT u.id FROM (SELECT unnest(t.path) AS id FROM t JOIN n USING (id) WHERE n.p_size > 48) u")
def keep_ancestors(spark, sf):
    return T.keep_ancestors(T.resolve_tree(part_nodes(spark, sf)), F.col("p_size") > 48).select("id")


@query(
    f"""WITH {_TREE}, open AS (SELECT DISTINCT unnest(t.path) AS id FROM t JOIN n USING (id) WHERE n.p_size > 45),
    shown AS (SELECT path FROM t WHERE depth = 0 OR id IN (SELECT id FROM open))
    SELECT DISTINCT unnest(path) AS id FROM shown"""
)
def collapse_finished(spark, sf):
    return T.collapse_finished(T.resolve_tree(part_nodes(spark, sf)), F.col("p_size") <= 45).select("id")


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, event_id, max(event_id) OVER (PARTITION BY user_id) AS head,
      CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS BIGINT) AS hops FROM ev
    UNION ALL SELECT user_id, event_id, CAST(-1 AS BIGINT), row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) FROM ev WHERE user_id % 3 = 0
    UNION ALL SELECT DISTINCT user_id, CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM ev WHERE user_id % 3 = 0"""
)
def chain_walk(spark, sf):
    e = event_lines(spark, sf).select("user_id", "event_id")
    from tracelake.operators.segments import previous_row

    linked = previous_row(e, ["user_id"], "event_id", ["event_id"], "p").select("user_id", "event_id", F.col("p.event_id").alias("previous_id"))
    heads = e.groupBy("user_id").agg(F.max("event_id").alias("head"), F.min("event_id").alias("low"))
    # every third chain is closed to a ring, which an entry -1 leads into; a ring is cut behind its smallest id
    ring = heads.where("user_id % 3 = 0")
    closed = linked.join(ring.select("user_id", F.col("low").alias("event_id"), F.col("head").alias("__to")), ["user_id", "event_id"], "left")
    closed = closed.select("user_id", "event_id", F.coalesce("previous_id", "__to").alias("previous_id"))
    entry = F.lit(-1).cast("bigint")
    closed = closed.unionByName(ring.select("user_id", entry.alias("event_id"), F.col("head").alias("previous_id")))
    return T.walk_chain(closed, heads.select("user_id", "head").union(ring.select("user_id", entry)), "event_id", by=["user_id"])


@query(
    f"""WITH {_TREE}, s AS (SELECT id, parent FROM n WHERE p_size > 48),
    a AS (SELECT id, id AS x, 0 AS d FROM s UNION ALL SELECT a.id, n.parent, d + 1 FROM a JOIN n ON n.id = a.x WHERE n.parent IS NOT NULL AND d < 6)
    SELECT DISTINCT x AS id FROM a"""
)
def missing_ancestors(spark, sf):
    n = part_nodes(spark, sf)
    n = n.withColumn("parent", F.when(F.col("parent") != F.col("id"), F.col("parent")))
    return T.add_missing_ancestors(n.where(F.col("p_size") > 48), n).select("id")


# ---------------------------------------------------------------------------------------------- states


def _agent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Agents of a user are the k values of their events; facts come from the events of each k."""
    e = event_lines(spark, sf)
    return e.groupBy(F.col("user_id").alias("session_id"), F.col("k").alias("agent_key")).agg(
        F.min("ts_ms").alias("started_at"),
        F.max("ts_ms").alias("last_ts"),
        F.max_by("event_type", "event_id").alias("last_type"),
        F.max_by("units", "event_id").alias("last_units"),
        F.count(F.lit(1)).alias("n"),
        F.sum("units").alias("units"),
    )


_AGENTS = """a AS (SELECT user_id AS session_id, k AS agent_key, min(ts_ms) AS started_at, max(ts_ms) AS last_ts,
      arg_max(event_type, event_id) AS last_type, arg_max(units, event_id) AS last_units, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM ev GROUP BY 1, 2)"""


@query(
    f"""WITH {EVENTS_SQL}, {_AGENTS}, f AS (SELECT *, CASE last_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'stopped' END AS outcome FROM a)
    SELECT session_id, agent_key, CASE WHEN agent_key = 0 THEN (CASE WHEN n > 1 THEN (CASE WHEN last_type = 'view' THEN 'running' ELSE 'idle' END) ELSE 'done' END)
      WHEN last_units > 1000 AND outcome IS NOT NULL THEN outcome
      WHEN last_type = 'purchase' THEN 'done' WHEN {NOW} - last_ts < {3 * DAY_MS} THEN 'running' ELSE 'stalled' END AS state FROM f"""
)
def state_line_log(spark, sf):
    a = _agent_rows(spark, sf)
    word = (
        F.when(F.col("last_type") == "view", "completed").when(F.col("last_type") == "error", "failed").when(F.col("last_type") == "click", "killed").otherwise("progress")
    )
    facts = a.withColumns(
        {
            "is_main": F.col("agent_key") == 0,
            "alive": F.col("n") > 1,
            "reg_status": F.when(F.col("last_type") == "view", "busy").otherwise("idle"),
            "note_status": word,
            # a note counts when nothing happened more than five seconds after it
            "note_ts": F.when(F.col("last_units") > 1000, F.col("last_ts") - 4000).otherwise(F.col("last_ts") - 6000),
            "mtime": F.col("started_at"),
            "last_role": F.when(F.col("last_type") == "purchase", "assistant").otherwise("user"),
            "last_stop": F.lit("end_turn"),
        }
    )
    return infer_state(facts, "line_log", NOW, stall_ms=3 * DAY_MS).select("session_id", "agent_key", "state")


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """Signups open turn k mod 5; purchases complete and errors abort one (or all, when it is not open)."""
    e = event_lines(spark, sf).where(F.col("event_type").isin("signup", "purchase", "error"))
    outcome = F.when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "aborted")
    return e.select(
        "user_id", "event_id", "ts_ms", (F.col("event_type") == "signup").alias("started"), (F.col("k") % 5).cast("string").alias("turn_id"), outcome.alias("outcome")
    )


_TURN_FOLD = """RECURSIVE ev AS (SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000 AS ts_ms FROM events),
    q AS (SELECT user_id, event_id, event_type = 'signup' AS started, k % 5 AS turn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn
      FROM ev WHERE event_type IN ('signup', 'purchase', 'error')),
    f AS (SELECT user_id, rn, CASE WHEN started THEN [turn] ELSE [] END AS open, CASE WHEN started THEN NULL ELSE event_id END AS emptied FROM q WHERE rn = 1
      UNION ALL SELECT f.user_id, q.rn,
        CASE WHEN q.started THEN (CASE WHEN list_contains(f.open, q.turn) THEN f.open ELSE list_append(f.open, q.turn) END)
             WHEN list_contains(f.open, q.turn) THEN list_filter(f.open, lambda x: x <> q.turn) ELSE [] END,
        CASE WHEN NOT q.started AND (NOT list_contains(f.open, q.turn) OR len(f.open) = 1) THEN q.event_id ELSE f.emptied END
      FROM f JOIN q ON q.user_id = f.user_id AND q.rn = f.rn + 1),
    e AS (SELECT user_id, len(open) AS open_turns, emptied AS emptied_at FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)"""


@query(f"WITH {_TURN_FOLD} SELECT user_id, CAST(open_turns AS BIGINT) AS open_turns, emptied_at FROM e")
def turns_open(spark, sf):
    return open_turns(_turns(spark, sf), ["user_id"], "event_id").select("user_id", "open_turns", "emptied_at")


@query(
    f"""WITH {_TURN_FOLD}, m AS (SELECT user_id, max(ts_ms) AS mtime,
        CASE arg_max(event_type, event_id) FILTER (WHERE event_type IN ('purchase', 'error')) WHEN 'purchase' THEN 'complete' WHEN 'error' THEN 'aborted' END AS ended,
        arg_max(event_type, event_id) = 'view' AS archived FROM ev GROUP BY 1)
    SELECT m.user_id, CASE WHEN NOT archived AND coalesce(open_turns, 0) > 0 AND {NOW} - mtime <= {DAY_MS} THEN 'running'
      WHEN NOT archived AND {NOW} - mtime <= {DAY_MS // 2} THEN 'idle' WHEN ended = 'aborted' AND coalesce(open_turns, 0) = 0 THEN 'stopped' ELSE 'done' END AS state
    FROM m LEFT JOIN e USING (user_id)"""
)
def state_rollout(spark, sf):
    turns = open_turns(_turns(spark, sf), ["user_id"], "event_id")
    m = event_lines(spark, sf).groupBy("user_id").agg(
        F.max("ts_ms").alias("mtime"), (F.max_by("event_type", "event_id") == "view").alias("archived")
    )
    facts = m.join(turns, "user_id", "left")
    return infer_state(facts, "rollout", NOW, stall_ms=DAY_MS, live_ms=DAY_MS // 2).select("user_id", "state")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, max(ts_ms) AS updated_at, arg_max(units, event_id) FILTER (WHERE event_type IN ('view', 'error')) AS u,
      arg_max(k, event_id) FILTER (WHERE event_type IN ('view', 'error')) AS k, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'error')) AS t FROM ev GROUP BY 1)
    SELECT user_id, CASE WHEN t IS NOT NULL AND NOT (t = 'view' AND u > 4000) AND t <> 'error' AND {NOW} - updated_at <= {DAY_MS} THEN 'running'
      WHEN {NOW} - updated_at <= {DAY_MS // 2} THEN 'idle' WHEN t = 'error' AND k < 50 THEN 'stopped' WHEN t = 'error' THEN 'failed' ELSE 'done' END AS state FROM m"""
)
def state_part(spark, sf):
    e = event_lines(spark, sf)
    said = F.when(F.col("event_type").isin("view", "error"), F.col("event_id"))
    f = e.groupBy("user_id").agg(
        F.max("ts_ms").alias("updated_at"), F.max_by(F.struct("event_type", "units", "k", "ts_ms"), said).alias("m"), F.max(said).isNotNull().alias("has_last")
    )
    f = f.withColumns(
        {
            "completed_at": F.when((F.col("m.event_type") == "view") & (F.col("m.units") > 4000), F.col("m.ts_ms")),
            "error_name": F.when(F.col("m.event_type") == "error", F.when(F.col("m.k") < 50, "MessageAbortedError").otherwise("ProviderError")),
        }
    )
    return infer_state(f, "part_store", NOW, stall_ms=DAY_MS, live_ms=DAY_MS // 2).select("user_id", "state")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, max(ts_ms) AS mtime, arg_max(event_type, event_id) AS t, arg_max(k, event_id) AS k FROM ev GROUP BY 1)
    SELECT user_id, CASE WHEN {NOW} - mtime <= {DAY_MS // 2} AND (t = 'signup' OR (k < 50 AND t = 'click')) THEN 'running'
      WHEN {NOW} - mtime <= {DAY_MS} THEN 'idle' ELSE 'done' END AS state FROM m"""
)
def state_document(spark, sf):
    f = event_lines(spark, sf).groupBy("user_id").agg(
        F.max("ts_ms").alias("mtime"), F.max_by("event_type", "event_id").alias("t"), (F.max_by("k", "event_id") < 50).alias("pending_call")
    )
    f = f.withColumn("last_type", F.when(F.col("t") == "signup", "user").when(F.col("t") == "click", "gemini").otherwise("info"))
    return infer_state(f, "document", NOW, live_ms=DAY_MS // 2, idle_ms=DAY_MS).select("user_id", "state")


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT user_id, max(ts_ms) AS la, count(*) AS n, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS t FROM ev GROUP BY 1)
    SELECT user_id, CASE WHEN n <= 2 THEN 'done' WHEN t IN ('signup', 'click') AND {NOW} - la <= {DAY_MS // 2} THEN 'running' WHEN {NOW} - la <= {DAY_MS} THEN 'idle'
      WHEN t = 'error' THEN 'failed' WHEN t = 'purchase' THEN 'stopped' ELSE 'done' END AS state FROM m"""
)
def state_chain(spark, sf):
    significant = F.when(F.col("event_type") != "view", F.col("event_id"))
    f = event_lines(spark, sf).groupBy("user_id").agg(
        F.max("ts_ms").alias("last_activity"), (F.count(F.lit(1)) > 2).alias("in_scope"), F.max_by("event_type", significant).alias("t")
    )
    f = f.withColumns(
        {
            "open_turn": F.col("t").isin("signup", "click"),
            "terminal": F.when(F.col("t") == "error", "error").when(F.col("t") == "purchase", "interrupted"),
        }
    )
    return infer_state(f, "chain_store", NOW, live_ms=DAY_MS // 2, idle_ms=DAY_MS).select("user_id", "state")


@query(
    f"""WITH b AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'RUN_STATUS_RUNNING' WHEN '2-HIGH' THEN 'run_busy' WHEN '3-MEDIUM' THEN 'STATUS_IDLE'
        WHEN '5-LOW' THEN 'Paused' ELSE '' END AS status, o_orderstatus = 'P' AS killed, o_totalprice > 200000 AS busy,
        greatest(0, epoch_ms(TIMESTAMP '1998-08-01') - epoch_ms(o_orderdate)) AS age FROM orders),
    c AS (SELECT *, regexp_matches(upper(status), '(^|_)(RUNNING|ACTIVE|BUSY)(_|$)') AS run, age <= {200 * DAY_MS} AS fresh, age <= {800 * DAY_MS} AS recent,
        status = '' OR regexp_matches(upper(status), '(^|_)(RUNNING|ACTIVE|BUSY|IDLE)(_|$)') AS known FROM b)
    SELECT o_orderkey, CASE WHEN killed THEN 'stopped' WHEN run THEN (CASE WHEN recent THEN 'running' ELSE 'stalled' END) WHEN busy AND recent THEN 'running'
        WHEN fresh THEN 'idle' ELSE 'done' END AS state,
      nullif(CASE WHEN killed THEN (CASE WHEN NOT known THEN lower(status) END) WHEN run THEN (CASE WHEN recent THEN 'busy' END) WHEN busy AND recent THEN 'busy'
        WHEN NOT known THEN lower(status) WHEN fresh THEN 'idle' END, '') AS status_label FROM c"""
)
def state_summary(spark, sf):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "RUN_STATUS_RUNNING").when(p == "2-HIGH", "run_busy").when(p == "3-MEDIUM", "STATUS_IDLE").when(p == "5-LOW", "Paused").otherwise("")
    f = table(spark, sf, "orders").select(
        "o_orderkey",
        status.alias("status"),
        (F.col("o_orderstatus") == "P").alias("killed"),
        (F.col("o_totalprice") > 200000).alias("not_fully_idle"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last_modified"),
    )
    now = 901_929_600_000  # 1998-08-01
    return infer_state(f, "summary_table", now, live_ms=200 * DAY_MS, fresh_ms=800 * DAY_MS).select("o_orderkey", "state", "status_label")


# ---------------------------------------------------------------------------------------------- facts, sessions, machine
@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts,
      CASE arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'click', 'signup')) WHEN 'signup' THEN 'user' ELSE 'assistant' END AS last_role,
      CASE WHEN arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'click', 'signup')) = 'signup' THEN NULL
        ELSE 's' || CAST(arg_max(k, event_id) FILTER (WHERE event_type IN ('view', 'click', 'signup')) AS VARCHAR) END AS last_stop,
      'm' || CAST(arg_max(k, event_id) FILTER (WHERE event_type = 'view') AS VARCHAR) AS model,
      CAST(coalesce(sum(k % 3) FILTER (WHERE event_type IN ('view', 'click')), 0) AS BIGINT) AS tool_calls,
      't' || CAST(arg_max(k, event_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS last_tool FROM ev GROUP BY 1"""
)
def agent_facts(spark, sf):
    t = F.col("event_type")
    k = F.col("k").cast("string")
    lines = event_lines(spark, sf).select(
        "user_id", F.col("event_id").alias("ord"), "ts_ms", t.alias("type"),
        F.when(t.isin("view", "click"), "assistant").when(t == "signup", "user").alias("role"),
        F.concat(F.lit("s"), k).alias("stop_reason"), F.when(t == "view", F.concat(F.lit("m"), k)).alias("model"),
        (F.col("k") % 3).alias("tool_calls"), F.when(t == "click", F.concat(F.lit("t"), k)).alias("last_tool"),
    )
    return S.agent_facts(lines, ["user_id"]).drop("last_action")


@query(
    f"""WITH {EVENTS_SQL} SELECT CAST(user_id AS VARCHAR) AS session_id, 'k' || CAST(arg_min(k, event_id) FILTER (WHERE event_type = 'view') AS VARCHAR) AS cwd,
      'b' || CAST(arg_max(k, event_id) FILTER (WHERE event_type = 'click') AS VARCHAR) AS branch FROM ev GROUP BY 1"""
)
def first_last_fields(spark, sf):
    t, k = F.col("event_type"), F.col("k").cast("string")
    lines = event_lines(spark, sf).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("ord"),
        F.when(t == "view", F.concat(F.lit("k"), k)).otherwise("").alias("cwd"), F.when(t == "click", F.concat(F.lit("b"), k)).alias("branch"),
    )
    return S.session_fields(lines, ["cwd"], ["branch"])


def _layout(c):
    return F.when(c % 4 == 0, "line_log").when(c % 4 == 1, "rollout").when(c % 4 == 2, "part_store").otherwise("document")


_LAYOUT = "CASE {0} % 4 WHEN 0 THEN 'line_log' WHEN 1 THEN 'rollout' WHEN 2 THEN 'part_store' ELSE 'document' END"


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Agents with a state from their last event: view done, click running, error failed, purchase stopped, signup idle."""
    a = _agent_rows(spark, sf)
    state = (
        F.when(F.col("last_type") == "view", "done").when(F.col("last_type") == "click", "running").when(F.col("last_type") == "error", "failed")
        .when(F.col("last_type") == "purchase", "stopped").otherwise("idle")
    )
    mains = a.groupBy("session_id").agg(F.min("agent_key").alias("main_key"))
    a = a.join(mains, "session_id")
    main = F.col("main_key") == F.col("agent_key")
    return a.withColumns(
        {
            "layout": _layout(F.col("session_id")), "state": state, "is_main": main, "last_activity_at": F.col("last_ts"),
            "ended_at": F.when(state != "running", F.col("last_ts")), "model": F.lit("m"), "input": F.col("units"), "total_tokens": F.col("units"),
            "cost_usd": F.col("units") / 100, "cost_partial": F.col("n") > 1,
        }
    ).drop("main_key")


_NODES = f"""{_AGENTS}, node AS (SELECT *, {_LAYOUT.format('session_id')} AS layout, min(agent_key) OVER (PARTITION BY session_id) = agent_key AS is_main,
      CASE last_type WHEN 'view' THEN 'done' WHEN 'click' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'stopped' ELSE 'idle' END AS state FROM a),
    sess AS (SELECT layout, session_id, CAST(sum(units) AS BIGINT) AS total_tokens, bool_or(n > 1) AS cost_partial,
      count(*) FILTER (WHERE NOT is_main) AS agent_count, count(*) FILTER (WHERE NOT is_main AND state = 'running') AS running_agents,
      min(started_at) AS first_activity_at, max(last_ts) AS last_activity_at, max(state) FILTER (WHERE is_main) AS root_state FROM node GROUP BY 1, 2),
    live AS (SELECT *, root_state IN ('running', 'idle') OR running_agents > 0 AS live FROM sess)"""


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT layout, session_id, total_tokens, CAST(total_tokens AS DOUBLE) * 10000 / 1e6 AS cost_usd, cost_partial, agent_count, running_agents,
      first_activity_at, last_activity_at, live, CASE WHEN live THEN (CASE WHEN root_state = 'running' THEN 'busy' ELSE 'idle' END) END AS status FROM live"""
)
def session_summary(spark, sf):
    n = _nodes(spark, sf)
    out = S.session_summary(n, n.select("session_id").distinct())
    cols = "layout session_id total_tokens cost_usd cost_partial agent_count running_agents first_activity_at last_activity_at live status"
    return out.select(*cols.split())


def _sessions(n: DataFrame) -> DataFrame:
    fields = n.select("session_id").distinct().withColumns({"cwd": F.lit("/w"), "session_name": F.concat(F.lit("s"), F.col("session_id").cast("string"))})
    return S.session_summary(n, fields)


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, live, last_activity_at,
      CAST(row_number() OVER (ORDER BY live DESC, last_activity_at DESC, session_id) AS INTEGER) AS place FROM live ORDER BY place"""
)
def sessions_order(spark, sf):
    # the display order itself is the result; the place makes it comparable
    s = _sessions(_nodes(spark, sf)).select("session_id", "live", "last_activity_at")
    return S.with_place(s, S.session_order())


def _model_usage(spark: SparkSession, sf: str) -> DataFrame:
    from tracelake.functions.text import local_day

    e = event_lines(spark, sf)
    model = F.when(F.col("event_type") == "view", "claude-opus-5").when(F.col("event_type") == "click", "openai/gpt-5").when(F.col("event_type") == "purchase", "gpt-5.5").otherwise("mystery")
    return e.select(_layout(F.col("user_id")).alias("layout"), model.alias("model"), local_day("ts_ms").alias("day"), F.col("k").alias("input"), F.col("units").alias("output"))


# fixed values: dollars per million input and output tokens of three models, as in operators/pricing.py
_SPENT = f"""spent AS (SELECT {_LAYOUT.format('user_id')} AS layout, event_type, sum(k) AS i, sum(units) AS o FROM ev WHERE ts_ms >= {{since}} GROUP BY 1, 2),
    money AS (SELECT layout, CAST(sum(o) AS BIGINT) AS output_today, sum(CASE
        WHEN event_type = 'view' AND layout = 'line_log' THEN i * 5 + o * 25
        WHEN event_type = 'purchase' AND layout = 'rollout' THEN i * 5 + o * 30
        WHEN event_type = 'click' AND layout = 'rollout' THEN i * 1.25 + o * 10 ELSE 0 END) AS micro FROM spent GROUP BY 1)"""


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, {_SPENT.format(since=NOW - DAY_MS)},
    ag AS (SELECT layout, count(*) FILTER (WHERE state = 'running') AS running_agents, count(*) FILTER (WHERE NOT is_main AND last_ts >= {NOW - DAY_MS}
        AND CASE layout WHEN 'rollout' THEN state IN ('done', 'stopped') WHEN 'document' THEN false ELSE state IN ('done', 'failed', 'stopped') END) AS finished_today FROM node GROUP BY 1),
    lv AS (SELECT layout, count(*) AS live_sessions FROM live WHERE live GROUP BY 1)
    SELECT layout, CAST(coalesce(sum(live_sessions), 0) AS BIGINT) AS live_sessions, CAST(sum(running_agents) AS BIGINT) AS running_agents, CAST(sum(finished_today) AS BIGINT) AS finished_today,
      CAST(coalesce(sum(output_today), 0) AS BIGINT) AS output_today, CAST(coalesce(sum(micro), 0) AS DOUBLE) / 1e6 AS cost_today
    FROM ag LEFT JOIN lv USING (layout) LEFT JOIN money USING (layout) GROUP BY ROLLUP (layout)"""
)
def machine_rollup(spark, sf):
    return S.machine_summary(_nodes(spark, sf), _model_usage(spark, sf), price_table(spark), NOW - 1)


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, h AS (SELECT layout, count(*) AS sessions, count(*) FILTER (WHERE live) AS active, max(last_activity_at) AS last_activity_at FROM live GROUP BY 1)
    SELECT layout, sessions, active, last_activity_at,
      CASE layout WHEN 'line_log' THEN 'claude-opus-5' WHEN 'rollout' THEN 'gpt-5.5' ELSE '' END AS verified,
      CASE layout WHEN 'rollout' THEN 'gpt-5 / gpt-5-codex' ELSE '' END AS estimated,
      CASE layout WHEN 'line_log' THEN 'gpt-5.5,mystery,openai/gpt-5' WHEN 'rollout' THEN 'claude-opus-5,mystery' ELSE 'claude-opus-5,gpt-5.5,mystery,openai/gpt-5' END AS unpriced,
      CASE layout WHEN 'line_log' THEN 'official prices' WHEN 'rollout' THEN 'official prices · estimated: gpt-5 / gpt-5-codex' ELSE 'price table' END AS pricing_note,
      layout <> 'document' AS subagents FROM h"""
)
def provider_status(spark, sf):
    out = S.provider_status(_sessions(_nodes(spark, sf)), _model_usage(spark, sf), price_table(spark), shown=4)
    joined = [F.array_join(c, ",").alias(c) for c in ("verified", "estimated", "unpriced")]
    return out.select("layout", "sessions", "active", "last_activity_at", *joined, "pricing_note", F.col("capabilities.subagents").alias("subagents"))


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, r AS (SELECT node.* FROM node JOIN live USING (session_id) WHERE live AND CASE WHEN is_main THEN state = 'running' ELSE state IN ('running', 'stalled') END)
    SELECT (SELECT count(*) FROM r) AS running_agents, (SELECT count(DISTINCT session_id) FROM r) AS running_sessions,
      count(*) FILTER (WHERE NOT is_main AND state IN ('done', 'stopped') AND last_ts >= {NOW - DAY_MS}) AS done_today,
      count(*) FILTER (WHERE NOT is_main AND state = 'failed' AND last_ts >= {NOW - DAY_MS}) AS failed_today, max(last_ts) AS last_activity_at FROM node"""
)
def now_snapshot(spark, sf):
    n = _nodes(spark, sf)
    return S.now_snapshot(n, _sessions(n), NOW - 1)


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, agent_key, state, last_ts AS ended_at FROM node WHERE NOT is_main AND state IN ('done', 'stopped', 'failed') AND last_ts >= {NOW - DAY_MS}
    ORDER BY last_ts DESC, session_id, agent_key LIMIT 200"""
)
def finished_topk(spark, sf):
    n = _nodes(spark, sf)
    return S.finished_today(n, _sessions(n), NOW - 1, limit=200).select("session_id", "agent_key", "state", "ended_at")


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, agent_key, state, CAST(row_number() OVER (PARTITION BY session_id ORDER BY is_main DESC, started_at, agent_key) AS INTEGER) AS place
    FROM node JOIN live USING (session_id) WHERE live AND state = 'running'"""
)
def running_now(spark, sf):
    n = _nodes(spark, sf)
    return S.running_now(n, _sessions(n)).select("session_id", "agent_key", "state", "place")


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, """
    + ", ".join(f'count(*) FILTER (WHERE event_type = \'{k}\') AS "{k}"' for k in ("view", "click", "purchase", "error", "signup"))
    + " FROM ev GROUP BY 1"
)
def kind_pivot(spark, sf):
    return E.kind_counts(event_lines(spark, sf), ["view", "click", "purchase", "error", "signup"], ["user_id"], "event_type")


# ---------------------------------------------------------------------------------------------- activity
@query(
    f"""WITH {EVENTS_SQL}, u AS (SELECT DISTINCT user_id FROM ev), s AS (SELECT unnest(range({NOW // 60000} - 1439, {NOW // 60000} + 1)) AS m),
    c AS (SELECT user_id, ts_ms // 60000 AS m, count(*) AS n FROM ev GROUP BY 1, 2)
    SELECT u.user_id, {NOW // 60000 * 60000} AS "end", string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY s.m) AS counts
    FROM u CROSS JOIN s LEFT JOIN c ON c.user_id = u.user_id AND c.m = s.m GROUP BY 1"""
)
def activity_dense(spark, sf):
    out = A.activity_buckets(event_lines(spark, sf), ["user_id"], "ts_ms", NOW, 1440)
    return out.select("user_id", "end", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(
    f"""WITH {EVENTS_SQL}, t AS (SELECT user_id, min(ts_ms) OVER (PARTITION BY user_id) AS s, ts_ms, event_type FROM ev),
    d AS (SELECT DISTINCT user_id, greatest(0, CAST(floor((ts_ms - s) / 1000.0 + 0.5) AS BIGINT)) AS sec FROM t WHERE event_type = 'click'),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sec) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d),
    keep AS (SELECT p.user_id, p.sec FROM p WHERE n <= 8 OR EXISTS (SELECT 1 FROM range(8) r(j) WHERE CAST(floor(r.j * (p.n / 8.0::DOUBLE)) AS BIGINT) = p.i))
    SELECT user_id, string_agg(CAST(sec AS VARCHAR), ',' ORDER BY sec) AS ticks FROM keep GROUP BY 1"""
)
def tick_offsets(spark, sf):
    e = event_lines(spark, sf)
    starts = e.groupBy("user_id").agg(F.min("ts_ms").alias("started_at"))
    ticks = e.where(F.col("event_type") == "click").join(starts, "user_id")
    out = A.tick_offsets(ticks, ["user_id"], max_ticks=8)
    return out.select("user_id", F.array_join(F.col("ticks").cast("array<string>"), ",").alias("ticks"))


@query(
    f"""WITH i AS (SELECT o_orderkey, epoch_ms(min(o_orderdate)) AS s, epoch_ms(max(l_shipdate)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    b AS (SELECT s // {DAY_MS} AS b0, greatest(s, e - 1) // {DAY_MS} AS b1 FROM i),
    span AS (SELECT unnest(range((SELECT min(b0) FROM b), (SELECT max(b1) FROM b) + 1)) AS b),
    d AS (SELECT b, sum(d) AS d FROM (SELECT b0 AS b, 1 AS d FROM b UNION ALL SELECT b1 + 1, -1 FROM b) GROUP BY 1)
    SELECT span.b * {DAY_MS} AS bucket_start, CAST(sum(coalesce(d.d, 0)) OVER (ORDER BY span.b) AS BIGINT) AS alive FROM span LEFT JOIN d ON d.b = span.b"""
)
def concurrency(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    spans = o.join(li, o.o_orderkey == li.l_orderkey).select(ms("o_orderdate").alias("started_at"), ms("l_shipdate").alias("ended_at"))
    return A.concurrency(spans, bucket_ms=DAY_MS)


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, min(started_at) AS t0,
      CASE WHEN bool_or(state IN ('running', 'idle', 'stalled')) THEN greatest(max(last_ts), {NOW}) ELSE max(last_ts) END AS t1,
      bool_or(state IN ('running', 'idle', 'stalled')) AS live FROM node GROUP BY 1"""
)
def time_extent(spark, sf):
    return A.time_extent(_nodes(spark, sf).withColumn("live", F.lit(False)), ["session_id"], NOW)


# ---------------------------------------------------------------------------------------------- changes and churn
@query(
    f"""WITH {EVENTS_SQL}, h AS (SELECT user_id, md5(concat_ws('|', CAST(k AS VARCHAR), event_type, CAST(units AS VARCHAR))) AS h FROM ev),
    s AS (SELECT user_id, count(*) AS n, sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b FROM h GROUP BY 1)
    SELECT user_id, substr(sha1(concat_ws(':', CAST(n AS VARCHAR), CAST(a AS VARCHAR), CAST(b AS VARCHAR))), 1, 16) AS facts_hash FROM s"""
)
def facts_hash(spark, sf):
    return C.facts_hash(event_lines(spark, sf), ["user_id"], ["k", "event_type", "units"])


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, k, arg_max(event_type, event_id) AS t FROM ev WHERE ts_ms < {NOW - 10 * DAY_MS} GROUP BY 1, 2),
    c AS (SELECT user_id, k, arg_max(event_type, event_id) AS t FROM ev WHERE ts_ms >= {NOW - 20 * DAY_MS} GROUP BY 1, 2)
    SELECT coalesce(p.user_id, c.user_id) AS user_id, coalesce(p.k, c.k) AS k, CASE WHEN p.t IS NULL THEN 'added' WHEN c.t IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM p FULL JOIN c ON p.user_id = c.user_id AND p.k = c.k WHERE p.t IS DISTINCT FROM c.t"""
)
def changed_sessions(spark, sf):
    e = event_lines(spark, sf)
    snap = lambda rows: rows.groupBy("user_id", "k").agg(F.max_by("event_type", "event_id").alias("t"))
    prev, cur = snap(e.where(F.col("ts_ms") < NOW - 10 * DAY_MS)), snap(e.where(F.col("ts_ms") >= NOW - 20 * DAY_MS))
    return C.changed_rows(prev, cur, ["user_id", "k"], ["t"])


def _patches(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a patch: its lines alternate between added, removed and context lines of two files."""
    lines = F.split("text", "\n")
    mark = F.transform(lines, lambda x, i: F.concat(F.when(i % 3 == 0, "+").when(i % 3 == 1, "-").otherwise(" "), x))
    body = F.array_join(mark, "\n")
    patch = F.concat(
        F.lit("*** Begin Patch\n+not counted\n*** Update File: src/"), "source", F.lit(".py\n@@\n"), body,
        F.lit("\n*** Add File: doc/"), "lang", F.lit(".md\n+one\n+two\n*** End Patch"),
    )
    return table(spark, sf, "documents").select("doc_id", "source", "lang", patch.alias("patch"))


@query(
    """WITH l AS (SELECT source, lang, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    c AS (SELECT source, 'src/' || source || '.py' AS path, count(*) FILTER (WHERE i = 0) AS edits, count(*) FILTER (WHERE i % 3 = 0) AS added, count(*) FILTER (WHERE i % 3 = 1) AS removed FROM l GROUP BY 1, 2
      UNION ALL SELECT source, 'doc/' || lang || '.md', count(*), 2 * count(*), 0 FROM documents GROUP BY 1, 2)
    SELECT source, path, CAST(edits AS BIGINT) AS edits, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM c"""
)
def patch_churn(spark, sf):
    return H.edit_churn(_patches(spark, sf), ["source"])


@query(
    """WITH l AS (SELECT doc_id, lang, generate_subscripts(string_split(coalesce(nullif(text, ''), 'x'), chr(10)), 1) - 1 AS i FROM documents),
    c AS (SELECT lang, count(DISTINCT doc_id) AS edits, count(*) FILTER (WHERE i % 3 = 1) AS gone, count(*) FILTER (WHERE i % 3 <> 1 AND i % 5 = 4) AS changed,
      count(*) FILTER (WHERE i % 4 = 0) AS inserted FROM l GROUP BY 1)
    SELECT lang, CAST(edits AS BIGINT) AS edits, CAST(inserted + changed AS BIGINT) AS added, CAST(gone + changed AS BIGINT) AS removed FROM c"""
)
def line_delta(spark, sf):
    # lines are dropped, changed and inserted; the changed and inserted ones are in no old text, so the others are the common ones
    old = F.coalesce(F.nullif("text", F.lit("")), F.lit("x"))
    mark = lambda sign, i: F.concat(F.lit(f"{sign}\u0001"), i.cast("string"))

    def edit(x, i):
        kept = F.when(i % 3 == 1, F.array().cast("array<string>")).when(i % 5 == 4, F.array(mark("~", i))).otherwise(F.array(x))
        return F.when(i % 4 == 0, F.concat(kept, F.array(mark("+", i)))).otherwise(kept)

    new = F.array_join(F.flatten(F.transform(F.split(old, "\n"), edit)), "\n")
    d = table(spark, sf, "documents").select("lang", old.alias("old_string"), new.alias("new_string"))
    return H.edit_line_delta(d, ["lang"])


# ---------------------------------------------------------------------------------------------- pages and search
def _page_events(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of two events each: the line number is half the event id."""
    e = event_lines(spark, sf)
    return e.select("user_id", F.expr("event_id div 300").alias("ord"), "event_id", "k")


_PAGE = "pe AS (SELECT user_id, event_id // 300 AS ord, event_id FROM events)"
_TAIL = """r AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ord DESC) AS rk, min(ord) OVER (PARTITION BY user_id) AS fo FROM pe WHERE {where})
    SELECT user_id, event_id, ord, min(ord) OVER (PARTITION BY user_id) AS page_start, min(ord) OVER (PARTITION BY user_id) > fo AS truncated FROM r WHERE rk <= {n}"""


@query(f"WITH {_PAGE}, {_TAIL.format(where='true', n=10)}")
def page_tail(spark, sf):
    return E.event_page(_page_events(spark, sf), ["user_id"], tail=10).select("user_id", "event_id", "ord", "page_start", "truncated")


@query(f"WITH {_PAGE}, {_TAIL.format(where='ord < 20', n=5)}")
def page_before(spark, sf):
    return E.event_page(_page_events(spark, sf), ["user_id"], tail=5, before=20).select("user_id", "event_id", "ord", "page_start", "truncated")


@query(
    f"""WITH {_PAGE} SELECT user_id, event_id, ord, CAST(25 AS BIGINT) AS page_start, false AS truncated FROM pe WHERE ord >= 25"""
)
def page_after(spark, sf):
    return E.event_page(_page_events(spark, sf), ["user_id"], after=25).select("user_id", "event_id", "ord", "page_start", "truncated")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, ts_ms // 3600000 AS created_ms, event_id AS part_id, unnest(range(CASE WHEN event_type = 'click' THEN 2 ELSE 1 END)) AS i FROM ev),
    z AS (SELECT user_id, created_ms, part_id, count(*) AS n FROM p GROUP BY 1, 2, 3),
    w AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY created_ms DESC, part_id DESC) AS s FROM z),
    st AS (SELECT user_id, min(created_ms) AS page_start FROM w WHERE s <= 12 GROUP BY 1)
    SELECT user_id, part_id, CAST(i AS BIGINT) AS i, page_start, page_start > min(created_ms) OVER (PARTITION BY user_id) AS truncated FROM p JOIN st USING (user_id)
    QUALIFY created_ms >= page_start"""
)
def page_group(spark, sf):
    e = event_lines(spark, sf)
    n = F.when(F.col("event_type") == "click", 2).otherwise(1)
    p = e.select(
        "user_id", F.floor(F.col("ts_ms") / 3_600_000).alias("created_ms"), F.col("event_id").alias("part_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).alias("i")
    )
    return E.part_page(p, ["user_id"], tail=12).select("user_id", "part_id", "i", "page_start", "truncated")


@query(
    """WITH s AS (SELECT p_partkey, lower(p_name || ' ' || p_brand) AS h FROM part),
    x AS (SELECT *, strpos(h, 'ri') AS a, strpos(h, '#1') AS b FROM s)
    SELECT p_partkey, CAST((CASE WHEN a = 1 THEN 3 WHEN substr(h, a - 1, 1) = ' ' THEN 2 ELSE 1 END) + (CASE WHEN b = 1 THEN 3 WHEN substr(h, b - 1, 1) = ' ' THEN 2 ELSE 1 END) AS INTEGER) AS score
    FROM x WHERE a > 0 AND b > 0 ORDER BY score DESC, p_partkey LIMIT 60"""
)
def search_score(spark, sf):
    p = table(spark, sf, "part")
    out = E.search(p, F.concat_ws(" ", "p_name", "p_brand"), "ri #1", 60, [F.col("p_partkey")])
    return out.select("p_partkey", "score")


