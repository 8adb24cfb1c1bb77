"""Node tables and tool calls of the layouts over rows built from the driver tables: chains, part store sessions, rollout threads, calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.plans import chain_store, part_store, rollout, tool_calls
from tracelake.plans.binding import DAY_MS, table
from tracelake.sources import tables

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def register(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------------------------------------- chain store
def _entry(k, size) -> F.Column:
    """The entry of a part: what it is follows from the last digit of its key."""
    t, name = k % 10, k.cast("string")
    text = lambda kind, word: F.struct(F.lit(kind).alias("type"), F.concat(F.lit(f"{word} "), name).alias("text"))
    call = lambda p: F.struct(F.lit("toolCallRequest").alias("type"), F.lit("Read").alias("name"), F.concat(F.lit(p), name).alias("uniqueToolCallId"))
    result = F.struct(F.lit("toolCallResult").alias("type"), F.concat(F.lit("c"), F.expr("p_partkey div 3").cast("string")).alias("uniqueToolCallId"))
    said = (
        F.when(t == 0, F.to_json(F.array(text("text", "ask"), text("reasoning", "more")))).when(t == 1, F.to_json(F.array(call("a"), call("c"))))
        .when(t == 2, F.to_json(F.array(text("text", "say")))).otherwise(F.to_json(F.array(result)))
    )
    role = F.when(t == 0, "user").when(t == 3, "tool").otherwise("assistant")
    message = F.concat(F.lit(',"message":{"role":"'), role, F.lit('","parts":'), said, F.lit("}"))
    names = F.array(*[F.lit(x) for x in ("message",) * 4 + ("turnSummary", "error", "interrupted", "subSessionReference", "elicitationRequest", "elicitationResponse")])
    head = F.to_json(
        F.struct(
            name.alias("id"), F.get(names, t.cast("int")).alias("type"), (k * 1000).alias("createdTimestamp"), (k % 20 == 0).alias("hidden"),
            F.when(t == 7, F.concat(F.lit("S"), name)).alias("sessionId"), F.when((t == 5) & (k % 3 > 0), F.concat(F.lit("E"), name)).alias("errorCode"),
            F.when(k % 3 == 0, F.struct(size.alias("total"))).alias("context"),
        )
    )
    return F.concat(F.left(head, F.length(head) - 1), F.when(t < 4, message).otherwise(""), F.lit("}"))


@query(
    """WITH RECURSIVE w AS (SELECT p_partkey AS s, p_partkey AS k, 0 AS hop FROM part WHERE p_size >= 25 UNION ALL SELECT s, k // 3, hop + 1 FROM w WHERE k > 0),
    e AS (SELECT s, k, hop, k % 10 AS t, p_size FROM w JOIN part ON p_partkey = k),
    done AS (SELECT DISTINCT s, 'c' || CAST(k // 3 AS VARCHAR) AS id FROM e WHERE t = 3),
    a AS (SELECT s, count(*) FILTER (WHERE t < 3) AS messages, CAST(2 * count(*) FILTER (WHERE t = 1) AS BIGINT) AS tool_calls, count(*) FILTER (WHERE t = 4) AS turns, count(*) FILTER (WHERE t = 7) AS sub_refs,
      min(1000 * k) FILTER (WHERE t < 4) AS first_ts, max(1000 * k) FILTER (WHERE t < 4) AS last_ts,
      max_by('ask ' || CAST(k AS VARCHAR) || chr(10) || 'more ' || CAST(k AS VARCHAR), hop) FILTER (WHERE t = 0 AND k % 20 <> 0) AS first_user,
      min_by('ask ' || CAST(k AS VARCHAR) || chr(10) || 'more ' || CAST(k AS VARCHAR), hop) FILTER (WHERE t = 0 AND k % 20 <> 0) AS last_prompt,
      CAST(min_by(p_size, hop) FILTER (WHERE t < 4 AND k % 3 = 0) AS DOUBLE) AS ctx_total, min_by('c' || CAST(k AS VARCHAR), hop) FILTER (WHERE t = 1) AS last_call,
      min_by(t, hop) FILTER (WHERE t <> 7) AS sig, min_by(k, hop) FILTER (WHERE t <> 7) AS sig_k FROM e GROUP BY s)
    SELECT 'part-' || CAST(a.s AS VARCHAR) AS session_id, messages, tool_calls, turns, sub_refs, first_ts, last_ts, first_user, last_prompt, ctx_total, last_call, coalesce(sig IN (0, 1, 3, 9), false) AS open_turn,
      CASE sig WHEN 5 THEN 'error' WHEN 6 THEN 'interrupted' END AS terminal, CASE WHEN sig = 5 AND sig_k % 3 > 0 THEN 'E' || CAST(sig_k AS VARCHAR) END AS error_code,
      last_call IS NOT NULL AND done.id IS NULL AS last_call_pending,
      p_brand AS model, CASE WHEN a.s % 4 > 0 THEN '/w/' || CAST(p_size AS VARCHAR) END AS cwd, CASE WHEN a.s % 2 = 0 THEN 'high' END AS reasoning
    FROM a JOIN part ON p_partkey = a.s LEFT JOIN done ON done.s = a.s AND done.id = last_call"""
)
def chain_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions whose chains share entries: counts, times, prompts, the open turn, how it ended, the last call, the configuration."""
    k, p = F.col("p_partkey"), table(spark, sf, "part")
    entries = p.select(F.lit("p").alias("project_id"), k.cast("string").alias("id"), F.when(k > 0, F.expr("p_partkey div 3").cast("string")).alias("previous_id"), _entry(k, F.col("p_size")).alias("entry_json"))
    config = F.to_json(
        F.struct(
            F.struct(F.col("p_brand").alias("model")).alias("modelSpecifier"),
            F.struct(F.when(k % 4 > 0, F.concat(F.lit("/w/"), F.col("p_size").cast("string"))).otherwise("").alias("working_directory")).alias("sessionParams"),
            F.struct(F.when(k % 2 == 0, "high").alias("reasoningLevel")).alias("inferenceConfig"),
        )
    )
    sessions = p.where("p_size >= 25").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("PART-"), k.cast("string")).alias("session_id"), k.cast("string").alias("committed_head_entry_id"), chain_store.session_config(config).alias("cfg")
    )
    an = chain_store.analysis(chain_store.chains(sessions, entries)).withColumn("last_call", F.col("last_call.uniqueToolCallId"))
    cfg = sessions.select(F.lower("session_id").alias("session_id"), *[F.col(f"cfg.{c}").alias(c) for c in ("model", "cwd", "reasoning")])
    return an.join(cfg, "session_id")


# ---------------------------------------------------------------------------------------------- part store
#: "now" of the node query: the day after the last order.
_AT = 996_710_400_000  # 2001-08-02T00:00:00Z
_STEP = 240_000


def _part_store(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers are sessions under the one of a third of their key, orders are messages, lines are parts."""
    name = lambda c: F.concat(F.lit("ses_"), F.lpad(c.cast("string"), 8, "0"))
    k, o, ln = F.col("c_custkey"), F.col("o_orderkey"), F.col("l_linenumber")
    nation = F.col("c_nationkey").cast("string")
    stored = F.when(k % 2 == 0, F.struct(nation.alias("id"), F.lit(None).cast("string").alias("modelID"))).otherwise(F.struct(F.lit(None).cast("string").alias("id"), nation.alias("modelID")))
    sessions = table(spark, sf, "customer").select(
        name(k).alias("id"), F.when(k % 11 > 0, name(F.expr("c_custkey div 3"))).otherwise("").alias("parent_id"),
        F.when(k % 3 == 0, "  ").when(k % 3 == 1, F.concat(F.lit(" "), F.col("c_name"), F.lit(" "))).alias("title"), F.when(k % 2 == 0, "plan").alias("agent"), F.to_json(stored).alias("model"),
        (k + 5000).alias("time_created"), (F.lit(_AT) - k % 5 * _STEP).alias("time_updated"), F.when(k % 4 > 0, F.col("c_acctbal")).alias("cost"), k.alias("tokens_input"),
        F.col("c_nationkey").alias("tokens_output"), F.when(k % 2 == 0, k).alias("tokens_reasoning"), (k * 2).alias("tokens_cache_read"),
    )
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    key = lambda c: F.lpad(c.cast("string"), 10, "0")
    error = F.when(o % 5 == 0, '"error":{"name":"MessageAbortedError"}').when(o % 5 == 1, F.concat(F.lit('"error":{"name":"Boom","data":{"message":"bad '), o.cast("string"), F.lit('"}}'))).when(o % 5 == 2, '"error":{}')
    model = F.concat(F.lit('"modelID":"'), F.when(o % 4 > 0, F.concat(F.lit("m"), (o % 4).cast("string"))).otherwise(""), F.lit('"'))
    data = F.concat_ws(",", F.when(o % 3 == 0, '"role":"user"').otherwise('"role":"assistant"'), model, F.when(o % 2 == 0, '"time":{"completed":1}'), error)
    orders = table(spark, sf, "orders").select(o, name(F.col("o_custkey")).alias("session_id"), at.alias("at"), F.expr("o_custkey * 3 + 1").alias("kid"), F.concat(F.lit("{"), data, F.lit("}")).alias("data"))
    messages = orders.select(key(o).alias("id"), "session_id", F.col("at").alias("time_created"), "data")
    text = F.struct(F.lit("text").alias("type"), F.concat(F.lit("ask "), o.cast("string")).alias("text"), (ln == 5).alias("synthetic"), (ln == 7).alias("ignored"))
    kid = F.when(ln == 6, F.to_json(F.struct(name(F.col("kid")).alias("sessionId"))))
    tool = F.struct(
        F.lit("tool").alias("type"), F.when(ln == 6, "task").otherwise("read").alias("tool"), F.concat_ws("-", o.cast("string"), ln.cast("string")).alias("callID"),
        F.struct(F.lit("completed").alias("status"), kid.alias("metadata")).alias("state"),
    )
    lines = table(spark, sf, "lineitem").join(orders.drop("data"), F.col("l_orderkey") == o)
    when = F.col("at") + o % DAY_MS
    parts = lines.select(
        F.concat_ws("-", key(o), ln.cast("string")).alias("id"), key(o).alias("message_id"), "session_id", when.alias("time_created"), when.alias("time_updated"),
        F.when(ln % 2 == 1, F.to_json(text)).otherwise(F.to_json(tool)).alias("data"),
    )
    return tables.read_part_store(sessions, messages, parts)


@query(
    f"""WITH RECURSIVE c AS (SELECT *, c_custkey AS k, CASE WHEN c_custkey % 11 > 0 THEN c_custkey // 3 END AS up, 'ses_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id FROM customer),
    r AS (SELECT k, k AS root FROM c WHERE up IS NULL UNION ALL SELECT c.k, r.root FROM r JOIN c ON c.up = r.k),
    m AS (SELECT o_custkey AS k, o_orderkey AS o, epoch_ms(o_orderdate) AS asof_ms, epoch_ms(o_orderdate) + o_orderkey % {DAY_MS} AS seen FROM orders),
    said AS (SELECT k, o, CASE o % 5 WHEN 0 THEN 'MessageAbortedError' WHEN 1 THEN 'Boom' WHEN 2 THEN 'Error' END AS err FROM m WHERE o % 3 > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY asof_ms DESC, o DESC) = 1),
    p AS (SELECT m.*, l_linenumber AS ln FROM lineitem JOIN m ON o = l_orderkey),
    tally AS (SELECT k, min(seen) AS first_at, count(*) FILTER (WHERE ln % 2 = 0) AS tool_calls FROM p GROUP BY k),
    asked AS (SELECT DISTINCT k, 'ask ' || CAST(o AS VARCHAR) AS prompt FROM (SELECT * FROM p WHERE ln % 2 = 1 AND ln NOT IN (5, 7) AND o % 3 = 0 QUALIFY rank() OVER (PARTITION BY k ORDER BY seen DESC, o DESC) = 1)),
    calls AS (SELECT k, CAST(o AS VARCHAR) || '-6' AS call FROM (SELECT DISTINCT k, o, seen FROM p WHERE ln = 6) QUALIFY row_number() OVER (PARTITION BY k ORDER BY seen DESC) = 1),
    j AS (SELECT c.*, root, o, err, first_at, tool_calls, prompt, call, k % 5 * {_STEP} AS age, k + c_nationkey + CASE WHEN k % 2 = 0 THEN k ELSE 0 END + 2 * k AS total, CASE WHEN k % 4 > 0 THEN c_acctbal ELSE 0.0 END AS usd
      FROM c JOIN r USING (k) LEFT JOIN said USING (k) LEFT JOIN tally USING (k) LEFT JOIN asked USING (k) LEFT JOIN calls ON calls.k = up AND c.k = 3 * up + 1),
    s AS (SELECT *, CASE WHEN o IS NOT NULL AND o % 2 = 1 AND err IS NULL AND age <= 600000 THEN 'running' WHEN age <= 120000 THEN 'idle' WHEN err = 'MessageAbortedError' THEN 'stopped' WHEN err IS NOT NULL THEN 'failed' ELSE 'done' END AS state FROM j)
    SELECT id AS native_id, 'ses_' || lpad(CAST(root AS VARCHAR), 8, '0') AS session_id, CASE WHEN up = root THEN 'main' ELSE 'ses_' || lpad(CAST(up AS VARCHAR), 8, '0') END AS parent_key, up IS NULL AS is_main,
      CASE WHEN o % 4 > 0 THEN 'm' || CAST(o % 4 AS VARCHAR) ELSE CAST(c_nationkey AS VARCHAR) END AS model, coalesce(first_at, 5000 + k) AS started_at, tool_calls, k AS input, CAST(total - 3 * k AS BIGINT) AS output,
      CAST(total AS BIGINT) AS total_tokens, usd AS cost_usd, total > 0 AND usd = 0 AS cost_partial, state, prompt AS last_prompt,
      coalesce(CASE WHEN k % 3 = 1 THEN c_name END, prompt, id) AS label, CASE WHEN up IS NULL THEN 'main' WHEN k % 2 = 0 THEN 'plan' ELSE 'build' END AS agent_type,
      CASE WHEN state = 'stopped' THEN 'Cancelled' WHEN state = 'failed' THEN CASE WHEN o % 5 = 1 THEN 'bad ' || CAST(o AS VARCHAR) ELSE err END END AS end_reason, call AS tool_use_id FROM s"""
)
def part_store_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a part store as agent trees: usage, recorded cost, state, last prompt, and the call that started each."""
    out = part_store.nodes(*_part_store(spark, sf), _AT)
    return out.select(
        "native_id", "session_id", "parent_key", "is_main", "model", "started_at", "tool_calls", "input", "output", "total_tokens", "cost_usd", "cost_partial", "state", "last_prompt", "label", "agent_type", "end_reason", "tool_use_id"
    )


# ---------------------------------------------------------------------------------------------- rollouts
_THREAD = "00000000-0000-4000-8000-"


@query(
    f"""WITH l AS (SELECT o_custkey % 97 AS n, o_orderkey AS k, o_orderkey % 9 AS t, 1704067200000 + o_orderkey AS ms FROM orders),
    a AS (SELECT n, min(ms) AS first_ts, max(ms) AS last_ts, count(*) FILTER (WHERE t IN (4, 5)) AS tool_calls, count(*) FILTER (WHERE t = 3) AS messages,
      max_by('gpt-' || CAST(k % 5 AS VARCHAR), k) FILTER (WHERE t = 1 AND k % 5 > 0) AS turn_model, max_by('/w/' || CAST(k % 4 AS VARCHAR), k) FILTER (WHERE t = 1) AS turn_cwd,
      max_by(k, k) FILTER (WHERE t = 0 AND k % 4 > 0) AS head, max_by(CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END, k) FILTER (WHERE t = 1 AND k % 3 > 0) AS effort,
      max_by('ask ' || CAST(k AS VARCHAR) || ' ok', k) FILTER (WHERE t = 2 AND k % 7 > 0) AS last_prompt,
      max_by(CASE WHEN t = 4 THEN 'ls ' ELSE 'text ' END || CAST(k AS VARCHAR), k) FILTER (WHERE t IN (4, 5)) AS call, max(k) FILTER (WHERE t IN (4, 5)) AS call_k FROM l GROUP BY n)
    SELECT '{_THREAD}' || lpad(CAST(n AS VARCHAR), 12, '0') AS thread_id, first_ts, last_ts, tool_calls, messages, turn_model, effort, last_prompt,
      coalesce(turn_cwd, CASE WHEN head IS NOT NULL THEN '/head' END) AS cwd, CASE WHEN head IS NOT NULL THEN CASE head % 3 WHEN 0 THEN 'cli' WHEN 1 THEN 'subagent' ELSE 'desktop' END END AS source_kind,
      CASE WHEN head % 3 = 1 THEN '{_THREAD}' || lpad(CAST(n + 1 AS VARCHAR), 12, '0') END AS parent_id, CASE WHEN head % 3 = 1 THEN CAST(head % 6 AS INTEGER) END AS depth,
      CASE WHEN call_k % 9 = 4 THEN call END AS last_command, CASE WHEN call_k % 9 = 4 THEN 'bash' WHEN call_k IS NOT NULL THEN 'edit' END AS last_kind, 'call' || CAST(call_k AS VARCHAR) AS last_call_id FROM a"""
)
def rollout_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of threads: the last head that is their own, the last turn's settings, the last prompt that is no injected context, the last call."""
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 97
    t, name = k % 9, k.cast("string")
    thread = lambda c: F.concat(F.lit(_THREAD), F.lpad(c.cast("string"), 12, "0"))
    none = F.lit(None).cast("string")
    sub = F.to_json(F.struct(F.struct(F.struct(F.upper(thread(n + 1)).alias("parent_thread_id"), (k % 6).alias("depth")).alias("thread_spawn")).alias("subagent")))
    source = F.when(k % 3 == 0, "cli").when(k % 3 == 1, sub).otherwise("vscode")
    block = lambda c: F.struct(F.lit("input_text").alias("type"), c.alias("text"))
    context = block(F.lit("<environment_context> x"))
    asked = F.when(k % 7 > 0, F.to_json(F.array(context, block(F.concat(F.lit("ask "), name)), block(F.lit("ok"))))).otherwise(F.to_json(F.array(context)))
    kinds = F.array(*[F.lit(x) for x in ("session_meta", "turn_context") + ("response_item",) * 4 + ("event_msg", "world_state", "compacted")])
    ptype = F.when(t.isin(2, 3), "message").when(t == 4, "function_call").when(t == 5, "custom_tool_call")
    patch = F.concat(F.lit("*** Begin Patch\n*** Update File: f"), name, F.lit("\n*** End Patch"))
    payload = F.struct(
        ptype.alias("type"), F.when(t == 0, F.when(k % 4 > 0, F.upper(thread(n))).otherwise(thread(n + 500))).alias("id"), F.when(t == 2, "user").when(t == 3, "assistant").alias("role"),
        F.when(t == 4, "shell").when(t == 5, "apply_patch").alias("name"), F.when(t.isin(4, 5), F.concat(F.lit("call"), name)).alias("call_id"),
        F.when(t == 4, F.to_json(F.struct(F.concat(F.lit("ls "), name).alias("command")))).alias("arguments"), F.when(t == 5, patch).alias("input"), F.when(t == 2, asked).alias("content"),
        F.when(t == 1, F.when(k % 5 > 0, F.concat(F.lit("gpt-"), (k % 5).cast("string"))).otherwise("")).alias("model"),
        F.when(t == 0, "/head").when(t == 1, F.concat(F.lit("/w/"), (k % 4).cast("string"))).alias("cwd"),
        F.when((t == 1) & (k % 3 == 1), F.when(k % 2 == 0, "high").otherwise("low")).alias("effort"),
        F.when((t == 1) & (k % 3 == 2), F.when(k % 2 == 0, "high").otherwise("low")).alias("reasoning_effort"), F.when(t == 0, source).otherwise(none).alias("source"),
    )
    at = F.date_format(F.timestamp_millis(F.lit(1_704_067_200_000) + k), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    value = F.to_json(F.struct(at.alias("timestamp"), F.get(kinds, t.cast("int")).alias("type"), payload.alias("payload")))
    raw = table(spark, sf, "orders").select(F.lit("f").alias("file"), thread(n).alias("thread_id"), k.alias("ord"), value.alias("value"))
    f = rollout.thread_facts(rollout.parse_lines(raw))
    call, src = F.col("last_call"), F.col("meta_source")
    return f.select(
        "thread_id", "first_ts", "last_ts", "tool_calls", "messages", "turn_model", "effort", "last_prompt", "cwd", src["kind"].alias("source_kind"), src["parent_id"].alias("parent_id"), src["depth"].alias("depth"),
        F.when(call["kind"] == "bash", call["target"]).alias("last_command"), call["kind"].alias("last_kind"), "last_call_id",
    )


# ---------------------------------------------------------------------------------------------- tool calls
@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 8 AS t, CAST(o_orderkey AS VARCHAR) AS n FROM orders)
    SELECT k, CASE t WHEN 0 THEN 'bash' WHEN 1 THEN 'read' WHEN 2 THEN 'search' WHEN 3 THEN 'mcp' WHEN 4 THEN 'edit' WHEN 5 THEN 'other' WHEN 6 THEN 'agent' ELSE 'write' END AS kind,
      CASE t WHEN 0 THEN 'ls ' || n WHEN 1 THEN '…/c/d/f' || n || '.ts' WHEN 2 THEN 'p' || n || ' · …/b/c' WHEN 3 THEN 'srv · do: x' || n WHEN 4 THEN '/x/f' || n WHEN 5 THEN 'b' || n WHEN 6 THEN 'task ' || n ELSE 'plain ' || n END AS target,
      CASE t WHEN 0 THEN '/w/' || n END AS dir,
      CASE t WHEN 0 THEN 'cd /w/' || n || ' && ls ' || n WHEN 1 THEN '/a/b/c/d/f' || n || '.ts' WHEN 2 THEN 'p' || n WHEN 3 THEN 'x' || n WHEN 4 THEN '/x/f' || n WHEN 5 THEN 'b' || n WHEN 6 THEN 'task ' || n ELSE 'plain ' || n END AS summary,
      CASE t WHEN 0 THEN 'command=cd /w/' || n || ' && ls ' || n || ',description=d ' || n WHEN 1 THEN 'file_path=/a/b/c/d/f' || n || '.ts,offset=' || n WHEN 2 THEN 'path=/a/b/c,pattern=p' || n
        WHEN 4 THEN 'edits=2,file_path=/x/f' || n || ',new_string=n' || n || ',old_string=o' || n WHEN 6 THEN 'description=task ' || n || ',prompt=p ' || n END AS detail FROM o"""
)
def log_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a line log: what each is about, where it ran and the fields worth showing."""
    k = F.col("o_orderkey")
    n, t = k.cast("string"), k % 8
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    obj = lambda **f: F.to_json(F.struct(*[v.alias(c) for c, v in f.items()]))
    edits = F.array(F.struct(text("o", n).alias("old_string"), text("n", n).alias("new_string")), F.struct(F.lit("z").alias("old_string"), F.lit("").alias("new_string")))
    given = [
        obj(command=text("cd /w/", n, " && ls ", n), description=text("d ", n)), obj(file_path=text("/a/b/c/d/f", n, ".ts"), offset=k), obj(pattern=text("p", n), path=F.lit("/a/b/c")),
        obj(q=text("x", n)), obj(file_path=text("/x/f", n), edits=edits), obj(a=F.lit(""), b=text("b", n)), obj(description=text("task ", n), prompt=text("p ", n)), text("plain ", n),
    ]
    tools = F.array(*[F.lit(x) for x in ("Bash", "Read", "Grep", "mcp__srv__do", "MultiEdit", "Frob", "Agent", "Write")])
    rows = table(spark, sf, "orders").select(k.alias("k"), F.get(tools, t.cast("int")).alias("tool"), F.coalesce(*[F.when(t == i, g) for i, g in enumerate(given)]).alias("input"))
    calls = rows.select("k", tool_calls.line_log_call(F.col("tool"), F.col("input")).alias("c"))
    pairs = F.transform(F.array_sort(F.map_entries("c.detail")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return calls.select("k", "c.kind", "c.target", "c.dir", "c.summary", F.array_join(pairs, ",").alias("detail"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 5 AS t, CAST(o_orderkey AS VARCHAR) AS n FROM orders)
    SELECT k, CASE t WHEN 0 THEN 'apply_patch' WHEN 1 THEN 'exec_command' WHEN 2 THEN 'web_search' WHEN 3 THEN 'write_stdin' ELSE 'exec' END AS tool,
      CASE t WHEN 0 THEN 'edit' WHEN 1 THEN 'bash' WHEN 2 THEN 'web' WHEN 3 THEN 'bash' ELSE 'other' END AS kind,
      CASE t WHEN 0 THEN '…/b/c/f' || n || '.ts' WHEN 1 THEN 'ls ' || n || ' (+1 commands)' WHEN 2 THEN 'web_search' WHEN 3 THEN 'sending input to the running command' ELSE 'print ' || n END AS target,
      CASE t WHEN 1 THEN '/w/' || n END AS dir FROM o"""
)
def script_calls(spark: SparkSession, sf: str) -> DataFrame:
    """The first meaningful call inside a tool script, by the shape of the script."""
    k = F.col("o_orderkey")
    scripts = (
        'const p = "*** Begin Patch\\n*** Update File: /a/b/c/f#.ts\\n*** End Patch"; tools.apply_patch(p)',
        "await tools.exec_command({cmd: 'cd /w/# && ls #', workdir: \"/z\"}); await tools.shell({\"command\": `pwd`})",
        'const r = await tools.web_search({query: "q#"});',
        'await tools.write_stdin({chars: "y"})',
        "print #",
    )
    src = F.replace(F.get(F.array(*[F.lit(s) for s in scripts]), (k % 5).cast("int")), F.lit("#"), k.cast("string"))
    calls = table(spark, sf, "orders").select(k.alias("k"), tool_calls.script_call(src).alias("c"))
    return calls.select("k", "c.tool", "c.kind", "c.target", "c.dir")
