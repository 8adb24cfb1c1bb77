"""Text columns, layout events and topics over the driver tables, with their oracle SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tracelake.functions import text as X
from tracelake.functions import topic_text as TT
from tracelake.operators import topics as TP
from tracelake.plans import chain_store, document, line_log, part_store, rollout
from tracelake.plans.binding import DAY_MS, EVENTS_SQL, NOW, event_lines, table
from tracelake.plans.tool_calls import classify_action
from tracelake.session import cut_lineage

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------------------------------------- SQL text helpers
def _re2(pattern: str) -> str:
    """A secret pattern in the oracle's dialect: code points in braces, word boundaries for the two look-arounds, and for
    the look-ahead that refuses a dash a first character that is none."""
    out = re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern)
    out = out.replace("(?<!\\w)", "\\b").replace("(?!\\w)", "\\b")
    if "(?!-)" in out:
        head, last = out.replace("(?!-)", "")[:-2], "+)"
        at = head.rindex("[^")
        assert out.endswith(last)
        out = f"{head[:at]}{head[at:-1]}-]{head[at:]}*)"
    return out


_W = _re2(X.WS_CHARS)
_RULES = [(name, _re2(pattern), re.sub(r"\$(\d)", r"\\\1", by)) for name, pattern, by in X.SECRET_RULES]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def mask_sql(expr: str) -> str:
    for _, pattern, by in _RULES:
        expr = f"regexp_replace({expr}, {_q(pattern)}, {_q(by)}, 'g')"
    return expr


def one_line_sql(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '[{_W}]+', ' ', 'g'))"


def trim_sql(expr: str) -> str:
    return f"regexp_replace({expr}, '^[{_W}]+|[{_W}]+\\z', '', 'g')"


def safe_sql(col: str, limit: int) -> str:
    m = mask_sql(col)
    return (
        f"CASE WHEN length({m}) <= {limit} AND length({col}) <= {limit} THEN {m} "
        f"ELSE substr({m}, 1, {limit}) || chr(10) || '… [truncated ' || CAST(length({col}) - {limit} AS VARCHAR) || ' chars]' END"
    )


# ---------------------------------------------------------------------------------------------- masking and lines
@query(f"SELECT doc_id, {mask_sql('text')} AS masked FROM documents")
def mask_text(spark, sf):
    return X.mask_table(table(spark, sf, "documents").select("doc_id", F.col("text").alias("masked")), ["masked"])


def _report_sql() -> str:
    stages, prev = ["s0 AS (SELECT source, text AS t FROM documents)"], "s0"
    for i, (_, pattern, by) in enumerate(_RULES):
        hits = f"len(regexp_extract_all(t, {_q(pattern)})) AS h{i}"
        keep = "".join(f", h{j}" for j in range(i))
        stages.append(f"s{i + 1} AS (SELECT source, regexp_replace(t, {_q(pattern)}, {_q(by)}, 'g') AS t{keep}, {hits} FROM {prev})")
        prev = f"s{i + 1}"
    rows = " UNION ALL ".join(f"SELECT source, '{name}' AS rule, CAST(sum(h{i}) AS BIGINT) AS hits FROM {prev} GROUP BY 1" for i, (name, _, _) in enumerate(_RULES))
    return f"WITH {', '.join(stages)} SELECT * FROM ({rows}) WHERE hits > 0"


@query(_report_sql())
def mask_report(spark, sf):
    return X.mask_report(table(spark, sf, "documents"), "text", ["source"])


@query(
    f"""WITH o AS (SELECT doc_id, {one_line_sql(mask_sql('text'))} AS one FROM documents)
    SELECT doc_id, CASE WHEN length(one) > 80 THEN rtrim(substr(one, 1, 79)) || '…' ELSE one END AS line FROM o"""
)
def clip_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clip_line("text", 80).alias("line"))


@query(f"SELECT doc_id, {safe_sql('text', 300)} AS body FROM documents")
def safe_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.safe_text("text", 300).alias("body"))


_PATH = "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1)"


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} || '/a/b.html' AS path FROM pages),
    s AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM p)
    SELECT page_id, CASE WHEN len(parts) <= 2 THEN path ELSE '…/' || array_to_string(parts[-2:], '/') END AS short FROM s"""
)
def short_path(spark, sf):
    path = F.concat(F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), F.lit("/a/b.html"))
    return table(spark, sf, "pages").select("page_id", X.short_path(path, 2).alias("short"))


@query(
    f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '/w/' || role || ' x' WHEN 1 THEN 'sub' || CAST(turn AS VARCHAR) END AS dir,
      CASE WHEN turn % 3 < 2 THEN regexp_replace(text, '^[{_W}]+', '') ELSE text END AS rest FROM conversations"""
)
def split_cd(spark, sf):
    c = table(spark, sf, "conversations")
    cmd = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit('cd "/w/'), "role", F.lit(' x" && '), "text"))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit(" cd /a && cd sub"), F.col("turn").cast("string"), F.lit(" ; "), "text"))
        .otherwise(F.col("text"))
    )
    sp = X.split_cd(cmd)
    return c.select("conv_id", "turn", sp["dir"].alias("dir"), sp["rest"].alias("rest"))


@query(
    f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
    SELECT page_id, 'run .' || CASE WHEN path = '/' THEN '' ELSE path END || ' > ~' || path || ' (/etc' || path || ') wt:w1' || CASE WHEN path = '/' THEN '' ELSE path END || ' https://h' || path AS short FROM p"""
)
def shorten_paths(spark, sf):
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    cmd = F.concat(
        F.lit("run /home/me/proj"), path, F.lit(" > /home/me"), path, F.lit(" (/etc"), path, F.lit(") /home/me/.claude/worktrees/w1"), path, F.lit(" https://h"), path
    )
    rows = table(spark, sf, "pages").select("page_id", cmd.alias("cmd"))
    return rows.select("page_id", X.shorten_paths("cmd", F.lit("/home/me"), F.lit("/home/me/proj")).alias("short"))


_TOOLS = ["Bash", "Edit", "mcp__a__b", "Grep", "Unknown", "Task", "Read", "WebFetch"]


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, CASE k % 8 WHEN 0 THEN 'bash' WHEN 1 THEN 'edit' WHEN 2 THEN 'mcp' WHEN 3 THEN 'search' WHEN 4 THEN 'other' WHEN 5 THEN 'agent'
      WHEN 6 THEN 'read' ELSE 'web' END AS kind, CAST(count(*) AS BIGINT) AS calls FROM ev GROUP BY 1, 2"""
)
def classify_actions(spark, sf):
    tool = F.element_at(F.array(*[F.lit(t) for t in _TOOLS]), (F.col("k") % 8 + 1).cast("int"))
    e = event_lines(spark, sf).withColumn("kind", classify_action("line_log", tool))
    return e.groupBy("user_id", "kind").agg(F.count(F.lit(1)).alias("calls"))


# ---------------------------------------------------------------------------------------------- layout events
# The raw rows below are written once before they are parsed, as a log on disk would hold them.
def _conv_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as line logs: each turn holds its text and a call (assistant) or a result (user)."""
    c = table(spark, sf, "conversations")
    uid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    use = F.struct(
        F.lit("tool_use").alias("type"), uid.alias("id"), F.lit("Read").alias("name"), F.struct(F.concat(F.lit("/w/docs/a/"), uid).alias("file_path")).alias("input")
    )
    result = F.struct(F.lit("tool_result").alias("type"), uid.alias("tool_use_id"), F.col("text").alias("content"))
    blocks = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.array(said).alias("a"), use.alias("b")))).otherwise(
        F.to_json(F.struct(F.array(said).alias("a"), result.alias("b")))
    )
    content = F.concat(F.lit("["), F.get_json_object(blocks, "$.a[0]"), F.lit(","), F.get_json_object(blocks, "$.b"), F.lit("]"))
    line = F.concat(
        F.lit('{"type":"'), "role", F.lit('","uuid":"'), uid, F.lit('","timestamp":"2026-01-01T00:00:00Z","message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}")
    )
    sid = F.col("conv_id").cast("string")
    return c.select(sid.alias("file"), sid.alias("session_id"), F.lit("main").alias("agent_key"), F.col("turn").alias("ord"), line.alias("value"))


_UID = "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)"
_BODY = f"b AS (SELECT conv_id, turn, role, text, {trim_sql('text')} AS body FROM conversations)"


@query(
    f"""WITH {_BODY} SELECT {_UID} || ':0' AS event_id, role AS kind, NULL AS action, {mask_sql('body')} AS text FROM b WHERE role IN ('user', 'assistant') AND body <> ''
    UNION ALL SELECT {_UID} || ':1', 'tool_use', 'read', '/w/docs/a/' || {_UID} FROM b WHERE role = 'assistant'
    UNION ALL SELECT {_UID} || ':1', 'tool_result', NULL, {mask_sql('text')} FROM b WHERE role = 'user'"""
)
def line_events(spark, sf):
    ev = line_log.events(line_log.parse_lines(cut_lineage(_conv_lines(spark, sf))))
    return ev.select("event_id", "kind", "action", "text")


@query(
    f"""WITH {_BODY} SELECT CAST(conv_id AS VARCHAR) AS session_id, 'b' || CAST(turn AS VARCHAR) || ':0' AS event_id, role AS kind, {mask_sql('body')} AS text
    FROM b WHERE role IN ('user', 'assistant') AND body <> ''
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'b' || CAST(turn + 100 AS VARCHAR) || ':0', 'tool_use', 'make t' || CAST(turn AS VARCHAR) FROM b WHERE role = 'assistant'"""
)
def rollout_events(spark, sf):
    c = table(spark, sf, "conversations")
    sid = F.col("conv_id").cast("string")
    kind = F.when(F.col("role") == "user", "input_text").otherwise("output_text")
    content = F.array(F.struct(kind.alias("type"), F.col("text").alias("text")))
    said = F.to_json(F.struct(F.lit("message").alias("type"), F.col("role"), content.alias("content")))
    argv = F.concat(F.lit('{"cmd":["bash","-lc","cd /w && make t'), F.col("turn").cast("string"), F.lit('"]}'))
    call = F.to_json(F.struct(F.lit("function_call").alias("type"), F.lit("shell").alias("name"), F.lit("c").alias("call_id"), argv.alias("arguments")))
    wrap = lambda p: F.concat(F.lit('{"timestamp":"2026-01-01T00:00:00Z","type":"response_item","payload":'), p, F.lit("}"))
    base = [sid.alias("file"), sid.alias("thread_id")]
    rows = c.select(*base, F.col("turn").alias("ord"), wrap(said).alias("value")).unionByName(
        c.where(F.col("role") == "assistant").select(*base, (F.col("turn") + 100).alias("ord"), wrap(call).alias("value"))
    )
    ev = rollout.events(cut_lineage(rows))
    text = F.when(F.col("kind") == "tool_use", F.col("target")).otherwise(F.col("text"))
    return ev.select("session_id", "event_id", "kind", text.alias("text"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text, turn % 4 AS s FROM conversations)
    SELECT 'p:' || {_UID} AS event_id, CASE WHEN s = 3 THEN 'tool_use' WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS kind,
      CASE WHEN s = 3 THEN 'docs/' || CAST(turn AS VARCHAR) ELSE {mask_sql('text')} END AS text, false AS is_error FROM c
    UNION ALL SELECT 'r:' || {_UID}, 'tool_result', {mask_sql('text')}, role = 'user' FROM c WHERE s = 3 AND role <> 'system'"""
)
def part_events(spark, sf):
    c = table(spark, sf, "conversations")
    uid = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    mid = F.concat(F.lit("m"), uid)
    status = F.when(F.col("role") == "user", "error").when(F.col("role") == "assistant", "completed").otherwise("running")
    state = F.struct(
        status.alias("status"), F.struct(F.concat(F.lit("docs/"), F.col("turn").cast("string")).alias("filePath")).alias("input"), F.col("text").alias("output")
    )
    tool = F.to_json(F.struct(F.lit("tool").alias("type"), F.lit("read").alias("tool"), uid.alias("callID"), state.alias("state")))
    plain = F.to_json(F.struct(F.lit("text").alias("type"), F.col("text")))
    t = (F.col("conv_id") * 1000 + F.col("turn")).alias("time_created")
    parts = c.select(
        uid.alias("id"), mid.alias("message_id"), F.col("conv_id").cast("string").alias("session_id"), t, t.alias("time_updated"), F.when(F.col("turn") % 4 == 3, tool).otherwise(plain).alias("data")
    )
    msgs = c.select(mid.alias("id"), F.to_json(F.struct("role")).alias("data"))
    return part_store.events((msgs, cut_lineage(parts))).select("event_id", "kind", "text", "is_error")


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, CAST(count(*) AS BIGINT) AS settled FROM ev
    WHERE CASE event_type WHEN 'click' THEN k < 50 OR {NOW} - 10 * 86400000 - ts_ms > 600000 WHEN 'view' THEN k < 30 OR {NOW} - 10 * 86400000 - ts_ms > 600000 ELSE true END GROUP BY 1"""
)
def settled_parts(spark, sf):
    e = event_lines(spark, sf)
    status = F.when(F.col("k") < 50, "completed").otherwise("running")
    tool = F.to_json(F.struct(F.lit("tool").alias("type"), F.struct(status.alias("status")).alias("state")))
    ended = F.struct(F.when(F.col("k") < 30, F.col("ts_ms")).alias("end"))
    said = F.to_json(F.struct(F.lit("text").alias("type"), F.lit("x").alias("text"), ended.alias("time")))
    data = F.when(F.col("event_type") == "click", tool).when(F.col("event_type") == "view", said).otherwise('{"type":"step-start"}')
    p = e.select("user_id", F.col("ts_ms").alias("time_updated"), data.alias("data"))
    return part_store.settled_parts(p, NOW - 10 * DAY_MS).groupBy("user_id").agg(F.count(F.lit(1)).alias("settled"))


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS m FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, 'm' || CAST(m AS VARCHAR) AS event_id, CASE role WHEN 'system' THEN 'notification' ELSE role END AS kind,
      {mask_sql('text')} AS text FROM c WHERE role <> 'assistant' OR trim(text) <> ''
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'm' || CAST(m AS VARCHAR) || 'c0', 'tool_use', 'needle' || CAST(turn AS VARCHAR) FROM c WHERE role = 'assistant'
    UNION ALL SELECT CAST(conv_id AS VARCHAR), 'm' || CAST(m AS VARCHAR) || 'r0', 'tool_result', {mask_sql('text')} FROM c WHERE role = 'assistant' AND turn % 2 = 1"""
)
def doc_events(spark, sf):
    c = table(spark, sf, "conversations")
    status = F.when(F.col("turn") % 2 == 1, "success").otherwise("executing")
    call = F.struct(
        F.lit("c").alias("id"), F.lit("glob").alias("name"), F.struct(F.concat(F.lit("needle"), F.col("turn").cast("string")).alias("pattern")).alias("args"),
        status.alias("status"), F.col("text").alias("resultDisplay"),
    )
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "system", "info").otherwise("user")
    msg = F.struct(
        "turn", F.struct(kind.alias("type"), F.col("text").alias("content"), F.when(F.col("role") == "assistant", F.array(call)).alias("toolCalls")).alias("msg")
    )
    # a document is one conversation, as its file would hold it
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(msg)).alias("ms"))
    sid = F.col("conv_id").cast("string")
    body = F.to_json(F.struct(sid.alias("sessionId"), F.transform("ms", lambda m: m["msg"]).alias("messages")))
    ev = document.events(cut_lineage(docs.select(sid.alias("file"), F.lit(1).cast("bigint").alias("mtime"), body.alias("value"))))
    return ev.select("session_id", "event_id", "kind", "text")


@query(
    f"""WITH c AS (SELECT conv_id, turn, role, text FROM conversations)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, {_UID} || ':0' AS event_id, CASE role WHEN 'system' THEN 'thinking' ELSE role END AS kind, {mask_sql('text')} AS text FROM c WHERE text <> ''
    UNION ALL SELECT CAST(conv_id AS VARCHAR), {_UID} || ':1', 'tool_use', '…/b/c/' || CAST(turn AS VARCHAR) FROM c WHERE role = 'assistant'"""
)
def chain_events(spark, sf):
    c = table(spark, sf, "conversations")
    sid = F.col("conv_id").cast("string")
    uid = F.concat_ws("-", sid, F.col("turn").cast("string"))
    kind = F.when(F.col("role") == "system", "reasoning").otherwise("text")
    part = F.to_json(F.struct(kind.alias("type"), F.col("text")))
    req = F.to_json(
        F.struct(F.lit("toolCallRequest").alias("type"), F.lit("list_dir").alias("name"), F.struct(F.concat(F.lit("/a/b/c/"), F.col("turn").cast("string")).alias("path")).alias("parameters"))
    )
    parts = F.when(F.col("role") == "assistant", F.concat_ws(",", part, req)).otherwise(part)
    entry = F.concat(F.lit('{"id":"'), uid, F.lit('","type":"message","createdTimestamp":1000,"message":{"role":"'), "role", F.lit('","parts":['), parts, F.lit("]}}"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select(F.lit("p").alias("project_id"), "conv_id", "turn", uid.alias("id"), F.lag(uid).over(w).alias("previous_id"), entry.alias("entry_json"))
    heads = rows.groupBy("project_id", "conv_id").agg(F.max_by("id", "turn").alias("committed_head_entry_id"))
    s = heads.select("project_id", F.col("conv_id").cast("string").alias("session_id"), "committed_head_entry_id")
    ev = chain_store.events((s, cut_lineage(rows)))
    return ev.select("session_id", "event_id", "kind", "text")


# ---------------------------------------------------------------------------------------------- topics
@query(
    f"""WITH {EVENTS_SQL} SELECT event_id, array_to_string(CASE WHEN units < 1000000 THEN [upper(event_type) || '-' || CAST(k AS VARCHAR), upper(substr(event_type, 1, 2)) || '-' || CAST(units AS VARCHAR)]
      ELSE [upper(event_type) || '-' || CAST(k AS VARCHAR)] END, ',') AS tickets FROM ev"""
)
def tickets(spark, sf):
    e = event_lines(spark, sf)
    up = F.upper("event_type")
    k, u = F.col("k").cast("string"), F.col("units").cast("string")
    text = F.concat(F.lit("see "), up, F.lit("-"), k, F.lit(" and UTF-8, "), F.substring(up, 1, 2), F.lit("-"), u, F.lit(" x"), up, F.lit("-1a "), up, F.lit("-"), k)
    return TP.extract_keys(e.select("event_id", text.alias("t")), "t").select("event_id", F.array_join("tickets", ",").alias("tickets"))


@query(
    f"""WITH {EVENTS_SQL}, known AS (SELECT DISTINCT upper(event_type) AS p FROM ev WHERE units > 35000)
    SELECT event_id, CAST(0 AS INTEGER) AS pos, upper(event_type) || '-' || CAST(k AS VARCHAR) AS key FROM ev WHERE upper(event_type) IN (SELECT p FROM known)"""
)
def tickets_loose(spark, sf):
    e = event_lines(spark, sf)
    known = TP.known_prefixes(
        e.where(F.col("units") > 35000).select(
            F.concat_ws("-", F.upper("event_type"), F.col("k").cast("string")).alias("session_name"), F.lit("").alias("label"), F.lit("").alias("git_branch"), F.lit("").alias("worktree_branch")
        )
    )
    text = F.concat(F.lit("work on "), "event_type", F.lit("-"), F.col("k").cast("string"), F.lit(" and nope-1"))
    return TP.loose_tickets(e.select("event_id", text.alias("t")), ["event_id"], "t", known)


@query(
    f"""WITH {EVENTS_SQL} SELECT event_id, array_to_string(list_filter(CASE WHEN k = units THEN [k] ELSE [k, units] END, lambda x: x > 0 AND x < 1000000), ',') AS prs FROM ev"""
)
def prs(spark, sf):
    text = F.concat(F.lit("fix #"), F.col("units").cast("string"), F.lit(" in pr "), F.col("k").cast("string"), F.lit(" &#20; a#7"))
    e = event_lines(spark, sf).select("event_id", text.alias("t"))
    return TP.extract_keys(e, "t").select("event_id", F.array_join(F.col("prs").cast("array<string>"), ",").alias("prs"))


_STOP = ", ".join(_q(w) for w in TT.TITLE_STOP)
_LOWER_TR = "lower(translate(text, 'İI', 'iı'))"
_WORDS_SQL = f"string_split(regexp_replace(regexp_replace({_LOWER_TR}, '[^\\p{{L}}{_W}]+', ' ', 'g'), '[{_W}]+', ' ', 'g'), ' ')"
_TOKENS_SQL = (
    f"list_transform(list_filter({_WORDS_SQL}, lambda w: length(w) >= 3 AND w NOT IN ({_STOP}) AND regexp_matches(w, '[aeıioöuüy]')), lambda w: substr(w, 1, 5))"
)


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct({_TOKENS_SQL})), ' ') AS tokens FROM documents")
def title_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(F.array_sort(TT.title_tokens("text")), " ").alias("tokens"))


def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Every sentence of the conversations as a title, in its role as project."""
    c = table(spark, sf, "conversations")
    s = c.select("conv_id", "turn", F.col("role").alias("project"), F.posexplode(F.split("text", "\\.")).alias("i", "title"))
    return s.select("project", (F.col("conv_id") * 1_000_000 + F.col("turn") * 10_000 + F.col("i")).alias("n"), "title")


_SENT = f"""sent AS (SELECT role AS project, conv_id * 1000000 + turn * 10000 + i - 1 AS n, text FROM (SELECT conv_id, turn, role, unnest(string_split(text, '.')) AS text,
      generate_subscripts(string_split(text, '.'), 1) AS i FROM conversations)),
    tok AS (SELECT project, n, list_sort(list_distinct({_TOKENS_SQL})) AS t FROM sent),
    sets AS (SELECT project, t, min(n) AS id FROM tok WHERE len(t) > 0 GROUP BY 1, 2),
    x AS (SELECT project, id, len(t) AS n, unnest(t) AS w FROM sets),
    pairs AS (SELECT a.project, a.id AS id_a, b.id AS id_b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.project = b.project AND a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3),
    near AS (SELECT project, id_a, id_b, CAST(c AS DOUBLE) / CAST(na + nb - c AS DOUBLE) AS jaccard FROM pairs WHERE CAST(c AS DOUBLE) / CAST(na + nb - c AS DOUBLE) >= 0.6)"""


@query(f"WITH {_SENT} SELECT project, id_a, id_b, jaccard FROM near QUALIFY row_number() OVER (PARTITION BY project, id_b ORDER BY jaccard DESC, id_a) = 1")
def jaccard_pairs(spark, sf):
    s = _sentences(spark, sf).withColumn("tokens", F.array_sort(TT.title_tokens("title"))).where(F.size("tokens") > 0)
    sets = s.groupBy("project", "tokens").agg(F.min("n").alias("id"))
    return TP.jaccard_pairs(sets, "id", "tokens", ["project"])


@query(
    f"""WITH RECURSIVE {_SENT}, nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM (SELECT id_a AS id FROM near UNION SELECT id_b FROM near)),
    nb AS (SELECT id_b AS id, list(id_a) AS before FROM near GROUP BY 1),
    q AS (SELECT nodes.id, rn, coalesce(before, []) AS before FROM nodes LEFT JOIN nb USING (id)),
    g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS leaders UNION ALL
      SELECT q.rn, CASE WHEN list_has_any(g.leaders, q.before) THEN g.leaders ELSE list_append(g.leaders, q.id) END FROM g JOIN q ON q.rn = g.rn + 1),
    led AS (SELECT unnest(leaders) AS id FROM g QUALIFY row_number() OVER (ORDER BY rn DESC) = 1),
    m AS (SELECT id_b AS id, min(id_a) AS lead FROM near WHERE id_a IN (SELECT id FROM led) AND id_b NOT IN (SELECT id FROM led) GROUP BY 1),
    f AS (SELECT sets.project, sets.t, coalesce(l.t, sets.t) AS lt FROM sets LEFT JOIN m ON m.id = sets.id LEFT JOIN sets l ON l.id = m.lead AND l.project = sets.project)
    SELECT tok.project, n, coalesce(array_to_string(lt, ' '), '') AS leader FROM tok LEFT JOIN f ON f.project = tok.project AND f.t = tok.t"""
)
def title_merge(spark, sf):
    return TP.merge_titles(_sentences(spark, sf), "title", ["project"], ["n"]).select("project", "n", "leader")


_STEMS = ", ".join(_q(w) for w in sorted({*TT.DEV_STEMS, *TT.GENERIC_STEMS}))


@query(
    f"""WITH c AS (SELECT role, conv_id, turn, {_TOKENS_SQL} AS t, {_WORDS_SQL} AS w FROM conversations WHERE turn > 0),
    p AS (SELECT role, conv_id, turn, u.t AS word, min(u.i) AS pos FROM (SELECT role, conv_id, turn, unnest(t) AS t, generate_subscripts(t, 1) AS i FROM c) u WHERE u.t NOT IN ({_STEMS}) GROUP BY 1, 2, 3, 4),
    z AS (SELECT role, count(*) AS size FROM c GROUP BY 1),
    d AS (SELECT role, word, count(*) AS df FROM p GROUP BY 1, 2),
    us AS (SELECT d.* FROM d JOIN z USING (role) WHERE size >= 5 AND df >= 3 AND df <= size * 0.6),
    best AS (SELECT p.role, conv_id, turn, p.word FROM p JOIN us ON us.role = p.role AND us.word = p.word
      QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY df DESC, length(p.word) DESC, pos) = 1),
    keep AS (SELECT role, word FROM best GROUP BY 1, 2 HAVING count(*) >= 3),
    forms AS (SELECT c.role, substr(f.full_, 1, 5) AS word, f.full_ AS form, count(*) AS n FROM (SELECT role, conv_id, turn, unnest(w) AS full_ FROM c) f
      JOIN c ON c.conv_id = f.conv_id AND c.turn = f.turn JOIN p ON p.conv_id = f.conv_id AND p.turn = f.turn AND p.word = substr(f.full_, 1, 5)
      WHERE length(f.full_) >= 3 GROUP BY 1, 2, 3),
    name AS (SELECT role, word, form FROM forms QUALIFY row_number() OVER (PARTITION BY role, word ORDER BY n DESC, length(form) DESC, form) = 1)
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS agent_key, CASE WHEN keep.word IS NOT NULL THEN 'c|' || c.role || '|' || keep.word ELSE 'o|' || c.role END AS slot,
      CASE WHEN keep.word IS NOT NULL THEN upper(translate(substr(form, 1, 1), 'iı', 'İI')) || substr(form, 2) ELSE '' END AS title
    FROM c LEFT JOIN best USING (conv_id, turn) LEFT JOIN keep ON keep.role = c.role AND keep.word = best.word LEFT JOIN name ON name.role = keep.role AND name.word = keep.word
    UNION ALL SELECT CAST(conv_id AS VARCHAR), turn, 'o|' || role, '' FROM conversations WHERE turn = 0"""
)
def loose_clusters(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").alias("agent_key"), (F.col("turn") == 0).alias("is_main"), F.col("text").alias("label"),
        F.lit("other").alias("kind"), F.concat_ws("|", F.lit("o"), F.col("role")).alias("slot"), F.col("role").alias("project"), F.lit("").alias("title"),
    )
    return TP.cluster_loose(c).select("session_id", "agent_key", "slot", "title")


def _classified(spark: SparkSession, sf: str) -> DataFrame:
    """The first event of a user is its main agent; the others are sub-agents, some with a ticket."""
    e = event_lines(spark, sf)
    day = F.floor(F.col("ts_ms") / (10 * DAY_MS))
    e = e.withColumn("session_id", F.concat_ws("-", F.col("user_id").cast("string"), day.cast("string")))
    main = F.min("event_id").over(Window.partitionBy("session_id")) == F.col("event_id")
    e = e.withColumn("is_main", main)
    subs = F.count_if(~F.col("is_main")).over(Window.partitionBy("session_id"))
    keyed = ~F.col("is_main") & F.col("event_type").isin("view", "click", "error")
    key = F.concat(F.lit("T-"), (F.col("k") % 2).cast("string"))
    project = F.concat(F.lit("p"), (F.col("k") % 2).cast("string"))
    return e.select(
        "session_id", F.col("event_id").alias("agent_key"), "is_main", subs.alias("sub_count"), F.when(keyed, "ticket").otherwise("other").alias("kind"),
        F.when(keyed, key).alias("key"), F.when(keyed, F.concat_ws("|", F.lit("t"), project, key)).otherwise(F.concat_ws("|", F.lit("o"), project)).alias("slot"),
        F.when(keyed, F.col("event_type")).otherwise("").alias("title"), project.alias("project"), "ts_ms", "units", "event_type", "user_id",
    )


_CLASSIFIED = """c0 AS (SELECT *, CAST(user_id AS VARCHAR) || '-' || CAST(ts_ms // 864000000 AS VARCHAR) AS session_id FROM ev),
    c1 AS (SELECT *, min(event_id) OVER (PARTITION BY session_id) = event_id AS is_main FROM c0),
    c AS (SELECT session_id, event_id AS agent_key, is_main, count(*) FILTER (WHERE NOT is_main) OVER (PARTITION BY session_id) AS sub_count, 'p' || CAST(k % 2 AS VARCHAR) AS project,
      'T-' || CAST(k % 2 AS VARCHAR) AS tk, NOT is_main AND event_type IN ('view', 'click', 'error') AS keyed, event_type, ts_ms, units, user_id FROM c1),
    s AS (SELECT *, CASE WHEN keyed THEN 't|' || project || '|' || tk ELSE 'o|' || project END AS slot FROM c),
    tally AS (SELECT session_id, slot, count(*) AS n, min(agent_key) AS lead FROM s WHERE keyed GROUP BY 1, 2),
    top AS (SELECT * FROM tally QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, lead) = 1),
    final AS (SELECT s.session_id, s.agent_key, s.is_main, s.ts_ms, s.units, s.user_id, s.event_type,
      CASE WHEN s.is_main AND sub_count > 0 AND coalesce(CAST(top.n AS DOUBLE) / sub_count >= 0.5, false) THEN 'ticket' WHEN s.is_main AND sub_count >= 3 THEN 'orchestration' WHEN keyed THEN 'ticket' ELSE 'other' END AS kind,
      CASE WHEN s.is_main AND sub_count > 0 AND coalesce(CAST(top.n AS DOUBLE) / sub_count >= 0.5, false) THEN top.slot WHEN s.is_main AND sub_count >= 3 THEN 'r|' || project ELSE s.slot END AS slot
      FROM s LEFT JOIN top USING (session_id))"""


@query(f"WITH {EVENTS_SQL}, {_CLASSIFIED} SELECT session_id, agent_key, kind, slot FROM final")
def dominant_topic(spark, sf):
    return TP.assign_main_topics(_classified(spark, sf)).select("session_id", "agent_key", "kind", "slot")


def _topic_agents(spark: SparkSession, sf: str) -> DataFrame:
    c = TP.assign_main_topics(_classified(spark, sf))
    state = F.when(F.col("event_type") == "click", "running").when(F.col("event_type") == "error", "failed").otherwise("done")
    action = F.struct(F.lit("Read").alias("tool"), F.lit("read").alias("kind"), F.concat(F.lit("f"), F.col("agent_key").cast("string")).alias("target"))
    return c.withColumns(
        {
            "session_name": F.concat(F.lit("s"), F.col("session_id")), "provider": F.concat(F.lit("v"), (F.col("user_id") % 2).cast("string")), "state": state,
            "started_at": F.col("ts_ms"), "last_activity_at": F.col("ts_ms"), "cost_usd": F.col("units") / 100, "cost_partial": F.col("units") > 30000,
            "last_action": F.when(state == "running", action), "label": F.col("event_type"),
        }
    )


_TOPICS = f"""{_CLASSIFIED},
    n AS (SELECT *, count(*) OVER (PARTITION BY slot, title) AS freq FROM (SELECT *, CASE WHEN kind <> 'ticket' THEN '' WHEN is_main THEN (SELECT any_value(NULL::VARCHAR)) ELSE event_type END AS title FROM final)),
    title AS (SELECT slot, title FROM n WHERE NOT is_main AND title <> '' QUALIFY row_number() OVER (PARTITION BY slot ORDER BY freq DESC, length(title) DESC, session_id, agent_key) = 1),
    r AS (SELECT slot, string_agg('Reading f' || CAST(agent_key AS VARCHAR), ' / ' ORDER BY rn) AS recent FROM (SELECT slot, agent_key, row_number() OVER (PARTITION BY slot ORDER BY ts_ms DESC, is_main, session_id, agent_key) AS rn
      FROM final WHERE event_type = 'click') WHERE rn <= 3 GROUP BY 1),
    topic AS (SELECT slot, substr(sha1(slot), 1, 10) AS topic_id, any_value(kind) AS kind, count(*) FILTER (WHERE event_type = 'click') AS running,
      count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS total, min(ts_ms) AS first_at, max(ts_ms) AS last_at,
      CAST(sum(units) AS DOUBLE) / 100 AS cost_usd, bool_or(units > 30000) AS cost_partial, string_agg(DISTINCT 'v' || CAST(user_id % 2 AS VARCHAR), ',' ORDER BY 'v' || CAST(user_id % 2 AS VARCHAR)) AS providers FROM final GROUP BY 1)"""


@query(
    f"""WITH {EVENTS_SQL}, {_TOPICS} SELECT topic_id, kind, CASE WHEN kind = 'ticket' THEN string_split(slot, '|')[3] END AS key, CAST(running AS BIGINT) AS running, CAST(failed AS BIGINT) AS failed,
      CAST(total AS BIGINT) AS total, first_at, last_at, cost_usd, cost_partial, providers, coalesce(recent, '') AS recent,
      CASE WHEN kind = 'ticket' THEN title WHEN kind = 'other' THEN 'Other · ' || string_split(slot, '|')[2] END AS title
    FROM topic LEFT JOIN r USING (slot) LEFT JOIN title USING (slot)"""
)
def topic_facts(spark, sf):
    t = TP.finish_topics(_topic_agents(spark, sf))
    title = F.when(F.col("kind") != "orchestration", F.col("title"))
    return t.select(
        "topic_id", "kind", "key", "running", "failed", "total", "first_at", "last_at", "cost_usd", "cost_partial", F.array_join("providers", ",").alias("providers"),
        F.array_join("recent", " / ").alias("recent"), title.alias("title"),
    )


@query(
    f"""WITH {EVENTS_SQL}, {_TOPICS}, first AS (SELECT *, row_number() OVER (ORDER BY (kind = 'other'), (running > 0) DESC, last_at DESC, topic_id) AS rk FROM topic),
    calls AS (SELECT substr(sha1('t|p' || CAST(k % 2 AS VARCHAR) || '|T-' || CAST(k % 2 AS VARCHAR)), 1, 10) AS topic_id, ts_ms AS tried_at FROM ev WHERE event_type = 'purchase' AND k = 0),
    used AS (SELECT count(*) AS n FROM calls WHERE tried_at > {NOW} - 3600000),
    ok AS (SELECT first.*, row_number() OVER (ORDER BY (running > 0) DESC, last_at DESC, first.topic_id) AS place FROM first LEFT JOIN (SELECT topic_id, max(tried_at) AS tried FROM calls GROUP BY 1) t ON t.topic_id = first.topic_id
      WHERE rk <= 12 AND kind <> 'other' AND (running > 0 OR {NOW} - last_at <= 7200000) AND (tried IS NULL OR {NOW} - tried >= 600000))
    SELECT topic_id, CAST(place AS INTEGER) AS place FROM ok WHERE place <= 20 - (SELECT n FROM used)"""
)
def summary_candidates(spark, sf):
    a = _topic_agents(spark, sf)
    topics = TP.topic_hash(TP.finish_topics(a), TP.topic_members(a))
    slot = F.concat(F.lit("t|p"), (F.col("k") % 2).cast("string"), F.lit("|T-"), (F.col("k") % 2).cast("string"))
    calls = event_lines(spark, sf).where((F.col("event_type") == "purchase") & (F.col("k") == 0)).select(
        F.substring(F.sha1(slot), 1, 10).alias("topic_id"), F.col("ts_ms").alias("at")
    )
    # nothing is cached under the current facts
    cache = topics.select("topic_id", F.reverse("facts_hash").alias("facts_hash"))
    return TP.summary_candidates(topics, cache, calls, NOW).select("topic_id", "place")


def _agents(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as topic agents: turn 0 is the main agent, the text of a turn is its label."""
    c = table(spark, sf, "conversations")
    sid = F.col("conv_id").cast("string")
    action = F.struct(F.lit("Bash").alias("tool"), F.lit("bash").alias("kind"), F.concat(F.lit("gh pr view "), F.col("turn").cast("string")).alias("target"))
    t = (F.col("conv_id") * 1000 + F.col("turn")).cast("bigint")
    return c.select(
        sid.alias("session_id"), F.col("text").alias("session_name"), F.lit("line_log").alias("provider"), F.concat(F.lit("/w/"), "role").alias("cwd"),
        (F.col("turn") == 0).alias("is_main"), F.lit(None).cast("string").alias("git_branch"), F.col("text").alias("last_prompt"), F.col("turn").cast("string").alias("agent_key"),
        F.col("text").alias("label"), F.when(F.col("turn") == 5, "running").otherwise("done").alias("state"), t.alias("started_at"), t.alias("last_activity_at"),
        F.lit(0.0).alias("cost_usd"), F.lit(False).alias("cost_partial"), F.lit(None).cast("string").alias("worktree_branch"), F.when(F.col("turn") == 5, action).alias("last_action"),
    )


@query()
def topics_end_to_end(spark, sf):
    """The whole topic run over all conversation turns as agents (tested against brute force on fixtures)."""
    t = TP.build_topics(_agents(spark, sf))
    return t.select("topic_id", "kind", "key", "title", "project", "running", "done", "failed", "total", "summary")
