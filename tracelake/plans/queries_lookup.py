"""Lookups, filters, groups and the remaining page forms over the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.functions import text as X, topic_text as TT
from tracelake.operators import events as E, lookup as K, sessions as S, topics as TP, tree as T
from tracelake.operators.state import agent_mode, end_columns
from tracelake.operators.usage import normalise_usage
from tracelake.plans.binding import DAY_MS, EVENTS_SQL, NOW, event_lines, part_nodes, table
from tracelake.plans.queries_sessions import _NODES, _TREE, _nodes, _page_events, _PAGE, _sessions
from tracelake.sources.files import union_layouts
from tracelake.sources.tables import changed_since, upsert
from tracelake.streaming import jobs

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, w AS (SELECT DISTINCT user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN k END AS agent_key, CASE WHEN event_id % 2 = 1 THEN 'c' || CAST(k + 1 AS VARCHAR) END AS call_id FROM ev)
    SELECT DISTINCT node.session_id, node.agent_key, state FROM node JOIN w ON node.session_id = w.session_id AND (node.agent_key = w.agent_key OR (w.agent_key IS NULL AND 'c' || CAST(node.agent_key AS VARCHAR) = w.call_id))"""
)
def find_nodes(spark, sf):
    n = _nodes(spark, sf).withColumn("tool_use_id", F.concat(F.lit("c"), F.col("agent_key").cast("string")))
    odd = F.col("event_id") % 2 == 1
    wanted = event_lines(spark, sf).select(F.col("user_id").alias("session_id"), F.when(~odd, F.col("k")).alias("agent_key"), F.when(odd, F.concat(F.lit("c"), (F.col("k") + 1).cast("string"))).alias("tool_use_id"))
    return K.find_nodes(n, wanted).select("session_id", "agent_key", "state")


@query(
    f"""WITH {_TREE}, c AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 1 + p_partkey % 2 ELSE p_partkey // 9 END AS root FROM part)
    SELECT c.id, c.root, t.id IS NOT NULL AS belongs FROM c LEFT JOIN t ON t.id = c.id AND t.root = c.root"""
)
def tree_membership(spark, sf):
    t = T.resolve_tree(part_nodes(spark, sf).select("id", "parent"))
    root = F.when(F.col("p_size") % 2 == 0, 1 + F.col("p_partkey") % 2).otherwise(F.expr("p_partkey div 9"))
    claims = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), root.alias("root"))
    return K.in_tree(t, claims).select("id", "root", "belongs")


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey // 3 <> p_partkey THEN p_partkey // 3 END AS parent, p_size FROM part),
    v AS (SELECT n.id, CASE WHEN k.id IS NOT NULL THEN n.parent END AS parent, n.p_size FROM n LEFT JOIN n k ON k.id = n.parent),
    t AS (SELECT id, [struct_pack(a := p_size, b := id)] AS path FROM v WHERE parent IS NULL
      UNION ALL SELECT v.id, list_append(t.path, struct_pack(a := v.p_size, b := v.id)) FROM v JOIN t ON v.parent = t.id)
    SELECT id, CAST(len(path) - 1 AS INTEGER) AS depth, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS place FROM t"""
)
def tree_preorder(spark, sf):
    t = T.resolve_tree(part_nodes(spark, sf).select("id", "parent", "p_size"), order=[F.col("p_size")])
    return S.with_place(t.select("id", "depth", "order_path"), K.preorder(t)).select("id", "depth", "place")


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT 'running' AS filter, session_id, agent_key FROM node WHERE state = 'running' OR (NOT is_main AND state = 'stalled')
    UNION ALL SELECT 'failed', session_id, agent_key FROM node WHERE state = 'failed'"""
)
def node_filter(spark, sf):
    n = _nodes(spark, sf)
    parts = [K.node_filter(n, w).select(F.lit(w).alias("filter"), "session_id", "agent_key") for w in ("running", "failed")]
    return parts[0].unionByName(parts[1])


@query("SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant')")
def text_only(spark, sf):
    return K.text_only(table(spark, sf, "conversations").withColumn("kind", F.col("role"))).select("conv_id", "turn")


_RUNNING = "r AS (SELECT node.* FROM node JOIN live USING (session_id) WHERE live AND state = 'running')"


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, {_RUNNING}, g AS (SELECT session_id, count(*) AS agents FROM r GROUP BY 1)
    SELECT session_id, agents, CAST(row_number() OVER (ORDER BY agents DESC, 's' || CAST(session_id AS VARCHAR), session_id) AS INTEGER) AS place FROM g"""
)
def running_groups(spark, sf):
    n = _nodes(spark, sf)
    g = K.running_groups(S.running_now(n, _sessions(n)))
    order = [F.col("agents").desc(), F.lower("session_name"), F.col("session_id").asc()]
    return S.with_place(g.select("session_id", "session_name", "agents"), order).select("session_id", "agents", "place")


@query(
    f"""WITH {EVENTS_SQL}, {_NODES}, m AS (SELECT state AS topic_id, session_id, agent_key, row_number() OVER (PARTITION BY state ORDER BY last_ts DESC, session_id, agent_key) AS place, state FROM node),
    g AS (SELECT topic_id, session_id, min(place) AS f, count(*) AS agents, count(*) FILTER (WHERE state IN ('running', 'stalled')) AS running FROM m GROUP BY 1, 2)
    SELECT topic_id, session_id, agents, running, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY f) AS INTEGER) AS place FROM g"""
)
def topic_sessions(spark, sf):
    from pyspark.sql import Window

    n = _nodes(spark, sf).withColumn("topic_id", F.col("state"))
    w = Window.partitionBy("topic_id").orderBy(F.col("last_ts").desc(), "session_id", "agent_key")
    members = n.select("topic_id", "session_id", F.col("session_id").cast("string").alias("session_name"), "state", F.row_number().over(w).alias("place"))
    return K.session_groups(members).select("topic_id", "session_id", "agents", "running", "place")


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, first_activity_at AS started_at, CAST(row_number() OVER (ORDER BY first_activity_at DESC, session_id) AS INTEGER) AS place FROM live WHERE live"""
)
def live_rail(spark, sf):
    s = _sessions(_nodes(spark, sf)).withColumn("started_at", F.col("first_activity_at"))
    order = [F.col("started_at").desc_nulls_last(), F.col("session_id").asc()]
    return S.with_place(S.live_rail(s).select("session_id", "started_at"), order)


@query("SELECT CAST(c_custkey AS VARCHAR) AS session_id, c_name AS name, NULL AS cwd FROM customer UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, s_name FROM supplier")
def union_sessions(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), F.col("c_name").alias("name"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("session_id"), F.col("s_name").alias("cwd"))
    return union_layouts([a, b]).select("session_id", "name", "cwd")


@query(
    f"""WITH {EVENTS_SQL}, l AS (SELECT user_id, max(event_id) FILTER (WHERE event_id <= 500) AS a, max(event_id) FILTER (WHERE event_id > 500) AS b FROM ev GROUP BY 1)
    SELECT user_id, coalesce(b, a) AS time_updated FROM l"""
)
def upsert_rows(spark, sf):
    """Rows past a high-water mark over the rows before it: the latest version of each user."""
    rows = event_lines(spark, sf).select("user_id", F.col("event_id").alias("time_updated"))
    newest = lambda d: d.groupBy("user_id").agg(F.max("time_updated").alias("time_updated"))
    return upsert(newest(rows.where("time_updated <= 500")), newest(changed_since(rows, 500)), "user_id")


_PARTS = f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, ts_ms // 3600000 AS created_ms, event_id AS part_id, ts_ms AS updated_ms FROM ev)"""


def _parts(spark, sf):
    e = event_lines(spark, sf)
    return e.select("user_id", F.floor(F.col("ts_ms") / 3_600_000).alias("created_ms"), F.col("event_id").alias("part_id"), F.col("ts_ms").alias("updated_ms"))


@query(
    f"""{_PARTS}, o AS (SELECT * FROM p WHERE created_ms < 473600),
    w AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, part_id DESC) AS s FROM o),
    st AS (SELECT user_id, min(created_ms) AS page_start FROM w WHERE s <= 5 GROUP BY 1)
    SELECT user_id, part_id, page_start, page_start > min(created_ms) OVER (PARTITION BY user_id) AS truncated FROM o JOIN st USING (user_id) QUALIFY created_ms >= page_start"""
)
def part_page_before(spark, sf):
    return E.part_page(_parts(spark, sf), ["user_id"], tail=5, before=473_600).select("user_id", "part_id", "page_start", "truncated")


@query(
    f"""{_PARTS}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_ms, part_id) AS r FROM p WHERE updated_ms > 1705000000000)
    SELECT user_id, part_id FROM n WHERE r <= 3"""
)
def part_page_after(spark, sf):
    return E.part_page(_parts(spark, sf), ["user_id"], after=1_705_000_000_000, limit=3).select("user_id", "part_id")


_PLACED = f"WITH {EVENTS_SQL}, e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, count(*) OVER (PARTITION BY user_id) AS total FROM ev)"


def _placed(spark, sf):
    from tracelake.operators.segments import position

    rows = position(event_lines(spark, sf).select("user_id", "event_id"), ["user_id"], "event_id", "p")
    return rows.select("user_id", "event_id", (F.col("p") - 1).alias("position"))


@query(
    f"""{_PLACED} SELECT user_id, event_id, greatest(0, least(total, 8) - 5) AS page_start, least(total, 8) > 5 AS truncated, false AS reset FROM e
    WHERE position < 8 AND position >= greatest(0, least(total, 8) - 5)"""
)
def position_before(spark, sf):
    return E.position_page(_placed(spark, sf), ["user_id"], "position", tail=5, before=8).select("user_id", "event_id", F.col("page_start").cast("bigint").alias("page_start"), "truncated", "reset")


@query(
    f"""{_PLACED}, s AS (SELECT *, total < 9 AS reset, CASE WHEN total < 9 THEN 0 ELSE 9 END AS start FROM e),
    l AS (SELECT *, greatest(start, total - 4) AS low FROM s)
    SELECT user_id, event_id, low AS page_start, low > start AS truncated, reset FROM l WHERE position >= low"""
)
def position_after(spark, sf):
    """A cursor beyond the end of a log starts over (``reset``)."""
    return E.position_page(_placed(spark, sf), ["user_id"], "position", after=9, limit=4).select("user_id", "event_id", F.col("page_start").cast("bigint").alias("page_start"), "truncated", "reset")


@query(
    f"""WITH {_PAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM pe WHERE ord >= 10)
    SELECT user_id, event_id, ord, CAST(10 AS BIGINT) AS page_start, n > 3 AS truncated FROM r WHERE rn <= 3"""
)
def page_after_limit(spark, sf):
    return E.event_page(_page_events(spark, sf), ["user_id"], after=10, limit=3).select("user_id", "event_id", "ord", "page_start", "truncated")


# ---------------------------------------------------------------------------------------------- text forms of the layouts
_SITE = "regexp_extract(url, '^https?://([^/]+)', 1)"


def _pages(spark, sf):
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return table(spark, sf, "pages").select("page_id", "url", site.alias("site"))


@query(
    f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_SITE} ELSE 'rollout:' || {_SITE} END AS key, regexp_replace('/w/' || {_SITE}, '[^A-Za-z0-9]', '-', 'g') AS folder,
      CASE WHEN page_id % 2 = 0 THEN 'line_log' ELSE 'rollout' END AS layout FROM pages"""
)
def session_keys(spark, sf):
    p = _pages(spark, sf)
    layout = F.when(F.col("page_id") % 2 == 0, "line_log").otherwise("rollout")
    key = X.session_key(layout, F.col("site"))
    return p.select("page_id", key.alias("key"), X.encode_cwd(F.concat(F.lit("/w/"), "site")).alias("folder"), X.parse_session_key(key)["layout"].alias("layout"))


@query(
    f"""SELECT page_id, page_id % 6 IN (0, 5) AS allowed, CASE page_id % 3 WHEN 0 THEN '~/' || {_SITE} WHEN 1 THEN '~' ELSE '/srv/home/u/' || {_SITE} END AS shown,
      CASE page_id % 3 WHEN 0 THEN {_SITE} WHEN 1 THEN 'two' ELSE substr('id-' || CAST(page_id AS VARCHAR) || '-0000000', 1, 8) END AS name FROM pages"""
)
def safe_paths(spark, sf):
    """Paths that may be read, paths as shown, and fallback names."""
    p = _pages(spark, sf)
    n = lambda m: F.col("page_id") % m
    path = F.element_at(F.array(*[F.concat(F.lit("/w/"), "site", F.lit(f"/{x}")) for x in ("log.jsonl", "auth.json", "id_rsa", ".env", "../log.jsonl", "a/b")]), (n(6) + 1).cast("int"))
    shown = F.when(n(3) == 0, F.concat(F.lit("/home/u/"), "site")).when(n(3) == 1, F.lit("/home/u")).otherwise(F.concat(F.lit("/srv/home/u/"), "site"))
    names = [F.when(n(3) == 0, F.concat(F.lit(" "), "site", F.lit(" "))).otherwise("  "), F.when(n(3) == 1, F.lit("two"))]
    ident = F.concat(F.lit("id-"), F.col("page_id").cast("string"), F.lit("-0000000"))
    return p.select("page_id", X.safe_path(path, ["/w"]).alias("allowed"), X.display_home(shown, "/home/u").alias("shown"), X.fallback_name(names, ident).alias("name"))


@query(f"WITH {EVENTS_SQL} SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts_ms // 1000 * 1000 ELSE ts_ms END AS at FROM ev WHERE event_id % 5 < 4 UNION ALL SELECT event_id, NULL FROM ev WHERE event_id % 5 = 4")
def times_of_any_form(spark, sf):
    e = event_lines(spark, sf)
    n, ts = F.col("event_id") % 4, F.col("ts_ms")
    iso = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    text = F.when(n == 0, F.expr("ts_ms div 1000").cast("string")).when(n == 1, ts.cast("string")).when(n == 2, (ts * 1000).cast("string")).otherwise(iso)
    return e.select("event_id", X.parse_time_any(F.when(F.col("event_id") % 5 == 4, F.lit("soon")).otherwise(text)).alias("at"))


@query(
    f"""SELECT page_id, '/w/' || {_SITE} || '/a b' AS workspace, 'Read "' || {_SITE} || '" <now> & é' AS title FROM pages"""
)
def stored_forms(spark, sf):
    """Workspace URIs and titles as stores keep them."""
    p = _pages(spark, sf)
    uri = F.concat(F.lit("file:///w/"), "site", F.lit("/a%20b/"))
    n = F.col("page_id") % 4
    stored = (
        F.when(n == 0, F.concat(F.lit('["'), uri, F.lit('","file:///x"]'))).when(n == 1, F.concat(F.lit('[{"uri":"'), uri, F.lit('"}]')))
        .when(n == 2, F.concat(F.lit('{"path":"/w/'), "site", F.lit('/a b"}'))).otherwise(F.concat(uri, F.lit(",file:///y")))
    )
    title = F.concat(F.lit("Read  &quot;"), "site", F.lit("&quot;\n&lt;now&gt; &amp; &#233;"))
    return p.select("page_id", X.workspace_path(stored).alias("workspace"), X.clean_stored_title(title).alias("title"))


@query(
    f"""WITH {EVENTS_SQL} SELECT event_id, 'gh pr view ' || CAST(k + 1 AS VARCHAR) AS core, CASE WHEN event_id % 3 = 0 THEN k + 1 END AS pr, CASE WHEN event_id % 2 = 0 THEN '~/p' || CAST(k AS VARCHAR) END AS dir,
      'make t' || CAST(k AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '' ELSE ' …' END AS head FROM ev"""
)
def command_forms(spark, sf):
    """The core of a command, the pull request it names, and its readable form."""
    e = event_lines(spark, sf)
    k = lambda d=0: (F.col("k") + d).cast("string")
    even = F.col("event_id") % 2 == 0
    view = F.concat(F.lit("cd /q && gh pr view "), k(1), F.lit(" --comments 2>&1 | head"))
    pr = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("gh pr checks "), k(1))).otherwise(F.concat(F.lit("gh pr list --limit "), k(1)))
    make = F.when(even, F.concat(F.lit("cd /home/u/p"), k(), F.lit(" && make t"), k())).otherwise(F.concat(F.lit("make t"), k(), F.lit("\n  echo done")))
    human = X.humanize_command(make, F.lit("/home/u"), F.lit("/home/u/w"))
    return e.select("event_id", X.bash_core(view).alias("core"), TT.pr_from_command(pr).cast("bigint").alias("pr"), human["dir"].alias("dir"), human["head"].alias("head"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'src/' || source WHEN 1 THEN lang || '/a/b/c/d/e' ELSE '~/notes/' || lang END AS module, 'p-' || source AS project FROM documents")
def modules(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id") % 3
    path = (
        F.when(n == 0, F.concat(F.lit("/w/.claude/worktrees/t1/src/"), "source", F.lit("/__tests__/x.py"))).when(n == 1, F.concat(F.lit("/w/"), "lang", F.lit("/a/b/c/d/e/x.py")))
        .otherwise(F.concat(F.lit("/home/u/notes/"), "lang", F.lit("/x.md")))
    )
    project = TT.project_of(F.concat(F.lit("/home/u/src/p-"), "source", F.lit("/")), "/home/u")
    return d.select("doc_id", TT.module_of(path, F.lit("/w"), "/home/u").alias("module"), project.alias("project"))


# ---------------------------------------------------------------------------------------------- usage shapes and nodes
@query(
    """WITH l AS (SELECT l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_tax * 100) AS BIGINT) AS t, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)
    SELECT 'direct' AS shape, n, CAST(sum(q) AS BIGINT) AS input, CAST(sum(t) AS BIGINT) AS output, CAST(sum(d) AS BIGINT) AS cache_read, CAST(sum(t) AS BIGINT) AS cache_create, CAST(sum(CASE WHEN d > 0 THEN least(d, t) END) AS BIGINT) AS cache_create_1h FROM l GROUP BY 2
    UNION ALL SELECT 'inclusive', n, CAST(sum(greatest(0, q - t - d)) AS BIGINT), CAST(sum(t) AS BIGINT), CAST(sum(t) AS BIGINT), CAST(sum(d) AS BIGINT), NULL FROM l GROUP BY 2
    UNION ALL SELECT 'thoughts', n, CAST(sum(greatest(0, q - t) + d) AS BIGINT), CAST(sum(d + t) AS BIGINT), CAST(sum(t) AS BIGINT), 0, NULL FROM l GROUP BY 2"""
)
def usage_shapes(spark, sf):
    l_ = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.round(F.col("l_tax") * 100).alias("t"), F.round(F.col("l_discount") * 100).alias("d"))
    q, t, d = F.col("q"), F.col("t"), F.col("d")
    raw = {
        "direct": F.struct(q.alias("input_tokens"), t.alias("output_tokens"), d.alias("cache_read_input_tokens"), t.alias("cache_creation_input_tokens"), F.struct(d.alias("ephemeral_1h_input_tokens")).alias("cache_creation")),
        "inclusive": F.struct(q.alias("input_tokens"), t.alias("output_tokens"), t.alias("cached_input_tokens"), d.alias("cache_write_input_tokens")),
        "thoughts": F.struct(q.alias("input"), d.alias("output"), t.alias("cached"), t.alias("thoughts"), d.alias("tool")),
    }
    out = None
    for shape, u in raw.items():
        rows = l_.select("n", normalise_usage(shape, u).alias("u")).groupBy("n").agg(*[F.sum(f"u.{c}").alias(c) for c in ("input", "output", "cache_read", "cache_create", "cache_create_1h")])
        rows = rows.select(F.lit(shape).alias("shape"), "n", "input", "output", "cache_read", "cache_create", "cache_create_1h")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT session_id, agent_key, CASE WHEN state <> 'running' THEN last_ts END AS ended_at,
      CASE WHEN agent_key % 7 = 0 THEN 0 ELSE greatest(0, CASE WHEN state = 'running' THEN {NOW} ELSE last_ts END - started_at) END AS duration_ms,
      CASE WHEN is_main THEN 'main' WHEN agent_key % 3 = 0 THEN CASE WHEN last_type = 'view' THEN 'background' ELSE 'foreground' END WHEN agent_key % 3 = 1 THEN 'background' ELSE 'unknown' END AS mode FROM node"""
)
def node_ends(spark, sf):
    n = _nodes(spark, sf).drop("ended_at").withColumn("started_at", F.when(F.col("agent_key") % 7 != 0, F.col("started_at")))
    k = F.col("agent_key") % 3
    shape = F.when(k == 0, F.when(F.col("last_type") == "view", F.lit("background")).otherwise(F.lit("inline")))
    mode = agent_mode(F.col("is_main"), shape, F.when(k == 1, F.lit(True)))
    return n.withColumns(end_columns(NOW)).select("session_id", "agent_key", "ended_at", "duration_ms", mode.alias("mode"))


@query(
    """WITH u AS (SELECT conv_id, turn % 4 AS a, turn, text FROM conversations WHERE role = 'user' AND turn % 4 <> 0)
    SELECT conv_id AS session_id, CAST(a AS VARCHAR) AS agent_key, arg_min(turn, turn) AS ord, arg_min(text, turn) AS text FROM u GROUP BY 1, 2"""
)
def task_prompts(spark, sf):
    a = F.col("turn") % 4
    ev = table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), F.when(a == 0, "main").otherwise(a.cast("string")).alias("agent_key"), F.col("role").alias("kind"), F.col("turn").alias("ord"), "text")
    return E.task_prompts(ev).select("session_id", "agent_key", "ord", "text")


@query(
    f"""WITH {EVENTS_SQL}, kids AS (SELECT DISTINCT user_id, k, 'c' || CAST(min(event_id) AS VARCHAR) AS call FROM ev GROUP BY 1, 2)
    SELECT ev.user_id AS session_id, ev.event_id, kids.k AS child_key FROM ev JOIN kids ON kids.user_id = ev.user_id AND kids.call = 'c' || CAST(ev.event_id AS VARCHAR) WHERE ev.event_type = 'click'"""
)
def link_children(spark, sf):
    e = event_lines(spark, sf)
    call = lambda c: F.concat(F.lit("c"), c.cast("string"))
    kids = e.groupBy(F.col("user_id").alias("session_id"), F.col("k").alias("agent_key")).agg(call(F.min("event_id")).alias("tool_use_id"))
    ev = e.select(F.col("user_id").alias("session_id"), "event_id", F.when(F.col("event_type") == "click", "tool_use").otherwise("user").alias("kind"), call(F.col("event_id")).alias("tool_use_id"))
    return E.link_children(ev, kids).select("session_id", "event_id", "child_key")


@query(
    f"""WITH {EVENTS_SQL}, {_NODES} SELECT node.session_id, agent_key FROM node JOIN live USING (session_id) WHERE state = 'running' OR last_ts >= {NOW - DAY_MS * 2} OR (is_main AND live)"""
)
def window_agents(spark, sf):
    n = _nodes(spark, sf)
    a = n.join(_sessions(n).select("session_id", "live"), "session_id")
    return TP.window_agents(a, NOW, 2 * DAY_MS).select("session_id", "agent_key")


@query(f"WITH {EVENTS_SQL}, t AS (SELECT DISTINCT k AS topic_id FROM ev), c AS (SELECT k, arg_max(event_type, event_id) AS text, max(ts_ms) AS at FROM ev WHERE k % 2 = 0 GROUP BY 1) SELECT t.topic_id, c.text AS summary_text, c.at AS summary_at FROM t LEFT JOIN c ON c.k = t.topic_id")
def attach_summaries(spark, sf):
    e = event_lines(spark, sf)
    cache = e.where("k % 2 = 0").groupBy(F.col("k").alias("topic_id")).agg(F.max_by("event_type", "event_id").alias("text"), F.max("ts_ms").alias("at"))
    return TP.attach_summaries(e.select(F.col("k").alias("topic_id")).distinct(), cache)


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT ts_ms // 60000 AS minute, count(*) AS n FROM ev WHERE event_type = 'purchase' GROUP BY 1),
    w AS (SELECT minute - i AS start, n FROM m, range(60) r(i))
    SELECT start * 60000 AS window_start, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY 1"""
)
def hourly_budget(spark, sf):
    """Calls of every hour that begins at a minute."""
    calls = table(spark, sf, "events").where("event_type = 'purchase'")
    return jobs.hourly_budget(calls, "ts")


# ---------------------------------------------------------------------------------------------- topic steps
def _labelled_agents(spark, sf):
    """Agents whose label, branch or prompt names a ticket, a pull request, a subject, or nothing; the first of a user is its main."""
    e = event_lines(spark, sf)
    k = (F.col("k") + 1).cast("string")
    t = F.col("event_type")
    mains = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    e = e.join(mains, "user_id")
    none = F.lit(None).cast("string")
    action = F.struct(none.alias("tool"), none.alias("kind"), none.alias("target"))
    label = F.when(t == "view", F.concat(F.lit("ABC-"), k, F.lit(": repair the pump"))).when(t == "click", F.concat(F.lit("check PR #"), k)).when(t == "error", F.lit("Repair the pump house wiring")).otherwise("")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.col("event_id").cast("string").alias("agent_key"), (F.col("event_id") == F.col("first")).alias("is_main"), F.lit("").alias("session_name"),
        label.alias("label"), none.alias("git_branch"), F.when(t == "purchase", F.concat(F.lit("feature/XYZ-"), k)).alias("worktree_branch"), F.when(t == "signup", F.concat(F.lit("please see QRS-"), k)).alias("last_prompt"),
        F.concat(F.lit("/w/p"), (F.col("k") % 2).cast("string")).alias("cwd"), F.lit(None).cast(action_type(action, spark)).alias("last_action"), F.col("ts_ms").alias("started_at"),
    )


def action_type(action, spark):
    return spark.range(1).select(action.alias("a")).schema["a"].dataType


@query(
    f"""WITH {EVENTS_SQL}, m AS (SELECT *, event_id = min(event_id) OVER (PARTITION BY user_id) AS is_main, count(*) OVER (PARTITION BY user_id) > 1 AS has_subs, CAST(k + 1 AS VARCHAR) AS n, 'p' || CAST(k % 2 AS VARCHAR) AS p FROM ev),
    c AS (SELECT *, CASE WHEN is_main THEN CASE WHEN event_type = 'signup' AND NOT has_subs THEN 'ticket' ELSE 'other' END WHEN event_type IN ('view', 'purchase', 'signup') THEN 'ticket' WHEN event_type = 'click' THEN 'pr' ELSE 'title' END AS kind FROM m),
    d AS (SELECT *, CASE kind WHEN 'ticket' THEN CASE event_type WHEN 'view' THEN 'ABC-' WHEN 'purchase' THEN 'XYZ-' ELSE 'QRS-' END || n WHEN 'pr' THEN 'PR #' || n END AS key FROM c)
    SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(event_id AS VARCHAR) AS agent_key, kind, key,
      CASE kind WHEN 'ticket' THEN 't|' || p || '|' || key WHEN 'pr' THEN 'p|' || p || '|' || n WHEN 'title' THEN 'n|' || p ELSE 'o|' || p END AS slot,
      CASE WHEN kind = 'ticket' AND event_type = 'view' THEN 'repair the pump' WHEN kind = 'pr' THEN 'check' WHEN kind = 'title' THEN 'Repair the pump house wiring' ELSE '' END AS title FROM d"""
)
def classify_agents(spark, sf):
    return TP.classify_agents(_labelled_agents(spark, sf)).select("session_id", "agent_key", "kind", "key", "slot", "title")


@query(
    """WITH m AS (SELECT s_nationkey AS n, string_agg('- [done] ' || s_name, chr(10) ORDER BY s_suppkey) AS tasks FROM supplier GROUP BY 1),
    t AS (SELECT n_nationkey AS n, n_name, n_regionkey AS r FROM nation)
    SELECT t.n AS topic_id, 'I: Topic: N-' || CAST(t.n AS VARCHAR) || ' ' || n_name || chr(10) || 'Project: p' || chr(10) || 'Agents: ' || CAST(t.n + 3 AS VARCHAR) || ' (running 1, done ' || CAST(t.n AS VARCHAR) || ', failed 2)'
      || coalesce(chr(10) || 'Sub-agent tasks:' || chr(10) || tasks, '') || CASE WHEN r > 1 THEN chr(10) || 'Latest actions:' || chr(10) || '- a' || chr(10) || '- b' ELSE '' END
      || CASE WHEN r > 2 THEN chr(10) || 'Touched modules: m, n' ELSE '' END AS prompt FROM t LEFT JOIN m USING (n)"""
)
def prompt_rows(spark, sf):
    n = table(spark, sf, "nation")
    words = lambda least, *w: F.when(F.col("n_regionkey") > least, F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>"))
    topics = n.select(
        F.col("n_nationkey").alias("topic_id"), F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("title"), F.lit("p").alias("project"), (F.col("n_nationkey") + 3).alias("total"),
        F.lit(1).alias("running"), F.col("n_nationkey").alias("done"), F.lit(2).alias("failed"), words(1, "a", "b").alias("recent"), words(2, "m", "n").alias("modules"),
    )
    members = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("topic_id"), F.lit(False).alias("is_main"), F.lit("done").alias("state"), F.col("s_name").alias("label"), F.col("s_suppkey").alias("place"))
    return TP.prompt_rows(topics, members, TP.LABELS | {"instruction": "I: "})
