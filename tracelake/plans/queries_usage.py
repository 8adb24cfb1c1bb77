"""Usage, cost, joins on calls and agents over the driver tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.operators import events as E
from tracelake.operators import pricing as P
from tracelake.operators import sessions as S
from tracelake.operators import usage as U
from tracelake.operators.segments import running_total
from tracelake.plans.binding import DAY_MS, EVENTS_SQL, NOW, event_lines, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _usage_lines(spark: SparkSession, sf: str) -> DataFrame:
    e = event_lines(spark, sf)
    named = F.when(F.col("event_type") == "view", F.concat(F.lit("model-"), (F.col("k") % 7).cast("string")))
    return e.withColumn("model", named)


_MODEL = "CASE WHEN event_type = 'view' THEN 'model-' || CAST(k % 7 AS VARCHAR) END"


@query(
    f"""WITH {EVENTS_SQL}, carried AS (
      SELECT *, coalesce(last_value({_MODEL} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'unknown') AS model FROM ev),
    won AS (SELECT * FROM carried WHERE event_type NOT IN ('error', 'signup')
      QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id DESC) = 1)
    SELECT user_id, model, CAST(count(*) AS BIGINT) AS messages, CAST(sum(units) AS BIGINT) AS input, CAST(sum(k) AS BIGINT) AS output
    FROM won GROUP BY 1, 2"""
)
def usage_last_wins(spark, sf):
    lines = U.with_carried_model(_usage_lines(spark, sf), order="event_id", partition=["user_id"])
    counted = lines.where(~F.col("event_type").isin("error", "signup"))
    won = U.dedup_usage(counted, "k", "event_id", "last", ["user_id"])
    return won.groupBy("user_id", "model").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("units").alias("input"), F.sum("k").alias("output")
    )


@query(
    f"""WITH {EVENTS_SQL}, won AS (SELECT * FROM ev WHERE event_type NOT IN ('error', 'signup')
      QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1)
    SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS messages, CAST(sum(units) AS BIGINT) AS input FROM won GROUP BY 1, 2"""
)
def usage_first_wins(spark, sf):
    counted = event_lines(spark, sf).where(~F.col("event_type").isin("error", "signup"))
    won = U.dedup_usage(counted, "k", "event_id", "first", ["user_id"])
    return won.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("messages"), F.sum("units").alias("input"))


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    """A running total per user that restarts every day, as a log would record it."""
    e = event_lines(spark, sf).withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    t = running_total(e, ["user_id", "day"], "event_id", F.col("units"), "input")
    return running_total(t, ["user_id", "day"], "event_id", F.col("k"), "output").select("user_id", "event_id", "ts_ms", "input", "output")


_TOTALS_SQL = """totals AS (SELECT user_id, event_id,
        CAST(sum(units) OVER w AS BIGINT) AS input, CAST(sum(k) OVER w AS BIGINT) AS output
      FROM ev WINDOW w AS (PARTITION BY user_id, ts_ms // 86400000 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    prior AS (SELECT *, lag(input) OVER v AS pi, lag(output) OVER v AS po FROM totals WINDOW v AS (PARTITION BY user_id ORDER BY event_id)),
    deltas AS (SELECT user_id, event_id,
        CASE WHEN pi IS NULL OR input < pi OR output < po THEN input ELSE input - pi END AS input,
        CASE WHEN pi IS NULL OR input < pi OR output < po THEN output ELSE output - po END AS output FROM prior)"""


@query(
    f"""WITH {EVENTS_SQL}, {_TOTALS_SQL}
    SELECT user_id, CAST(count(*) AS BIGINT) AS steps, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
    FROM deltas WHERE input + output > 0 GROUP BY 1"""
)
def usage_counter_delta(spark, sf):
    d = U.usage_from_totals(_totals(spark, sf), ["input", "output"], ["user_id"], "event_id")
    return d.groupBy("user_id").agg(F.count(F.lit(1)).alias("steps"), F.sum("input").alias("input"), F.sum("output").alias("output"))


@query(
    f"""WITH {EVENTS_SQL}, {_TOTALS_SQL}, first AS (
      SELECT user_id, event_id, units AS input, k AS output FROM ev WHERE event_type = 'purchase' AND units > 25000
      QUALIFY row_number() OVER (PARTITION BY user_id, k ORDER BY event_id) = 1),
    chosen AS (SELECT user_id, 'record' AS src, input, output FROM first UNION ALL
      SELECT user_id, 'counter', input, output FROM deltas WHERE input + output > 0 AND user_id NOT IN (SELECT user_id FROM first))
    SELECT user_id, src, CAST(count(*) AS BIGINT) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output
    FROM chosen GROUP BY 1, 2"""
)
def usage_source_choice(spark, sf):
    e = event_lines(spark, sf).where((F.col("event_type") == "purchase") & (F.col("units") > 25000))
    records = U.dedup_usage(e, "k", "event_id", "first", ["user_id"]).select(
        "user_id", F.lit("record").alias("src"), F.col("units").alias("input"), F.col("k").alias("output")
    )
    counters = U.usage_from_totals(_totals(spark, sf), ["input", "output"], ["user_id"], "event_id")
    counters = counters.select("user_id", F.lit("counter").alias("src"), "input", "output")
    return (
        U.choose_usage(records, counters, ["user_id"])
        .groupBy("user_id", "src")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("input").alias("input"), F.sum("output").alias("output"))
    )


@query(
    f"""WITH {EVENTS_SQL}, u AS (SELECT user_id, event_type AS model, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
      units AS input, k AS output FROM ev)
    SELECT concat_ws(',', CASE WHEN grouping(user_id) = 0 THEN 'user_id' END, CASE WHEN grouping(model) = 0 THEN 'model' END,
        CASE WHEN grouping(day) = 0 THEN 'day' END) AS grouping_key, user_id, model, day,
      CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(count(*) AS BIGINT) AS messages
    FROM u GROUP BY GROUPING SETS ((user_id, model), (user_id), (model, day))"""
)
def usage_rollup_sets(spark, sf):
    from tracelake.functions.text import local_day

    u = event_lines(spark, sf).select(
        "user_id", F.col("event_type").alias("model"), local_day("ts_ms").alias("day"), F.col("units").alias("input"), F.col("k").alias("output")
    )
    return U.usage_rollup(u, [["user_id", "model"], ["user_id"], ["model", "day"]], ["input", "output"])


def _lineitem_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as per-model usage: the brand number picks a model, of which only some have a price."""
    p = table(spark, sf, "part").select("p_partkey", F.regexp_extract("p_brand", "(\\d+)$", 1).alias("b"))
    name = F.concat(F.lit(" Anthropic/claude-opus-4-"), F.col("b"), F.lit("[1m]"))
    li = table(spark, sf, "lineitem").select(
        "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("q"), F.round(F.col("l_extendedprice")).cast("bigint").alias("x")
    )
    # the usage is summed per part first: the join then moves one row per (part, supplier)
    u = li.groupBy("l_partkey", "l_suppkey").agg(F.sum("q").alias("q"), F.sum("x").alias("x"))
    return u.join(p, u.l_partkey == p.p_partkey).select(
        F.col("l_suppkey").alias("agent_key"),
        name.alias("model"),
        F.col("x").alias("input"),
        F.col("q").alias("output"),
        (F.col("q") * 2).alias("cache_read"),
        F.col("x").alias("cache_create"),
        F.col("q").alias("cache_create_1h"),
    )


# fixed values: prices of three models in millionths of a dollar per million tokens, as in operators/pricing.py
_COST_SQL = """prices AS (SELECT * FROM (VALUES
      (0, '^claude-opus-4-[5-8](-[0-9]{8})?$', 5000000, 25000000, 6250000, 10000000, 500000),
      (1, '^claude-opus-4-1(-[0-9]{8})?$', 15000000, 75000000, 18750000, 30000000, 1500000),
      (2, '^claude-opus-4(-[0-9]{8})?$', 15000000, 75000000, 18750000, 30000000, 1500000)) t(entry, re, pi, po, pw, ph, pr)),
    u AS (SELECT l_suppkey AS agent_key, regexp_replace(regexp_replace(lower(trim(' Anthropic/claude-opus-4-' || regexp_extract(p_brand, '([0-9]+)$', 1) || '[1m]')),
        '^anthropic/', ''), '\\[[^\\]]*\\]$', '') AS model,
        CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS BIGINT) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
    priced AS (SELECT u.*, p.* FROM u LEFT JOIN prices p ON regexp_matches(u.model, p.re)
      QUALIFY row_number() OVER (PARTITION BY agent_key, model ORDER BY entry) = 1),
    costs AS (SELECT agent_key, CAST(sum(x * 2 + q * 3) AS BIGINT) AS total_tokens,
      CAST(coalesce(sum(x * pi + q * po + (x - q) * CAST(pw AS HUGEINT) + q * ph + 2 * q * pr), 0) AS DOUBLE) / 1e6 / 1e6 AS cost_usd,
      bool_or(pi IS NULL) AS cost_partial FROM priced GROUP BY 1)"""


@query(f"WITH {_COST_SQL} SELECT agent_key, cost_usd, cost_partial FROM costs")
def cost_by_model(spark, sf):
    return P.cost(_lineitem_usage(spark, sf), P.price_table(spark), ["agent_key"])


@query(
    f"""WITH {_COST_SQL}, m AS (SELECT s_nationkey AS session_id, agent_key, total_tokens, cost_usd, cost_partial FROM costs JOIN supplier ON agent_key = s_suppkey),
    t AS (SELECT *, bool_or(cost_partial) OVER w AND max(cost_usd) OVER w = 0 AS by_tokens FROM m WINDOW w AS (PARTITION BY session_id)),
    r AS (SELECT *, CASE WHEN by_tokens THEN CAST(total_tokens AS DOUBLE) ELSE cost_usd END AS metric FROM t)
    SELECT session_id, agent_key, metric, CAST(row_number() OVER (PARTITION BY session_id ORDER BY metric DESC, agent_key) AS INTEGER) AS place FROM r
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY metric DESC, agent_key) <= 12"""
)
def cost_ranking(spark, sf):
    u = _lineitem_usage(spark, sf)
    money = P.cost(u, P.price_table(spark), ["agent_key"], tokens=True)
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("agent_key"), F.col("s_nationkey").alias("session_id"))
    nodes = money.join(sup, "agent_key")
    return S.cost_ranking(nodes).select("session_id", "agent_key", "metric", "place")


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, CAST(sum(units + k) AS BIGINT) AS output_today,
      CAST(sum(units) AS DOUBLE) / 100 AS cost_today FROM ev WHERE event_type = 'view' AND ts_ms >= {NOW - 3 * DAY_MS} GROUP BY 1"""
)
def json_today(spark, sf):
    e = event_lines(spark, sf)
    role = F.when(F.col("event_type") == "view", F.lit("assistant")).otherwise(F.lit("user"))
    tokens = F.struct(F.col("units").alias("output"), F.col("k").alias("reasoning"))
    data = F.to_json(F.struct(role.alias("role"), tokens.alias("tokens"), (F.col("units") / 100).alias("cost")))
    return U.json_usage_today(e.select("user_id", F.col("ts_ms").alias("time_created"), data.alias("data")), NOW - 3 * DAY_MS, ["user_id"])


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "tool_use").when(F.col("event_type") == "purchase", "tool_result").otherwise(F.col("event_type"))
    return event_lines(spark, sf).select("user_id", kind.alias("kind"), F.col("k").alias("tool_use_id"), "event_id", "units")


@query(
    f"""WITH {EVENTS_SQL}, p AS (SELECT user_id, k AS tool_use_id,
      max(event_id) FILTER (WHERE event_type = 'click') AS use_id, min(event_id) FILTER (WHERE event_type = 'purchase') AS result_id,
      arg_min(units, event_id) FILTER (WHERE event_type = 'purchase') AS result_units FROM ev GROUP BY 1, 2)
    SELECT * FROM p WHERE use_id IS NOT NULL"""
)
def tool_pairing(spark, sf):
    pairs = E.pair_calls(_calls(spark, sf), ["user_id"], order="event_id")
    return pairs.select(
        "user_id",
        "tool_use_id",
        F.col("use.event_id").alias("use_id"),
        F.col("result.event_id").alias("result_id"),
        F.col("result.units").alias("result_units"),
    )


@query(
    f"""WITH {EVENTS_SQL} SELECT user_id, k AS tool_use_id, max(event_id) AS use_id FROM ev WHERE event_type = 'click'
      AND (user_id, k) NOT IN (SELECT (user_id, k) FROM ev WHERE event_type = 'purchase') GROUP BY 1, 2"""
)
def pending_calls(spark, sf):
    return E.pending_calls(_calls(spark, sf), ["user_id"], order="event_id").select(
        "user_id", "tool_use_id", F.col("use.event_id").alias("use_id")
    )


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT user_id, max(ts_ms) FILTER (WHERE event_type <> 'signup') AS last_ts FROM ev GROUP BY 1),
    n AS (SELECT user_id, ts_ms AS note_ts, 'k' || CAST(k AS VARCHAR) AS note_status FROM ev WHERE event_type = 'signup'
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, event_id DESC) = 1)
    SELECT a.user_id, last_ts, CASE WHEN coalesce(last_ts, 0) <= note_ts + 7200000 THEN note_ts END AS note_ts,
      CASE WHEN coalesce(last_ts, 0) <= note_ts + 7200000 THEN note_status END AS note_status FROM a LEFT JOIN n USING (user_id)"""
)
def asof_notification(spark, sf):
    e = event_lines(spark, sf)
    agents = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "signup", F.col("ts_ms"))).alias("last_ts"))
    notes = e.where(F.col("event_type") == "signup").select(
        "user_id", "ts_ms", F.col("event_id").alias("ord"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("status"), F.lit("").alias("summary")
    )
    return S.notification_asof(agents, notes, ["user_id"], 7_200_000).select("user_id", "last_ts", "note_ts", "note_status")


@query(
    f"""WITH {EVENTS_SQL}, a AS (SELECT DISTINCT user_id, k FROM ev),
    l AS (SELECT user_id, k, arg_max(units % 100, event_id) AS tool FROM ev WHERE event_type = 'purchase' GROUP BY 1, 2),
    s AS (SELECT user_id, units % 100 AS tool, arg_max(k, event_id) AS owner, arg_max(units, event_id) AS spawn_units FROM ev WHERE event_type = 'click' GROUP BY 1, 2)
    SELECT CAST(a.user_id AS VARCHAR) AS session_id, CAST(a.k AS VARCHAR) AS agent_key, CAST(l.tool AS VARCHAR) AS tool_use_id, spawn_units,
      CASE WHEN owner <> a.k AND o.k IS NOT NULL THEN CAST(owner AS VARCHAR) ELSE 'main' END AS parent_key
    FROM a LEFT JOIN l ON a.user_id = l.user_id AND a.k = l.k LEFT JOIN s ON a.user_id = s.user_id AND l.tool = s.tool
      LEFT JOIN a o ON o.user_id = a.user_id AND o.k = s.owner"""
)
def spawn_parent(spark, sf):
    e = event_lines(spark, sf).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("k").cast("string").alias("agent_key"),
        (F.col("units") % 100).cast("string").alias("tool_use_id"), F.col("event_id").alias("ord"), "event_type", "units",
    )
    agents = e.select("session_id", "agent_key").distinct().withColumn("meta_tool_use_id", F.lit(None).cast("string"))
    links = e.where(F.col("event_type") == "purchase").select("session_id", "agent_key", "tool_use_id", "ord")
    spawns = e.where(F.col("event_type") == "click").select(
        "session_id", "tool_use_id", F.col("agent_key").alias("owner_key"), F.struct("units").alias("spawn"), "ord"
    )
    out = S.resolve_parents(agents, spawns, links)
    return out.select("session_id", "agent_key", "tool_use_id", F.col("spawn.units").alias("spawn_units"), "parent_key")


@query(
    f"""WITH {EVENTS_SQL}, s AS (SELECT user_id, max(ts_ms) AS last_at FROM ev GROUP BY 1),
    r AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'O' AS alive, o_orderpriority AS status FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'O') DESC, o_orderkey DESC) = 1)
    SELECT coalesce(user_id, o_custkey) AS session_id, coalesce(alive, false) AS live, user_id IS NOT NULL AS has_transcript,
      CASE WHEN alive THEN status END AS status, coalesce(last_at, 0) AS last_activity_at
    FROM s FULL JOIN r ON user_id = o_custkey WHERE user_id IS NOT NULL OR alive"""
)
def registry_join(spark, sf):
    e = event_lines(spark, sf)
    nodes = e.groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts_ms").alias("last_activity_at")).withColumns(
        {
            "layout": F.lit("line_log"), "is_main": F.lit(True), "state": F.lit("done"), "model": F.lit(None).cast("string"),
            "started_at": F.lit(None).cast("bigint"), "cost_usd": F.lit(0.0), "cost_partial": F.lit(False),
        }
    )
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"), (F.col("o_orderstatus") == "O").alias("alive"), F.col("o_orderpriority").alias("status"),
        F.col("o_orderkey").alias("file_ord"), F.lit("/w").alias("cwd"), F.lit(None).cast("bigint").alias("updated_at"), F.lit(None).cast("bigint").alias("started_at"),
    )
    fields = nodes.select("session_id", F.lit("/w").alias("cwd"))
    out = S.session_summary(nodes, fields, S.registry_latest(o))
    return out.select("session_id", "live", "has_transcript", "status", "last_activity_at")


_PARENTS = """n AS (SELECT p_partkey AS id, CASE WHEN p_size > 25 THEN p_partkey // 3 END AS edge,
      CASE WHEN p_size % 5 = 0 THEN p_partkey + 100000000 WHEN p_size > 10 THEN p_partkey // 5 END AS idx, p_partkey - 1 AS meta FROM part)"""


@query(
    f"""WITH {_PARENTS}, c AS (SELECT id, coalesce(edge, idx, meta) AS p FROM n)
    SELECT c.id, CASE WHEN p <> c.id AND k.id IS NOT NULL THEN p END AS parent FROM c LEFT JOIN n k ON k.id = c.p"""
)
def parent_precedence(spark, sf):
    s = F.col("p_size")
    n = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.when(s > 25, F.expr("p_partkey div 3")).cast("string").alias("edge"),
        F.when(s % 5 == 0, F.col("p_partkey") + 100000000).when(s > 10, F.expr("p_partkey div 5")).cast("string").alias("idx"),
        (F.col("p_partkey") - 1).cast("string").alias("meta"),
    )
    out = S.first_known_parent(n, ["edge", "idx", "meta"])
    return out.select(F.col("id").cast("bigint").alias("id"), F.col("parent").cast("bigint").alias("parent"))


@query(
    """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderstatus = 'P' THEN CAST(o_custkey AS VARCHAR) END AS parent,
      CASE WHEN o_orderpriority <> '1-URGENT' THEN 'b' || CAST(o_custkey AS VARCHAR) END AS battle_id,
      CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS VARCHAR) END AS winner, epoch_ms(o_orderdate) AS last FROM orders),
    g AS (SELECT *, count(*) OVER (PARTITION BY battle_id) AS n FROM r WHERE battle_id IS NOT NULL AND parent IS NULL),
    p AS (SELECT battle_id, id AS prim FROM g WHERE n >= 2
      QUALIFY row_number() OVER (PARTITION BY battle_id ORDER BY (winner IS NOT NULL) DESC, last DESC, id) = 1),
    z AS (SELECT battle_id, count(*) AS sz FROM r WHERE battle_id IS NOT NULL GROUP BY 1)
    SELECT r.id, CASE WHEN r.parent IS NULL AND prim IS NOT NULL AND prim <> r.id THEN prim ELSE r.parent END AS effective_parent,
      coalesce(sz > 1, false) AS in_battle, coalesce(r.battle_id IS NOT NULL AND r.winner IS NOT NULL, false) AS is_winner
    FROM r LEFT JOIN p USING (battle_id) LEFT JOIN z USING (battle_id)"""
)
def battle_groups(spark, sf):
    k = F.col("o_orderkey").cast("string")
    r = table(spark, sf, "orders").select(
        k.alias("id"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_custkey").cast("string")).alias("parent"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("b"), F.col("o_custkey").cast("string"))).alias("battle_id"),
        F.when(F.col("o_orderstatus") == "F", k).alias("winner"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("last"),
    )
    return S.battle_groups(r).select("id", "effective_parent", "in_battle", "is_winner")


@query(
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)
    SELECT page_id, regexp_extract(path, '^(/[^/]+)', 1) AS project_dir FROM p WHERE regexp_extract(path, '^(/[^/]+)', 1) <> ''"""
)
def path_hash(spark, sf):
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    top = F.regexp_extract(path, "^(/[^/]+)", 1)
    calls = table(spark, sf, "pages").select("page_id", path.alias("path"), F.sha2(top, 256).alias("project_hash"), F.lit(0).alias("ord"))
    return S.resolve_project_dir(calls, ["page_id"])


