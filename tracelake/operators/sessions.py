"""Agents and sessions: facts, parents, summaries, machine counters, provider health.

The neutral node table has one row per agent:
``layout, session_id, agent_key, is_main, state, started_at, last_ts, last_activity_at, ended_at`` plus
what a layout knows.  Usage lives in a second table keyed by (session_id, agent_key, model, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.functions.text import local_day, nz
from tracelake.operators.pricing import COUNTERS, cost, micro_usd, price_models, token_total, usd, with_counters
from tracelake.session import cut_lineage

# --- fixed values ---------------------------------------------------------------------------------
#: States that count as "finished today", per layout.
FINISHED_STATES = {
    "line_log": ("done", "failed", "stopped"),
    "rollout": ("done", "stopped"),
    "part_store": ("done", "stopped", "failed"),
    "document": (),
    "chain_store": ("done", "stopped", "failed"),
    "summary_table": ("done", "stopped"),
}
STATE_RANK = {"running": 0, "stalled": 1, "idle": 2, "failed": 3, "stopped": 4, "done": 5}
TOP_BARS = 12
# --- end of fixed values --------------------------------------------------------------------------


def agent_facts(lines: DataFrame, by: Sequence[str] = ("session_id", "agent_key")) -> DataFrame:
    """First and last time, last role and stop reason, model and tool calls of every agent.

    Needs ``ord, ts_ms, type, role, stop_reason, model, tool_calls, last_tool``.  All of them combine
    map-side.
    """
    has_role = F.col("role").isNotNull()
    assistant = F.col("role") == "assistant"
    when = lambda cond: F.when(cond, F.col("ord"))
    return lines.groupBy(*by).agg(
        F.min("ts_ms").alias("first_ts"),
        F.max("ts_ms").alias("last_ts"),
        F.max_by("role", when(has_role)).alias("last_role"),
        F.max_by(F.when(assistant, F.col("stop_reason")), when(has_role)).alias("last_stop"),
        F.max_by("model", when(assistant & F.col("model").isNotNull())).alias("model"),
        F.coalesce(F.sum(F.when(assistant, F.col("tool_calls"))), F.lit(0)).cast("bigint").alias("tool_calls"),
        F.max_by("last_tool", when(assistant & F.col("last_tool").isNotNull())).alias("last_tool"),
        F.max_by("last_action", when(assistant & F.col("last_action").isNotNull())).alias("last_action")
        if "last_action" in lines.columns
        else F.lit(None).cast("string").alias("last_action"),
    )


def session_fields(main_lines: DataFrame, first: Sequence[str] = ("cwd",), last: Sequence[str] = ()) -> DataFrame:
    """Per session the first non-empty value of some columns and the last non-empty value of others."""
    keep = lambda c: F.when(nz(c).isNotNull(), F.col("ord"))
    return main_lines.groupBy("session_id").agg(
        *[F.min_by(F.col(c), keep(c)).alias(c) for c in first], *[F.max_by(F.col(c), keep(c)).alias(c) for c in last]
    )


def resolve_parents(agents: DataFrame, spawns: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``tool_use_id``, the spawn record and ``parent_key`` to the agents of each session.

    ``agents``: session_id, agent_key, meta_tool_use_id.  ``spawns``: session_id, tool_use_id, owner_key,
    spawn (struct), ord.  ``links``: session_id, agent_key, tool_use_id, ord.  The latest spawn and link
    win; the owner must be a known other agent of the session, else the parent is ``main``.
    """
    link = links.groupBy("session_id", "agent_key").agg(F.max_by("tool_use_id", "ord").alias("__linked"))
    spawn = spawns.groupBy("session_id", "tool_use_id").agg(
        F.max_by(F.struct("owner_key", "spawn"), "ord").alias("__spawn")
    )
    named = agents.join(link, ["session_id", "agent_key"], "left").withColumn(
        "tool_use_id", F.coalesce(nz("meta_tool_use_id"), "__linked")
    )
    owned = named.drop("__linked").join(spawn, ["session_id", "tool_use_id"], "left")
    owned = owned.withColumns({"__owner": F.col("__spawn.owner_key"), "spawn": F.col("__spawn.spawn")}).drop("__spawn")
    known = agents.select("session_id", F.col("agent_key").alias("__owner")).distinct().withColumn("__known", F.lit(True))
    checked = owned.join(known, ["session_id", "__owner"], "left")
    parent = F.when(
        (F.col("__owner") != F.col("agent_key")) & (F.coalesce("__known", F.lit(False)) | (F.col("__owner") == "main")),
        F.col("__owner"),
    ).otherwise(F.lit("main"))
    return checked.withColumn(
        "parent_key", F.when(F.col("agent_key") != "main", F.coalesce(parent, F.lit("main")))
    ).drop("__owner", "__known")


def first_known_parent(nodes: DataFrame, candidates: Sequence[str], id: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """``parent`` from the first non-empty candidate column; it must be a known, other node."""
    from tracelake.operators.tree import valid_parents

    picked = nodes.withColumn("parent", F.coalesce(*[nz(c) for c in candidates]))
    return valid_parents(picked, id, "parent", by)


def registry_latest(registry: DataFrame, order: str = "file_ord") -> DataFrame:
    """One registry row per session: a live one when there is any, the later one among equals."""
    rest = [c for c in registry.columns if c != "session_id"]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("alive", F.lit(False)), F.col(order)))
    return registry.groupBy("session_id").agg(best.alias("__r")).select("session_id", *[F.col(f"__r.{c}").alias(c) for c in rest])


def usage_totals(usage: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = with_counters(usage).groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in COUNTERS])
    return sums.withColumn("total_tokens", token_total().cast("bigint"))


def node_usage(nodes: DataFrame, usage: DataFrame, prices: DataFrame, layout: str | None = "layout") -> DataFrame:
    """Nodes with their own usage and cost (zero without usage)."""
    key = ["session_id", "agent_key"]
    totals = usage_totals(usage, key)
    money = cost(usage, prices, key, layout=layout if layout in usage.columns else None)
    out = nodes.join(totals, key, "left").join(money, key, "left")
    counters = [c for c in (*COUNTERS, "total_tokens") if c in totals.columns]
    return out.fillna(0, subset=counters).fillna(0.0, subset=["cost_usd"]).fillna(False, subset=["cost_partial"])


def session_summary(nodes: DataFrame, fields: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One row per session from its nodes with usage (:func:`node_usage`) and its own fields.

    ``fields`` carries what is known per session (name parts, cwd, branch, ...).  With a registry, live
    sessions without a log are added.
    """
    sub = ~F.col("is_main")
    counters = [c for c in (*COUNTERS, "total_tokens") if c in nodes.columns]
    micro = F.round(F.col("cost_usd") * 1e6, 6).cast("decimal(28,6)")
    rolled = nodes.groupBy("layout", "session_id").agg(
        *[F.sum(c).alias(c) for c in counters],
        usd(F.sum(micro)).alias("cost_usd"),
        F.bool_or("cost_partial").alias("cost_partial"),
        F.count_if(sub).alias("agent_count"),
        F.count_if(sub & (F.col("state") == "running")).alias("running_agents"),
        F.min("started_at").alias("first_activity_at"),
        F.max("last_activity_at").alias("last_activity_at"),
        F.max(F.when(~sub, F.col("state"))).alias("root_state"),
        F.max(F.when(~sub, F.col("model"))).alias("model"),
    )
    out = rolled.join(fields, "session_id", "left")
    if registry is None:
        live = F.col("root_state").isin("running", "idle") | (F.col("running_agents") > 0)
        busy = F.when(F.col("root_state") == "running", F.lit("busy")).otherwise(F.lit("idle"))
        return out.withColumns({"live": live, "status": F.when(live, busy), "has_transcript": F.lit(True)})
    reg = registry.select("session_id", *[F.col(c).alias(f"reg_{c}") for c in registry.columns if c != "session_id"])
    joined = out.join(reg, "session_id", "left").withColumn("has_transcript", F.lit(True))
    # live sessions that have no log yet
    only = reg.where(F.col("reg_alive")).join(rolled.select("session_id"), "session_id", "left_anti")
    only = only.withColumns(
        {
            "layout": F.lit("line_log"),
            "has_transcript": F.lit(False),
            "cwd": F.col("reg_cwd"),
            "last_activity_at": F.coalesce("reg_updated_at", "reg_started_at", F.lit(0)),
            **{c: F.lit(0).cast("bigint") for c in (*counters, "agent_count", "running_agents")},
            "cost_usd": F.lit(0.0),
            "cost_partial": F.lit(False),
        }
    )
    both = joined.unionByName(only, allowMissingColumns=True)
    live = F.coalesce("reg_alive", F.lit(False))
    return both.withColumns({"live": live, "status": F.when(live, F.col("reg_status"))})


def order_sessions(sessions: DataFrame) -> DataFrame:
    """Live sessions first, then the latest activity."""
    return sessions.orderBy(*session_order())


def session_order() -> list[Column]:
    return [F.col("live").desc(), F.col("last_activity_at").desc(), F.col("session_id").asc()]


def with_place(rows: DataFrame, order: Sequence[Column], as_: str = "place") -> DataFrame:
    """Number all rows in display order without gathering them: sorted by range, counted per part, offsets added."""
    mask = F.lit((1 << 33) - 1)
    placed = rows.orderBy(*order).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id().bitwiseAND(mask)})
    placed = cut_lineage(placed)
    # one row per partition
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    out = placed.join(sizes, "__part").withColumn(as_, (F.col("__before") + F.col("__row") + 1).cast("int"))
    return out.drop("__part", "__row", "__before")


def live_rail(sessions: DataFrame) -> DataFrame:
    """Live sessions, newest start first."""
    return sessions.where("live").orderBy(F.col("started_at").desc_nulls_last(), "session_id")


def recent_sessions(sessions: DataFrame, now: int, recent_ms: int = 86_400_000, at: str = "last_activity_at") -> DataFrame:
    return sessions.where(F.col("live") | (F.lit(now) - F.col(at) <= recent_ms))


def machine_summary(
    nodes: DataFrame, usage: DataFrame, prices: DataFrame, now: int, tz: str = "UTC", registry: DataFrame | None = None
) -> DataFrame:
    """Counters per layout and (``layout`` null) over all of them.

    The line log counts live registry rows; the other layouts count live sessions.
    """
    today = F.lit(local_day_of(nodes, now, tz))
    finished = F.lit(False)
    for layout, states in FINISHED_STATES.items():
        if states:
            finished = finished | ((F.col("layout") == layout) & F.col("state").isin(*states))
    sub = ~F.col("is_main")
    agents = nodes.groupBy("layout").agg(
        F.count_if(F.col("state") == "running").alias("running_agents"),
        F.count_if(sub & finished & (local_day("last_ts", tz) == today)).alias("finished_today"),
    )
    live = nodes.groupBy("layout", "session_id").agg(
        F.bool_or((F.col("is_main") & F.col("state").isin("running", "idle")) | (sub & (F.col("state") == "running"))).alias("live")
    )
    live = live.where(F.col("live") & (F.col("layout") != "line_log") if registry is not None else F.col("live"))
    sessions = live.groupBy("layout").agg(F.count(F.lit(1)).alias("live_sessions"))
    if registry is not None:
        sessions = sessions.unionByName(
            registry.where("alive").groupBy(F.lit("line_log").alias("layout")).agg(F.count(F.lit(1)).alias("live_sessions"))
        )
    spent = price_models(
        with_counters(usage).where(F.col("day") == today)
        .groupBy("layout", "model")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS]),
        prices,
        layout="layout",
    )
    money = spent.groupBy("layout").agg(
        F.sum("output").cast("bigint").alias("output_today"),
        F.coalesce(F.sum(micro_usd()), F.lit(0)).cast("decimal(38,6)").alias("__micro"),
    )
    joined = agents.join(sessions, "layout", "full_outer").join(money, "layout", "full_outer")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return joined.rollup("layout").agg(
        total("live_sessions"),
        total("running_agents"),
        total("finished_today"),
        total("output_today"),
        usd(F.coalesce(F.sum("__micro"), F.lit(0).cast("decimal(38,6)"))).alias("cost_today"),
    )


def local_day_of(df: DataFrame, now: int, tz: str) -> str:
    """The calendar day of ``now`` (plain Python: it is one constant)."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    return datetime.fromtimestamp(now / 1000, ZoneInfo(tz)).strftime("%Y-%m-%d")


# fixed values: what each layout can show
CAPABILITIES = {
    "line_log": dict(transcript=True, tokens=True, tools=True, subagents=True, cost=True),
    "rollout": dict(transcript=True, tokens=True, tools=True, subagents=True, cost=True),
    "part_store": dict(transcript=True, tokens=True, tools=True, subagents=True, cost=True),
    "document": dict(transcript=True, tokens=True, tools=True, subagents=False, cost=False),
    "chain_store": dict(transcript=True, tokens=False, tools=True, subagents=True, cost=False),
    "summary_table": dict(transcript=False, tokens=False, tools=False, subagents=True, cost=False),
}


def provider_status(sessions: DataFrame, usage: DataFrame, prices: DataFrame, shown: int | None = None) -> DataFrame:
    """One health row per layout: sessions, live ones, last activity, capabilities, model price lists.

    Model lists come from the distinct models, in order of their names; with ``shown`` they hold the first so
    many, and the full number stands beside them.
    """
    health = sessions.groupBy("layout").agg(
        F.count(F.lit(1)).alias("sessions"), F.count_if("live").alias("active"), F.max("last_activity_at").alias("last_activity_at")
    )
    models = price_models(
        with_counters(usage).where(token_total() > 0).groupBy("layout", "model").agg(F.lit(1).alias("__one")), prices, layout="layout"
    )
    kind = (
        F.when(F.col("p_input").isNull(), "unpriced").when(F.col("verified"), "verified").otherwise("estimated").alias("kind")
    )
    named = models.select("layout", F.coalesce("price_model", "model").alias("name"), kind).distinct()
    if shown is None:
        ranked = named.withColumn("__r", F.lit(0))
    else:
        ranked = named.withColumn("__r", F.row_number().over(Window.partitionBy("layout", "kind").orderBy("name")))
    lists = ranked.groupBy("layout").agg(
        *[
            agg
            for k in ("verified", "estimated", "unpriced")
            for agg in (
                F.array_sort(F.collect_list(F.when((F.col("kind") == k) & (F.col("__r") <= F.lit(shown or 0)), F.col("name")))).alias(k),
                F.count_if(F.col("kind") == k).alias(f"n_{k}"),
            )
        ]
    )
    note = (
        F.when(
            F.col("n_estimated") > 0,
            F.concat(
                F.lit("official prices · estimated: "),
                F.array_join("estimated", ", "),
                F.when(F.col("n_estimated") > F.lit(shown), F.concat(F.lit(" +"), (F.col("n_estimated") - F.lit(shown)).cast("string"))).otherwise(F.lit("")),
            ),
        )
        .when(F.col("n_verified") > 0, F.lit("official prices"))
        .otherwise(F.lit("price table"))
    )
    caps = F.create_map(
        *[
            x
            for layout, c in CAPABILITIES.items()
            for x in (F.lit(layout), F.struct(*[F.lit(v).alias(k) for k, v in c.items()]))
        ]
    )
    out = health.join(lists, "layout", "left")
    return out.withColumn("capabilities", F.try_element_at(caps, F.col("layout"))).withColumn("pricing_note", note)


def running_now(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """Running agents of live sessions: mains while running, sub-agents while running or stalled; ``place`` orders them."""
    live = sessions.where("live").select("session_id", "session_name", "cwd")
    busy = F.when(F.col("is_main"), F.col("state") == "running").otherwise(F.col("state").isin("running", "stalled"))
    rows = nodes.where(busy).join(live, "session_id")
    w = Window.partitionBy("session_id").orderBy(
        F.col("is_main").desc(), (F.col("state") == "stalled").asc(), F.coalesce("started_at", F.lit(0)), "agent_key"
    )
    return rows.withColumn("place", F.row_number().over(w))


def finished_today(nodes: DataFrame, sessions: DataFrame, now: int, tz: str = "UTC", limit: int | None = None) -> DataFrame:
    """Sub-agents that ended today, newest first (of these the first ``limit``, if given)."""
    day = local_day_of(nodes, now, tz)
    end = F.coalesce("ended_at", "last_activity_at")
    rows = nodes.where(~F.col("is_main") & F.col("state").isin("done", "stopped", "failed") & (local_day(end, tz) == day))
    rows = rows.withColumn("ended_at", end).join(sessions.select("session_id", "session_name"), "session_id")
    out = rows.orderBy(F.col("ended_at").desc(), "session_id", "agent_key")
    return out.limit(limit) if limit else out


def now_snapshot(nodes: DataFrame, sessions: DataFrame, now: int, tz: str = "UTC") -> DataFrame:
    """One row: running agents and groups, today's finished and failed agents, newest activity."""
    run = running_now(nodes, sessions).agg(
        F.count(F.lit(1)).alias("running_agents"), F.count_distinct("session_id").alias("running_sessions")
    )
    fin = finished_today(nodes, sessions, now, tz, limit=None).agg(
        F.count_if(F.col("state") != "failed").alias("done_today"), F.count_if(F.col("state") == "failed").alias("failed_today")
    )
    last = sessions.agg(F.coalesce(F.max("last_activity_at"), F.lit(0)).alias("last_activity_at"))
    return run.join(fin, F.lit(True)).join(last, F.lit(True))


def timeline_order(nodes: DataFrame) -> DataFrame:
    """State rank, then start; nodes without a start last."""
    rank = F.coalesce(*[F.when(F.col("state") == s, F.lit(r)) for s, r in STATE_RANK.items()], F.lit(9))
    return nodes.withColumn("state_rank", rank).orderBy("session_id", "state_rank", F.col("started_at").asc_nulls_last(), "agent_key")


def cost_ranking(nodes: DataFrame, by: Sequence[str] = ("session_id",), top: int = TOP_BARS, ties: Sequence[str] = ("agent_key",)) -> DataFrame:
    """The ``top`` agents of each session by cost, by tokens where nothing is priced."""
    totals = nodes.groupBy(*by).agg(
        (F.bool_or("cost_partial") & (F.max("cost_usd") == 0)).alias("by_tokens")
    )
    rows = nodes.join(totals, list(by))
    metric = F.when(F.col("by_tokens"), F.col("total_tokens").cast("double")).otherwise(F.col("cost_usd"))
    w = Window.partitionBy(*by).orderBy(F.col("metric").desc(), *ties)
    return rows.withColumn("metric", metric).withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def battle_groups(rows: DataFrame, id: str = "id", parent: str = "parent", battle: str = "battle_id", winner: str = "winner", last: str = "last") -> DataFrame:
    """Add ``effective_parent``, ``in_battle`` and ``is_winner``.

    Rows of one battle without a parent form a group; with two or more members one is the primary (the
    flagged winner when it is a member, else the most recent) and the others hang under it.  The group
    facts come from aggregations that are joined back, so a big battle is never collected.
    """
    fight = rows.where(nz(battle).isNotNull())
    votes = fight.where(nz(winner).isNotNull()).select(battle, F.col(winner).alias(id)).distinct()
    won = votes.withColumn("__won", F.lit(True))
    root = fight.where(F.col(parent).isNull())
    # the winner that counts is one voted for by a row of the same root group
    root_votes = root.where(nz(winner).isNotNull()).select(battle, F.col(winner).alias(id)).distinct().withColumn("__root_won", F.lit(True))
    flagged = root.join(root_votes, [battle, id], "left")
    best = F.struct(F.coalesce("__root_won", F.lit(False)), F.coalesce(last, F.lit(0)))
    groups = flagged.groupBy(battle).agg(F.count(F.lit(1)).alias("__n"), F.max(best).alias("__best"))
    primaries = (
        flagged.join(groups, battle)
        .where((F.col("__n") >= 2) & (best == F.col("__best")))
        .groupBy(battle)
        .agg(F.min(id).alias("__primary"))
    )
    sizes = fight.groupBy(battle).agg(F.count(F.lit(1)).alias("__size"))
    out = rows.join(primaries, battle, "left").join(sizes, battle, "left").join(won, [battle, id], "left")
    follows = F.col(parent).isNull() & F.col("__primary").isNotNull() & (F.col("__primary") != F.col(id))
    return out.withColumns(
        {
            "effective_parent": F.when(follows, F.col("__primary")).otherwise(F.col(parent)),
            "in_battle": F.coalesce(F.col("__size") > 1, F.lit(False)),
            "is_winner": F.coalesce("__won", F.lit(False)),
        }
    ).select(*rows.columns, "effective_parent", "in_battle", "is_winner")


def resolve_project_dir(calls: DataFrame, by: Sequence[str], path: str = "path", digest: str = "project_hash", order: Sequence[str] = ("ord",)) -> DataFrame:
    """The directory whose SHA-256 is the project hash, looked for among all ancestors of argument paths."""
    parts = F.split(F.regexp_replace(F.col(path), "/+$", ""), "/")
    depth = F.size(parts)
    ups = F.transform(F.sequence(depth, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = F.transform(ups, lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    # most calls of a session repeat the same paths: hash each distinct one once
    first = calls.where(F.startswith(F.col(path), F.lit("/"))).groupBy(*by, digest, path).agg(F.min(F.struct(*order)).alias("__ord"))
    rows = first.select(*by, digest, "__ord", F.posexplode(folders).alias("__up", "project_dir"))
    hit = rows.where(F.sha2("project_dir", 256) == F.col(digest))
    return hit.groupBy(*by).agg(F.min_by("project_dir", F.struct("__ord", "__up")).alias("project_dir"))


def notification_asof(agents: DataFrame, notes: DataFrame, by: Sequence[str] = ("session_id", "agent_key"), slack_ms: int = 5_000) -> DataFrame:
    """The latest notification of each agent, if the agent did nothing more than ``slack_ms`` after it."""
    latest = notes.groupBy(*by).agg(F.max_by(F.struct(F.col("ts_ms").alias("note_ts"), F.col("status").alias("note_status"), F.col("summary").alias("note_summary")), F.struct("ts_ms", "ord")).alias("__n"))
    joined = agents.join(latest, list(by), "left")
    final = F.coalesce(F.col("last_ts"), F.lit(0)) <= F.col("__n.note_ts") + slack_ms
    return joined.withColumns(
        {c: F.when(final, F.col(f"__n.{c}")) for c in ("note_ts", "note_status", "note_summary")}
    ).drop("__n")
