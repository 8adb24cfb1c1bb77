"""The summary table: one row per conversation, no transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracelake.functions.text import clean_stored_title, display_home, mask_secrets, nz, parse_time_any, workspace_path
from tracelake.operators import sessions as S
from tracelake.operators.activity import activity_buckets
from tracelake.operators.state import end_columns, infer_state
from tracelake.operators.tree import cut_cycles, resolve_tree

LAYOUT = "summary_table"


def truthy(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")).rlike("(?i)^(1|true|t|yes)$"), F.lit(False))


def conversations(rows: DataFrame) -> DataFrame:
    """Typed rows of the summary table (see ``read_summaries``)."""
    count = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        F.col("conversation_id").alias("id"), text("title").alias("title"), text("agent_name").alias("agent_name"), text("source").alias("source"),
        count("step_count").alias("step_count"), parse_time_any("last_modified_time").alias("last_modified"), parse_time_any("last_user_input_time").alias("last_user_input"),
        workspace_path("workspace_uris").alias("workspace"), text("status").alias("status"), truthy(F.col("not_fully_idle")).alias("not_fully_idle"), truthy(F.col("killed")).alias("killed"),
        nz("parent_conversation_id").alias("parent"), count("nesting_depth").alias("nesting_depth"), nz("battle_id").alias("battle_id"), nz("winning_conversation_id").alias("winner"),
    )


def nodes(rows: DataFrame, now: int, home: str = "", recent_ms: int = 86_400_000) -> DataFrame:
    """Conversations as agent trees with battle groups; trees outside the window are dropped unless live."""
    c = conversations(rows).withColumn("last", F.coalesce("last_modified", "last_user_input", F.lit(0)))
    c = S.battle_groups(cut_cycles(c))
    c = c.withColumn("parent", F.col("effective_parent")).drop("effective_parent")
    c = infer_state(c, LAYOUT, now)
    start = F.least("last_user_input", "last_modified")
    c = c.withColumns({"layout": F.lit(LAYOUT), "started_at": start, "last_activity_at": F.nullif(F.col("last"), F.lit(0)), "last_ts": F.nullif(F.col("last"), F.lit(0))})
    c = c.withColumns(end_columns(now, ("running", "idle")))
    tree = resolve_tree(c, order=[F.col("started_at").isNull(), F.col("started_at")])
    main = F.col("parent").isNull()
    name = F.coalesce(clean_stored_title("title"), clean_stored_title("agent_name"), F.substring("id", 1, 8))
    out = tree.withColumns(
        {
            "session_id": F.col("root"), "is_main": main, "agent_key": F.when(main, F.lit("main")).otherwise(F.col("id")),
            "parent_key": F.when(F.col("parent") == F.col("root"), F.lit("main")).otherwise(F.col("parent")),
            "label": mask_secrets(name), "cwd": display_home("workspace", home), "model": F.lit(None).cast("string"),
            "flags": F.array_distinct(F.filter(F.array(nz("agent_name"), F.when(F.col("step_count") > 0, F.concat(F.col("step_count").cast("string"), F.lit(" steps"))), nz("source"),
                nz(F.regexp_replace(F.lower("status"), "^cascade_run_status_", "")), F.when(F.col("is_winner"), F.lit("winner")).when(F.col("in_battle"), F.lit("parallel attempt"))), lambda x: x.isNotNull())),
            "input": F.lit(0).cast("bigint"), "total_tokens": F.lit(0).cast("bigint"), "cost_usd": F.lit(0.0), "cost_partial": F.lit(False),
        }
    )
    newest = out.groupBy("session_id").agg(F.max("last").alias("__newest"), F.bool_or(F.col("state") == "running").alias("__run"))
    keep = newest.where((F.col("__newest") >= now - recent_ms) | F.col("__run")).select("session_id")
    return out.join(keep, "session_id", "left_semi")


def sessions(tree: DataFrame, now: int) -> DataFrame:
    line = activity_buckets(tree.where(F.col("last_ts").isNotNull()), ["session_id"], "last_ts", now)
    main = tree.where("is_main").select("session_id", F.col("label").alias("session_name"), "cwd", "status_label")
    out = S.session_summary(tree, main.join(line.select("session_id", F.struct("end", "counts").alias("activity")), "session_id", "left"))
    label = F.when((F.col("running_agents") > 0) & (F.col("root_state") != "running"), F.lit("busy")).otherwise(F.col("status_label"))
    return out.withColumn("status", label)
