"""File layouts: listings, line logs, whole documents, side files and sinks.

A listing is filtered by name and age before any content is read.  ``ord`` is the byte offset of a line in its file.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tracelake.functions import json as J
from tracelake.functions.text import nz, safe_path

# --- fixed values ---------------------------------------------------------------------------------
SESSION_FILE = "/([0-9a-zA-Z][0-9a-zA-Z_-]{7,79})\\.jsonl$"
AGENT_FILE = "/([^/]+)/subagents/((?:[^/]+/)*)agent-([A-Za-z0-9_-]{1,64})\\.jsonl$"
AGENT_META = "/([^/]+)/subagents/((?:[^/]+/)*)agent-([A-Za-z0-9_-]{1,64})\\.meta\\.json$"
REGISTRY_FILE = "/\\d+\\.json$"
ROLLOUT_FILE = "(?i)/rollout-.*-([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\\.jsonl$"
#: The only files of a chain store that are ever read, below its projects folder.
CHAIN_STORE_FILE = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}/(project\\.json|\\.internal/ng-sessions\\.sqlite)$"
RECENT_MS = 24 * 3_600_000
# --- end of fixed values --------------------------------------------------------------------------


def plain_path(c: Column) -> Column:
    """``file:///x`` and ``file:/x`` as ``/x``; other schemes stay."""
    return F.regexp_replace(c, "^file:/+", "/")


def list_files(spark: SparkSession, path: str | Sequence[str], pattern: str = "*", roots: Sequence[str] = ()) -> DataFrame:
    """``path, length, mtime`` of the files below ``path``; contents are pruned, denied names dropped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    out = files.select(plain_path(F.col("path")).alias("path"), "length", F.unix_millis("modificationTime").alias("mtime"))
    return out.where(safe_path("path", list(roots))) if roots else out


def _offsets_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``ord`` by the bytes of the same split before each line; a task reads one split after the other."""
    last, at = None, 0
    for batch in batches:
        keys = list(zip(batch["file"].to_pylist(), batch["__start"].to_pylist(), strict=True))
        sizes = pc.add(pc.binary_length(batch["value"]), 1).to_numpy(zero_copy_only=False)
        out = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            if key != last:
                last, at = key, 0
            out[k] = at
            at += int(sizes[k])
        yield batch.set_column(batch.schema.get_field_index("ord"), "ord", pa.array(out))


def read_lines(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.jsonl", modified_after: str | None = None) -> DataFrame:
    """``file, ord, value, mtime`` of text logs; ``ord`` is the byte at which a line begins in its file.

    Offsets are counted within each split while it is read; a small table of the bytes of all splits says where a
    split begins.  So ``ord`` depends on the file alone, and equals what the stream gives.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", "\n")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    text = reader.text(path if isinstance(path, str) else list(path)).select(
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").cast("bigint").alias("__start"),
        "value",
        F.unix_millis("_metadata.file_modification_time").alias("mtime"),
    )
    sizes = text.groupBy("file", "__start").agg(F.sum(F.octet_length("value") + 1).alias("__bytes"))
    before = F.sum("__bytes").over(Window.partitionBy("file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    begins = sizes.select("file", "__start", F.coalesce(before, F.lit(0)).cast("bigint").alias("__begin"))
    placed = text.withColumn("ord", F.lit(0).cast("bigint")).mapInArrow(_offsets_in_split, "file string, __start bigint, value string, mtime bigint, ord bigint")
    return placed.join(begins, ["file", "__start"]).select(
        "file", (F.col("__begin") + F.col("ord")).alias("ord"), F.regexp_replace("value", "\\r$", "").alias("value"), "mtime"
    )


def read_line_log(spark: SparkSession, projects_dir: str, roots: Sequence[str] = (), modified_after: str | None = None) -> DataFrame:
    """Main and sub-agent logs as raw line rows.

    When a session id appears in several project folders, the newest main file wins.
    """
    lines = read_lines(spark, projects_dir, modified_after=modified_after)
    if roots:
        lines = lines.where(safe_path("file", list(roots)))
    sub = F.regexp_extract("file", AGENT_FILE, 3)
    owner = F.regexp_extract("file", AGENT_FILE, 1)
    own = F.regexp_extract("file", SESSION_FILE, 1)
    is_main = ~F.contains(F.col("file"), F.lit("/subagents/"))
    keyed = lines.withColumns(
        {"session_id": F.when(is_main, nz(own)).otherwise(nz(owner)), "agent_key": F.when(is_main, F.lit("main")).otherwise(nz(sub))}
    ).where(F.col("session_id").isNotNull() & F.col("agent_key").isNotNull())
    newest = discover_sessions(spark, projects_dir).select("session_id", F.col("path").alias("file"))
    mains = keyed.where(F.col("agent_key") == "main").join(newest, ["session_id", "file"], "left_semi")
    cols = ["file", "session_id", "agent_key", "ord", "value", "mtime"]
    return mains.select(*cols).unionByName(keyed.where(F.col("agent_key") != "main").select(*cols))


def discover_sessions(spark: SparkSession, projects_dir: str) -> DataFrame:
    """One row per session id: the newest of its main files (the first by path among equals)."""
    files = list_files(spark, projects_dir, "*.jsonl").where(~F.contains(F.col("path"), F.lit("/subagents/")))
    ids = files.withColumn("session_id", nz(F.regexp_extract("path", SESSION_FILE, 1))).where(F.col("session_id").isNotNull())
    best = F.min_by(F.struct("path", "length", "mtime"), F.struct(-F.col("mtime"), F.col("path")))
    return ids.groupBy("session_id").agg(best.alias("f")).select("session_id", "f.*")


def discover_agents(spark: SparkSession, projects_dir: str) -> DataFrame:
    """Sub-agent files with session, agent and workflow folder (however deep)."""
    files = list_files(spark, projects_dir, "agent-*.jsonl")
    dirs = F.filter(F.split(F.regexp_extract("path", AGENT_FILE, 2), "/"), lambda d: (d != "") & (d != "workflows"))
    return files.select(
        nz(F.regexp_extract("path", AGENT_FILE, 1)).alias("session_id"),
        nz(F.regexp_extract("path", AGENT_FILE, 3)).alias("agent_key"),
        F.try_element_at(dirs, F.lit(1)).alias("workflow"),
        "path",
        "mtime",
    ).where(F.col("agent_key").isNotNull())


def _whole(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    return text.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), "value")


def read_registry(spark: SparkSession, sessions_dir: str, alive_pids: DataFrame) -> DataFrame:
    """The live registry, one row per session; ``alive_pids`` (column ``pid``) says who is alive."""
    from tracelake.operators.sessions import registry_latest

    files = _whole(spark, sessions_dir, "*.json").where(F.col("file").rlike(REGISTRY_FILE))
    schema = "pid double, sessionId string, cwd string, startedAt double, version string, kind string, entrypoint string, name string, status string, statusUpdatedAt double, updatedAt double"
    j = files.where(J.is_object_text("value")).select("file", F.from_json("value", schema).alias("j"))
    n = lambda c: F.col(f"j.{c}").cast("bigint")
    rows = j.where(F.col("j.pid").isNotNull() & nz("j.sessionId").isNotNull()).select(
        F.col("j.sessionId").alias("session_id"), n("pid").alias("pid"), F.coalesce(F.col("j.cwd"), F.lit("")).alias("cwd"), n("startedAt").alias("started_at"),
        nz("j.version").alias("version"), nz("j.kind").alias("kind"), nz("j.entrypoint").alias("entrypoint"), nz("j.name").alias("name"), nz("j.status").alias("status"),
        n("statusUpdatedAt").alias("status_updated_at"), n("updatedAt").alias("updated_at"), F.col("file").alias("file_ord"),
    )
    live = alive_pids.select("pid").distinct().withColumn("alive", F.lit(True))
    return registry_latest(rows.join(live, "pid", "left").withColumn("alive", F.coalesce("alive", F.lit(False))))


def read_agent_meta(spark: SparkSession, projects_dir: str) -> DataFrame:
    """Optional side files of sub-agents."""
    files = _whole(spark, projects_dir, "agent-*.meta.json").where(J.is_object_text("value"))
    schema = "agentType string, description string, toolUseId string, spawnDepth double, requestShape string, model string, worktreePath string, worktreeBranch string"
    j = F.from_json("value", schema)
    dirs = F.filter(F.split(F.regexp_extract("file", AGENT_META, 2), "/"), lambda d: (d != "") & (d != "workflows"))
    return files.select(
        nz(F.regexp_extract("file", AGENT_META, 1)).alias("session_id"), nz(F.regexp_extract("file", AGENT_META, 3)).alias("agent_key"),
        F.try_element_at(dirs, F.lit(1)).alias("workflow"), j.alias("j"),
    ).where(F.col("agent_key").isNotNull()).select(
        "session_id", "agent_key", "workflow", nz("j.agentType").alias("agent_type"), nz("j.description").alias("description"), nz("j.toolUseId").alias("tool_use_id"),
        F.col("j.spawnDepth").cast("int").alias("spawn_depth"), nz("j.requestShape").alias("request_shape"), nz("j.model").alias("model"),
        nz("j.worktreePath").alias("worktree_path"), nz("j.worktreeBranch").alias("worktree_branch"),
    )


def read_title_files(spark: SparkSession, projects_dir: str) -> DataFrame:
    files = _whole(spark, projects_dir, "custom-title.json")
    return files.select(
        F.regexp_extract("file", "/([^/]+)/custom-title\\.json$", 1).alias("session_id"), nz(F.get_json_object("value", "$.customTitle")).alias("title")
    ).where(F.col("title").isNotNull())


def allowed_store_file(path: Column | str, projects_dir: str) -> Column:
    """A chain store file that may be read: project file or session store of a project, and no denied name."""
    p = F.col(path) if isinstance(path, str) else path
    root = projects_dir.rstrip("/") + "/"
    rel = F.substring(p, len(root) + 1, 2_147_483_647)
    return safe_path(p, [projects_dir]) & rel.rlike(CHAIN_STORE_FILE)


def read_project_names(spark: SparkSession, projects_dir: str) -> DataFrame:
    """Optional project names of a chain store: ``project_id, name``."""
    files = _whole(spark, projects_dir, "project.json").where(allowed_store_file("file", projects_dir) & J.is_object_text("value"))
    pid = F.regexp_extract("file", "/([^/]+)/project\\.json$", 1)
    return files.select(pid.alias("project_id"), nz(F.get_json_object("value", "$.name")).alias("name")).where(F.col("name").isNotNull())


def rollout_globs(root: str, now_ms: int, recent_ms: int = RECENT_MS) -> list[str]:
    """Date folders ``YYYY/MM/DD`` from a day before the window to a day after now."""
    day = datetime.fromtimestamp((now_ms - recent_ms) / 1000, timezone.utc).date() - timedelta(days=1)
    end = datetime.fromtimestamp(now_ms / 1000, timezone.utc).date() + timedelta(days=1)
    out = []
    while day <= end:
        out.append(f"{root}/sessions/{day:%Y/%m/%d}")
        day += timedelta(days=1)
    return out


def _any_of(paths: Sequence[str]) -> str:
    """One glob for several folders; unlike a list of paths it may match only some of them."""
    if len(paths) == 1:
        return paths[0]
    parts = [p.split("/") for p in paths]
    n = next((k for k, names in enumerate(zip(*parts, strict=False)) if len(set(names)) > 1), 0)
    return "/".join(parts[0][:n]) + "/{" + ",".join("/".join(p[n:]) for p in parts) + "}"


def read_rollouts(spark: SparkSession, paths: Sequence[str], archived_path: str | None = None, roots: Sequence[str] = ()) -> DataFrame:
    """Rollout logs of those of the given folders that exist, as raw rows; files of the archive folder are flagged."""

    def one(path: str, archived: bool) -> DataFrame:
        try:
            lines = read_lines(spark, path, "rollout-*.jsonl")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            lines = spark.createDataFrame([], "file string, ord bigint, value string, mtime bigint")
        if roots:
            lines = lines.where(safe_path("file", list(roots)))
        tid = F.lower(nz(F.regexp_extract("file", ROLLOUT_FILE, 1)))
        return lines.withColumns({"thread_id": tid, "archived": F.lit(archived)}).where(F.col("thread_id").isNotNull())

    out = one(_any_of(paths), False)
    return out.unionByName(one(archived_path, True)) if archived_path else out


def read_doc_sessions(spark: SparkSession, path: str, now_ms: int, recent_ms: int = RECENT_MS, max_bytes: int | None = None) -> DataFrame:
    """Whole-document sessions as ``file, mtime, value``.  Old files (and those above ``max_bytes``, if
    given) are dropped from the listing; their contents are not parsed."""
    keep = list_files(spark, path, "session-*.json").where(F.col("mtime") >= now_ms - recent_ms)
    if max_bytes is not None:
        keep = keep.where(F.col("length") <= max_bytes)
    after = datetime.fromtimestamp((now_ms - recent_ms) / 1000 - 1, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "session-*.json").option("modifiedAfter", after)
    text = reader.text(path, wholetext=True)
    if max_bytes is not None:
        text = text.where(F.col("_metadata.file_size") <= max_bytes)
    rows = text.select(plain_path(F.col("_metadata.file_path")).alias("file"), F.unix_millis("_metadata.file_modification_time").alias("mtime"), "value")
    return rows.join(keep.select(F.col("path").alias("file")), "file", "left_semi")


# ------------------------------------------------------------------------------------ adapters and sinks
ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def register_adapter(layout: str, events: Callable[..., DataFrame]) -> None:
    """Add a layout: a function from its raw table(s) to neutral events."""
    ADAPTERS[layout] = events


def normalize_events(raw, layout: str, **options) -> DataFrame:
    """Raw rows of one layout as neutral events."""
    if not ADAPTERS:
        from tracelake.plans import register_all

        register_all()
    if layout not in ADAPTERS:
        raise ValueError(f"unknown layout: {layout}")
    return ADAPTERS[layout](raw, **options)


def union_layouts(tables: Sequence[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Results as parquet or JSON."""
    writer = df.write.mode(mode).format(fmt)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
